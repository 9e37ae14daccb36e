"""Runs of rows of a text column as flat UTF-8 bytes, with numpy word scanning over them."""

from __future__ import annotations

import ctypes
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are worked on at once; one longer text is still taken whole.
RUN_BYTES = 1_000_000


class Run(NamedTuple):
    rows: pa.RecordBatch  # the rows, all columns
    data: np.ndarray  # uint8, the texts one after another
    offsets: np.ndarray  # int64, len(rows) + 1
    valid: np.ndarray  # bool: the text isn't null


def runs(batches: Iterable[pa.RecordBatch], column: str, limit: int = RUN_BYTES) -> Iterator[Run]:
    """Of a batch, one run at a time is copied, so what is held besides the batch is bounded by limit and one text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        texts = batch.column(batch.schema.get_field_index(column))
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = done = 0
        while at < len(texts):
            end = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
            text = texts.slice(at, end - at).cast(pa.large_string())
            valid = np.asarray(text.is_valid())
            text = text.fill_null("")
            _, offs, data = text.buffers()
            offs = np.frombuffer(offs, np.int64)[text.offset : text.offset + len(text) + 1]
            raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
            yield Run(batch.slice(at, end - at), raw[offs[0] : offs[-1]], offs - offs[0], valid)
            at, done = end, int(ends[end - 1])
    give_back()


def give_back() -> None:
    """Hand free memory back to the system, as workers stay alive between tasks and stages."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
    if trim:
        trim(0)


_rng = np.random.default_rng(20240229)
#: A random 64-bit value for each byte, A-Z as a-z.
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BYTE_VALUE[65:91] = BYTE_VALUE[97:123]
_ODD = np.uint64(0x9E3779B97F4A7C15)
_POWERS = np.cumprod(np.full(1 << 12, _ODD, np.uint64))


np.seterr(over="ignore")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser; equal inputs give equal outputs on every machine."""
    x = x ^ (x >> np.uint64(31))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(29))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(32))


#: Bytes between words.
IS_GAP = np.zeros(256, bool)
IS_GAP[[32, 9, 10, 11, 12, 13]] = True


class Words(NamedTuple):
    start: np.ndarray  # byte where each word begins
    end: np.ndarray  # byte after its last
    doc: np.ndarray  # row of the run that it is in
    first: np.ndarray  # for each row, its first word; len(rows) + 1


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Maximal runs of bytes that aren't gaps, cut where texts end."""
    inside = ~IS_GAP[data]
    edge = np.empty(len(data) + 1, bool)
    if len(data):
        edge[0], edge[-1] = inside[0], inside[-1]
        np.not_equal(inside[1:], inside[:-1], out=edge[1:-1])
    else:
        edge[:] = False
    cut = offsets[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(data))])
    both = cut[inside[cut] & inside[cut - 1]]  # a word ends and another begins at this byte
    starts = np.flatnonzero(edge[:-1] & inside) if len(data) else np.zeros(0, np.int64)
    ends = np.flatnonzero(edge[1:] & inside) + 1 if len(data) else np.zeros(0, np.int64)
    if len(both):
        starts, ends = np.sort(np.concatenate([starts, both])), np.sort(np.concatenate([ends, both]))
    doc = np.searchsorted(offsets, starts, "right") - 1
    first = np.searchsorted(starts, offsets, "left")
    return Words(starts, ends, doc, first)


def word_hashes(data: np.ndarray, w: Words) -> np.ndarray:
    """A 64-bit hash of each word, A-Z counting as a-z."""
    if not len(w.start):
        return np.zeros(0, np.uint64)
    size = w.end - w.start
    within = np.arange(len(data), dtype=np.int32 if len(data) < 2**31 else np.int64)
    within[w.start[0] :] -= np.repeat(w.start, np.diff(np.append(w.start, len(data)))).astype(within.dtype)
    top = int(size.max())
    powers = _POWERS if top <= len(_POWERS) else np.cumprod(np.full(top, _ODD, np.uint64))
    np.minimum(within, top - 1, out=within)
    value = powers[within]
    del within
    value *= BYTE_VALUE[data]
    value[IS_GAP[data]] = 0
    return mix(np.add.reduceat(value, w.start) + size.astype(np.uint64))


def shingle_hashes(hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of k words within each text, and where each text's begin; fewer words give one of them all."""
    n = np.diff(first)
    count = np.where(n >= k, n - k + 1, np.minimum(n, 1))
    begin = np.append(0, np.cumsum(count))
    out = np.zeros(begin[-1], np.uint64)
    long = np.flatnonzero(n >= k)
    if len(long):
        total = len(hashes) - k + 1
        rolled = np.zeros(total, np.uint64)
        for j in range(k):
            rolled = mix(rolled + hashes[j : j + total] * np.uint64(2 * j + 3))
        at = np.repeat(first[long] - begin[long], count[long]) + _positions(begin[long], count[long])
        out[_positions(begin[long], count[long])] = rolled[at]
    for d in np.flatnonzero((n > 0) & (n < k)):
        x = np.uint64(n[d])
        for h in hashes[first[d] : first[d + 1]]:
            x = mix(np.array([x + h * np.uint64(5)], np.uint64))[0]
        out[begin[d]] = x
    return out, begin


def _positions(begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """begin[i], begin[i] + 1, ... count[i] of them, for all i."""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - begin, count)
