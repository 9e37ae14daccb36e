"""Document fingerprints by invertible Bloom lookup sketches of paragraphs.

A text is cut into paragraphs: after each newline, and inside a line where the last LOOK bytes hash to one of EVERY values
(so a cut depends on what stands right before it alone, and an edit moves no cut elsewhere). A paragraph's digest is a
64-bit hash of its bytes and of how often it came before in the text. A sketch has cells of (count, xor of digests, xor of
their checks); each digest goes to three of them. The difference of two sketches is that of their cells: what both hold
cancels, and peeling cells that hold one digest recovers those of either side. If some cells don't come to nothing, both
texts are sketched again with GROW times as many, until they do, so the difference is always whole.

A fingerprint is the smallest sketch, CELLS cells, in base64; equal texts have equal ones. The likeness of two is the share
of their paragraphs in common, (a + b - d) / (a + b + d) where d is the number of digests that differ; two empty texts
have likeness 1.

Sketches of a run of documents are one array and are peeled together, so what is held grows with a run and one text.

Defined results: a null text counts as empty; rows that repeat an id stand in the order of xxhash64 of their texts; a
null doc_id comes before all others; a single row is its own successor; extra columns are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise
from .textbuf import mix, runs

CELLS, GROW, HASHES = 12, 4, 3
#: Bytes that a cut looks back at, and one in how many places is one.
LOOK, EVERY = 8, 32
#: Rounds of peeling before a sketch counts as too small; whole ones take a few.
ROUNDS = 200
#: Bytes of text that are compared at once.
RUN_BYTES = 500_000

_rng = np.random.default_rng(20250611)
_BYTE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOOK_BYTE = _rng.integers(1, 2**63, (LOOK, 256), dtype=np.uint64)
_ODD, _CHECK = np.uint64(0xD1B54A32D192ED03), np.uint64(0x2545F4914F6CDD1D)
_SEEDS = _rng.integers(1, 2**63, HASHES, dtype=np.uint64)

np.seterr(over="ignore")


class Digests(NamedTuple):
    key: np.ndarray  # uint64, the paragraphs of all texts one after another
    first: np.ndarray  # for each text, its first paragraph; number of texts + 1

    def take(self, texts: np.ndarray) -> Digests:
        count = np.diff(self.first)[texts]
        first = np.append(0, np.cumsum(count))
        return Digests(self.key[np.arange(first[-1]) + np.repeat(self.first[texts] - first[:-1], count)], first)


def paragraph_digests(texts: list[bytes]) -> Digests:
    """The digests of the paragraphs of each text."""
    gap = bytes(LOOK)
    data = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    size = np.array([len(t) for t in texts], np.int64)
    begin = LOOK + np.append(0, np.cumsum(size + LOOK)[:-1])
    if not size.sum():
        return Digests(np.zeros(0, np.uint64), np.zeros(len(texts) + 1, np.int64))
    seen = np.zeros(len(data), np.uint64)
    for back in range(LOOK):
        seen[back:] += _LOOK_BYTE[back][data[: len(data) - back]]
    cut = mix(seen) % np.uint64(EVERY) == 0
    cut[:-1] &= (data[1:] & 0xC0) != 0x80  # not inside a character
    cut |= data == 10
    inside = np.zeros(len(data) + 1, np.int8)
    np.add.at(inside, begin, 1)
    np.add.at(inside, begin + size, -1)
    owner = np.cumsum(inside[:-1], dtype=np.int8) > 0
    starts = np.zeros(len(data), bool)
    starts[1:] = cut[:-1]
    starts[begin[size > 0]] = True
    starts = np.flatnonzero(starts & owner)
    doc = np.searchsorted(begin, starts, "right") - 1
    ends = np.minimum(np.append(starts[1:], len(data)), begin[doc] + size[doc])
    length = ends - starts
    within = np.arange(len(data)) - np.repeat(np.append(0, starts), np.diff(np.append(np.append(0, starts), len(data))))
    value = np.where(owner, _BYTE[data], np.uint64(0)) * _powers(int(length.max()))[np.minimum(within, length.max() - 1)]
    digest = mix(np.add.reduceat(value, starts) + length.astype(np.uint64))
    order = np.lexsort((digest, doc))
    again = np.append(False, (digest[order][1:] == digest[order][:-1]) & (doc[order][1:] == doc[order][:-1]))
    at = np.arange(len(order))
    nth = np.empty(len(order), np.uint64)
    nth[order] = at - np.maximum.accumulate(np.where(again, 0, at))
    return Digests(mix(digest + nth * _ODD), np.searchsorted(doc, np.arange(len(texts) + 1)))


def _powers(n: int) -> np.ndarray:
    return np.cumprod(np.full(n, _ODD, np.uint64))


class Sketches(NamedTuple):
    """Sketches of so many cells each, one after another; differences of two have the same form."""

    cells: int
    count: np.ndarray
    key: np.ndarray
    check: np.ndarray

    def minus(self, other: Sketches) -> Sketches:
        return Sketches(self.cells, self.count - other.count, self.key ^ other.key, self.check ^ other.check)


def _places(key: np.ndarray, sketch: np.ndarray, cells: int) -> np.ndarray:
    """HASHES rows: the cells of each digest, in a part of its own for each hash."""
    part = cells // HASHES
    return np.stack([(mix(key ^ s ^ np.uint64(cells)) % np.uint64(part)).astype(np.int64) + (j * part) + sketch * cells for j, s in enumerate(_SEEDS)])


def _check(key: np.ndarray) -> np.ndarray:
    return (mix(key ^ _CHECK) >> np.uint64(32)).astype(np.uint32)


def sketches(digests: Digests, cells: int = CELLS) -> Sketches:
    n = len(digests.first) - 1
    count, key, check = np.zeros(n * cells, np.int32), np.zeros(n * cells, np.uint64), np.zeros(n * cells, np.uint32)
    at = _places(digests.key, np.repeat(np.arange(n), np.diff(digests.first)), cells)
    checks = _check(digests.key)
    for row in at:
        np.add.at(count, row, 1)
        np.bitwise_xor.at(key, row, digests.key)
        np.bitwise_xor.at(check, row, checks)
    return Sketches(cells, count, key, check)


class Peeled(NamedTuple):
    whole: np.ndarray  # for each sketch: all its cells came to nothing
    sketch: np.ndarray  # of each digest recovered
    key: np.ndarray
    sign: np.ndarray  # 1: of the first side, -1: of the second


def peel(difference: Sketches) -> Peeled:
    """Recover the digests of differences, of all sketches together."""
    cells, count, key, check = difference.cells, difference.count.copy(), difference.key.copy(), difference.check.copy()
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    look = np.arange(len(count))
    for _ in range(ROUNDS):
        pure = look[np.abs(count[look]) == 1]
        pure = pure[check[pure] == _check(key[pure])]
        if not len(pure):
            break
        sketch, keys, sign = pure // cells, key[pure], count[pure]
        order = np.lexsort((keys, sketch))
        fresh = order[np.append(True, (keys[order][1:] != keys[order][:-1]) | (sketch[order][1:] != sketch[order][:-1]))]
        sketch, keys, sign = sketch[fresh], keys[fresh], sign[fresh]
        found.append((sketch, keys, sign))
        checks = _check(keys)
        at = _places(keys, sketch, cells)
        for row in at:
            np.subtract.at(count, row, sign)
            np.bitwise_xor.at(key, row, keys)
            np.bitwise_xor.at(check, row, checks)
        look = np.unique(at)
    left = ((count != 0) | (key != 0) | (check != 0)).reshape(-1, cells).any(1)
    sketch, keys, sign = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int32))
    return Peeled(~left, sketch, keys, sign)


class Differences(NamedTuple):
    """Of each pair: the digests that only its old or its new text has, one pair after another, and the tries it took."""

    old: Digests
    new: Digests
    tries: np.ndarray

    def likeness(self, a: Digests, b: Digests) -> np.ndarray:
        both = np.diff(a.first) + np.diff(b.first)
        apart = np.diff(self.old.first) + np.diff(self.new.first)
        return np.where(both > 0, (both - apart) / np.maximum(both + apart, 1), 1.0)


def differences(a: Digests, b: Digests) -> Differences:
    """Subtract and peel the sketches of each pair of texts, with larger ones for pairs where that fails."""
    pairs = np.arange(len(a.first) - 1)
    tries = np.zeros(len(pairs), np.int32)
    pair, key, sign = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)]
    todo, cells = pairs, CELLS
    while len(todo):
        tries[todo] += 1
        got = peel(sketches(a.take(todo), cells).minus(sketches(b.take(todo), cells)))
        done = got.whole[got.sketch]
        pair.append(todo[got.sketch[done]])
        key.append(got.key[done])
        sign.append(got.sign[done])
        todo, cells = todo[~got.whole], cells * GROW
    pair, key, sign = np.concatenate(pair), np.concatenate(key), np.concatenate(sign)
    order = np.lexsort((key, pair))
    pair, key, sign = pair[order], key[order], sign[order]
    side = lambda s: Digests(key[sign == s], np.searchsorted(pair[sign == s], np.arange(len(pairs) + 1)))
    return Differences(side(1), side(-1), tries)


def written(s: Sketches) -> list[str]:
    """Each sketch in base64: its counts, digests and checks, little-endian."""
    parts = [x.reshape(-1, s.cells) for x in (s.count.astype("<i4"), s.key.astype("<u8"), s.check.astype("<u4"))]
    return [base64.b64encode(c.tobytes() + k.tobytes() + h.tobytes()).decode() for c, k, h in zip(*parts, strict=True)]


# ---------------------------------------------------------------- Spark


def compare_versions(versions: DataFrame) -> DataFrame:
    """versions(doc_id, old, new, ...) to (doc_id, old_fingerprint, new_fingerprint, likeness, removed, added, tries).

    removed, added: the digests of paragraphs that only the old or only the new text has."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "old", RUN_BYTES):
            a, b = (paragraph_digests([(t or "").encode() for t in run.rows.column(c).to_pylist()]) for c in (1, 2))
            d = differences(a, b)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(x.first.astype(np.int32)), pa.array(x.key.view(np.int64)))
            yield pa.RecordBatch.from_arrays(
                [run.rows.column(0), pa.array(written(sketches(a))), pa.array(written(sketches(b))), pa.array(d.likeness(a, b)), lists(d.old), lists(d.new), pa.array(d.tries)],
                names=["doc_id", "old_fingerprint", "new_fingerprint", "likeness", "removed", "added", "tries"],
            )

    schema = "doc_id long, old_fingerprint string, new_fingerprint string, likeness double, removed array<long>, added array<long>, tries int"
    return versions.select("doc_id", "old", "new").mapInArrow(compare, schema)


def edited(text: str, following: str) -> str:
    """The text with its last half replaced by as much, or all, of the beginning of the following one."""
    half = len(text) // 2
    return text[: len(text) - half] + following[:half]


RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, tries int"
#: What a task says besides its results: its first and its last text, and its place among the tasks.
ENDS = "task int, end string, text string"


def _compared(ids: list[int | None], texts: list[str]) -> dict[str, list]:
    """Results for all rows but the last, each with the next as its successor."""
    old = [t.encode() for t in texts]
    new = [edited(t, u).encode() for t, u in zip(texts[:-1], texts[1:], strict=True)]
    a, e = paragraph_digests(old), paragraph_digests(new)
    place = np.arange(len(new))
    own, following = a.take(place), a.take(place + 1)
    near_e, near_n = differences(own, e), differences(own, following)
    return {
        "doc_id": ids[:-1], "n_chars": [len(t) for t in texts[:-1]], "edited_sha256": [hashlib.sha256(t).hexdigest() for t in new], "fingerprint": written(sketches(own)), "edited_fingerprint": written(sketches(e)),
        "near_edited": near_e.likeness(own, e).tolist(), "near_next": near_n.likeness(own, following).tolist(), "tries": np.maximum(near_e.tries, near_n.tries).tolist(),
    }


def _batch(columns: dict[str, list], schema: str) -> pa.RecordBatch:
    kinds = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}
    fields = [f.split() for f in schema.split(", ")]
    n = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays([pa.array(columns.get(name, [None] * n), kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text, ...) to RESULT: each document against its edited text and against the next in ascending doc_id.

    Texts are shuffled once, into ranges of ids; a task has the successors of all its rows but the last. Those few are
    joined with the first row of the task after it. Rows that are equal may be spread over tasks."""

    def compare(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get().partitionId()
        ids: list[int | None] = []
        texts: list[str] = []
        for run in runs(batches, "text", RUN_BYTES):
            begins = not ids
            ids += run.rows.column(0).to_pylist()
            texts += run.rows.column(1).to_pylist()
            if begins:
                yield _batch({"doc_id": ids[:1], "task": [task], "end": ["first"], "text": texts[:1]}, f"{RESULT}, {ENDS}")
            if len(ids) > 1:
                yield _batch(_compared(ids, texts), f"{RESULT}, {ENDS}")
            ids, texts = ids[-1:], texts[-1:]
        if ids:
            yield _batch({"doc_id": ids, "task": [task], "end": ["last"], "text": texts}, f"{RESULT}, {ENDS}")

    def compare_ends(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc_id, text, following in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield _batch(_compared([doc_id, None], [text, following]), RESULT)

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h"), F.monotonically_increasing_id().alias("salt"))
    ordered = rows.repartitionByRange("doc_id", "h", "salt").sortWithinPartitions("doc_id", "h").select("doc_id", "text")
    table = materialise(ordered.mapInArrow(compare, f"{RESULT}, {ENDS}"), "fingerprints")
    # A row for each task: which task with rows comes after it.
    tasks = table.where("end = 'first'").select("task")
    by_task = Window.orderBy("task")
    after = tasks.select("task", F.coalesce(F.lead("task").over(by_task), F.min("task").over(Window.partitionBy())).alias("after"))
    last, first = table.where("end = 'last'").select("task", "doc_id", "text"), table.where("end = 'first'").select(F.col("task").alias("after"), F.col("text").alias("following"))
    pairs = last.join(after, "task").join(first, "after").select("doc_id", "text", "following")
    result = [f.split()[0] for f in RESULT.split(", ")]
    return table.where("end is null").select(*result).unionByName(pairs.mapInArrow(compare_ends, RESULT))
