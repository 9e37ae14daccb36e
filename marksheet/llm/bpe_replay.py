"""Byte-level BPE by replaying merges over a vocabulary, and decoding.

A block of documents (an Arrow batch, cut at BLOCK_BYTES) is reduced to its distinct pre-tokens, less those that
the worker remembers from blocks before. Over these an inverted index from mergeable token pair to positions is kept; the lowest rank is applied at all its
positions at once, then only the pairs that touch a merged symbol are looked up anew. No shuffle is needed.

Defined results: a null text is encoded as empty; an empty text has no ids; a repeated row is encoded again.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame

from .pretokens import pieces
from .textbuf import give_back, runs

#: Texts that are replayed together: larger blocks learn more rare pieces at once, smaller ones take less memory.
BLOCK_BYTES, SMALL_BLOCK_BYTES = 3_000_000, 1_000_000
#: A memo's generation is closed beyond so many entries; longer entries are not kept.
MEMO_PIECES, MEMO_CHARS = 200_000, 64
#: A merge at so few positions is applied one by one, as numpy's calls would cost more.
FEW = 24
NONE = np.int64(1) << 40
NONE_INT = int(NONE)


def load_ranks(path: str) -> dict[bytes, int]:
    with pafs.LocalFileSystem().open_input_stream(path) as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f.read().splitlines())}


class MergeReplay:
    """ranks: bytes of a token to its rank, which is its id; all 256 single bytes must be in it."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.byte_id = np.array([ranks[bytes([b])] for b in range(256)], np.int64)
        left, right, made = [], [], []
        for token, rank in ranks.items():
            for k in range(1, len(token)):
                if (a := ranks.get(token[:k])) is not None and (b := ranks.get(token[k:])) is not None:
                    left.append(a)
                    right.append(b)
                    made.append(rank)
        key = np.array(left, np.int64) << 32 | np.array(right, np.int64)
        order = np.argsort(key)
        self.pair, self.made = np.append(key[order], np.int64(2**62)), np.append(np.array(made, np.int64)[order], NONE)
        self.whole = ranks
        self.bytes_of = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            self.bytes_of[rank] = token
        self.id = list(range(len(self.bytes_of)))  # one object an id: results share them, which takes less memory and time

    def ranks_of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank that merging each pair gives, NONE if there is none. b < 0: no symbol."""
        key = a << 32 | np.maximum(b, 0)
        at = np.searchsorted(self.pair, key)
        return np.where((self.pair[at] == key) & (b >= 0), self.made[at], NONE)

    def encode(self, vocabulary: list[bytes]) -> list[tuple[int, ...]]:
        """The ids of each of these pre-tokens; none is empty."""
        if not vocabulary:
            return []
        sizes = np.array([len(w) for w in vocabulary], np.int64)
        sym = self.byte_id[np.frombuffer(b"".join(vocabulary), np.uint8)]
        n, first = len(sym), np.cumsum(sizes) - sizes
        word = np.repeat(np.arange(len(sizes)), sizes)
        nxt, prv = np.arange(1, n + 1), np.arange(-1, n - 1)
        nxt[first + sizes - 1] = -1
        prv[first] = -1
        alive = np.ones(n, bool)
        symbol_after = lambda i: np.where(i >= 0, sym[i], -1)
        rank = self.ranks_of(sym, symbol_after(nxt))
        index: dict[int, list[np.ndarray]] = {}  # positions under the rank of their pair, as arrays
        few: dict[int, list[int]] = {}  # and one by one
        heap: list[int] = []
        at_word, at_sym, at_nxt, at_prv, at_alive, at_rank = map(memoryview, (word, sym, nxt, prv, alive, rank))

        def post(where: np.ndarray) -> None:
            """Put these left ends of pairs under the ranks that they have now."""
            where = where[rank[where] < NONE]
            where = where[np.argsort(rank[where], kind="stable")]
            if not len(where):
                return
            own = rank[where]
            at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
            ends = [*at[1:].tolist(), len(where)]
            for r, a, b in zip(own[at].tolist(), at.tolist(), ends, strict=True):
                if r not in index:
                    index[r] = []
                    if r not in few:
                        heapq.heappush(heap, r)
                index[r].append(where[a:b])

        def look_up(i: int) -> int:
            """The rank that the pair at i has now; it is put under it."""
            after = at_nxt[i]
            new = self.whole.get(self.bytes_of[at_sym[i]] + self.bytes_of[at_sym[after]], NONE_INT) if after >= 0 else NONE_INT
            at_rank[i] = new
            if new < NONE_INT:
                if new in few:
                    few[new].append(i)
                else:
                    few[new] = [i]
                    if new not in index:
                        heapq.heappush(heap, new)
            return new

        def merge_each(r: int, where: list[int]) -> None:
            held: set[int] = set()  # words where a pair of lower rank has come up, which goes first
            for i in where:
                if not at_alive[i] or at_rank[i] != r:
                    continue
                if at_word[i] in held:
                    look_up(i)
                    continue
                mid = at_nxt[i]
                after, before = at_nxt[mid], at_prv[i]
                at_alive[mid] = False
                at_sym[i], at_nxt[i] = r, after
                if after >= 0:
                    at_prv[after] = i
                low = look_up(i) < r
                if before >= 0:
                    low |= look_up(before) < r
                if low:
                    held.add(at_word[i])

        post(np.arange(n))
        while heap:
            r = heapq.heappop(heap)
            where, single = index.pop(r, []), few.pop(r, [])
            if sum(map(len, where)) + len(single) <= FEW:
                merge_each(r, sorted({*single, *chain.from_iterable(x.tolist() for x in where)}))
                continue
            where = np.sort(np.concatenate([*where, np.array(single, np.int64)]))
            where = where[np.append(True, where[1:] != where[:-1])]
            where = where[alive[where] & (rank[where] == r)]
            if not len(where):
                continue
            if len(where) > 1:  # of pairs that overlap, the leftmost, then the next that is free
                fresh = np.append(True, nxt[where[:-1]] != where[1:])
                start = np.maximum.accumulate(np.where(fresh, np.arange(len(where)), 0))
                where = where[(np.arange(len(where)) - start) % 2 == 0]
            mid = nxt[where]
            after, before = nxt[mid], prv[where]
            # A merge can make a pair of lower rank, which in its word comes before further merges of this one.
            alive[mid] = False
            taken = (before >= 0) & ~alive[before]  # the symbol before has just been merged away
            left = np.where(taken, r, symbol_after(before))
            low = (self.ranks_of(np.full(len(where), r), symbol_after(after)) < r) | (self.ranks_of(np.maximum(left, 0), np.where(left >= 0, r, -1)) < r)
            if low.any():
                held = np.isin(word[where], word[where[low]]) & np.append(False, word[where[1:]] == word[where[:-1]])
                if held.any():
                    alive[mid[held]] = True
                    index[r] = [where[held]]
                    heapq.heappush(heap, r)
                    where, mid, after, before = where[~held], mid[~held], after[~held], before[~held]
            sym[where] = r
            nxt[where] = after
            prv[after[after >= 0]] = where[after >= 0]
            before = prv[where]
            before = before[before >= 0]
            touched = np.concatenate([where, before])
            rank[touched] = self.ranks_of(sym[touched], symbol_after(nxt[touched]))
            post(touched)
        ids, counts = [*map(self.id.__getitem__, sym[alive].tolist())], np.bincount(word[alive], minlength=len(sizes))
        ends = np.cumsum(counts).tolist()
        return [tuple(ids[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]


def fast_pattern(pattern: str) -> re.Pattern:
    """The pattern for the standard library's re, its Unicode classes spelt out as ranges."""
    import sys

    import regex

    every = "".join(map(chr, chain(range(0xD800), range(0xE000, sys.maxunicode + 1))))

    def ranges(kind: str) -> str:
        spans = [m.span() for m in regex.finditer(kind + "+", every)]
        return "".join(f"\\U{ord(every[a]):08x}" + (f"-\\U{ord(every[b - 1]):08x}" if b - a > 1 else "") for a, b in spans)

    # Unicode White_Space: re's own \s also has U+001C to U+001F, which the pattern's doesn't.
    space = r"\t-\r\x20\x85\xa0  -     　"
    out = pattern.replace(r"[^\s\p{L}\p{N}]", f"[^{space}{ranges(r'\p{L}')}{ranges(r'\p{N}')}]")
    out = out.replace(r"\p{L}", f"[{ranges(r'\p{L}')}]").replace(r"\p{N}", f"[{ranges(r'\p{N}')}]")
    return re.compile(out.replace(r"\s", f"[{space}]").replace(r"\S", f"[^{space}]"))


class Memo:
    """Ids of what came up lately, in two generations: what the older one has moves on when it comes up again, else it is dropped."""

    def __init__(self) -> None:
        self.young: dict[str, tuple[int, ...]] = {}
        self.old: dict[str, tuple[int, ...]] = {}
        self.long: list[str] = []

    def missing(self, keys: set[str]) -> list[str]:
        """Those that are to be learnt; all others are in young afterwards."""
        self.drop_long()
        if len(self.young) > MEMO_PIECES:
            self.young, self.old = {}, self.young
        keys = keys.difference(self.young)  # not "keys - self.young.keys()", which walks the whole memo
        new = keys.difference(self.old)
        self.young.update((k, self.old[k]) for k in keys.difference(new))
        return list(new)

    def add(self, got: dict[str, tuple[int, ...]]) -> None:
        self.young.update(got)
        self.long = [k for k in got if len(k) > MEMO_CHARS]

    def drop_long(self) -> None:
        """Long ones stay for one block."""
        for k in self.long:
            del self.young[k]
        self.long = []


class Codec:
    """Encodes blocks of texts and decodes ids; one for each worker process, whose tasks share what was learnt."""

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.replay, self.pattern = MergeReplay(ranks), fast_pattern(pattern)
        self.bytes_of = self.replay.bytes_of
        self.digits_of = [str(k) for k in range(len(self.bytes_of))]
        self.pieces, self.words = Memo(), Memo()

    def learn(self, new: list[str]) -> list[tuple[int, ...]]:
        """The ids of each of these pieces: their distinct pre-tokens that aren't known yet are the vocabulary of one replay."""
        cut = [self.pattern.findall(p) for p in new]
        vocabulary = self.words.missing(set(chain.from_iterable(cut)))
        self.words.add(dict(zip(vocabulary, self.replay.encode([w.encode() for w in vocabulary]), strict=True)))
        ids = self.words.young
        return [ids[c[0]] if len(c) == 1 else tuple(chain.from_iterable([ids[w] for w in c])) for c in cut]

    def encode(self, texts: list[str]) -> Iterator[list[int]]:
        seen: set[str] = set()
        heads: set[str] = set()
        for t in texts:
            p = pieces(t)
            heads.add(p[0])
            seen.update(p[1:])
        new, first = self.pieces.missing(seen), list(heads)
        got = self.learn([" " + p for p in new] + first)
        self.pieces.add(dict(zip(new, got)))
        rest, start = self.pieces.young, dict(zip(first, got[len(new) :], strict=True))
        del seen, new, heads, first, got
        for t in texts:
            if not t:
                yield []
                continue
            p = pieces(t)
            ids = list(start[p[0]])
            ids.extend(chain.from_iterable(map(rest.__getitem__, p[1:])))
            yield ids

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes_of.__getitem__, ids))


_codecs: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    if (path, pattern) not in _codecs:
        _codecs[path, pattern] = Codec(load_ranks(path), pattern)
    return _codecs[path, pattern]


def encode_documents(docs: DataFrame, ranks_file: str, pattern: str, keep_ids: bool = True, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, ids, n_tokens, ids_sha256, decoded_sha256); keep_ids=False leaves ids out.

    block_bytes bounds what a worker replays at once (one longer text is still taken whole); ids don't depend on it.
    decoded_sha256 is of the bytes that the ids give again."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(ranks_file, pattern)
        gc.disable()  # the memos' tuples are in no cycle, and walking them takes a fifth of the time
        try:
            for run in runs(batches, "text", block_bytes):
                texts = [t or "" for t in run.rows.column(1).to_pylist()]
                lists, n, ids_sha, text_sha = [], [], [], []
                for ids in own.encode(texts):
                    n.append(len(ids))
                    ids_sha.append(hashlib.sha256(",".join(map(own.digits_of.__getitem__, ids)).encode()).hexdigest())
                    text_sha.append(hashlib.sha256(own.decode(ids)).hexdigest())
                    if keep_ids:
                        lists.append(np.array(ids, np.int32))
                out = {"doc_id": run.rows.column(0)}
                if keep_ids:
                    out["ids"] = pa.array(lists, pa.list_(pa.int32()))
                out |= {"n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(text_sha, pa.string())}
                yield pa.RecordBatch.from_pydict(out)
        finally:
            gc.enable()
        own.pieces.drop_long()
        own.words.drop_long()
        give_back()

    schema = "doc_id long, " + "ids array<int>, " * keep_ids + "n_tokens long, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(work, schema)


def decode_documents(encoded: DataFrame, ranks_file: str) -> DataFrame:
    """(doc_id, ids) to (doc_id, text); null ids decode to an empty text, bytes that are no UTF-8 to U+FFFD."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table: list[bytes] = []
        for batch in batches:
            if not table:
                ranks = load_ranks(ranks_file)
                table = [b""] * (max(ranks.values()) + 1)
                for token, k in ranks.items():
                    table[k] = token
            texts = [b"".join(map(table.__getitem__, ids or [])).decode("utf-8", "replace") for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0), "text": pa.array(texts, pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(work, "doc_id long, text string")
