"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order: blocks of prefix-compressed entries, then a sparse index
(last key, place and size of each block), a Bloom filter over the keys, and a footer. A lookup asks the
filter, searches the index by bisection and reads one block.

Defined results: a null text is encoded as empty; an empty text has the end id alone; a null doc_id sorts
before all others; rows that repeat a doc_id are all kept, ordered by text; other columns are ignored; the
string of an added token in a text becomes that token, as the library's encode() reads it.
"""

from __future__ import annotations

import bisect
import struct
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe_replay import fast_pattern
from .pretokens import pieces
from .shared import materialise, shared_dir
from .textbuf import runs

MAGIC = b"TOKSST01"
BLOCK_BYTES = 64 * 1024
BLOOM_BITS, BLOOM_HASHES = 10, 7
#: Pieces that a worker remembers, and the longest that it remembers.
MEMO_PIECES, MEMO_CHARS = 800_000, 64
_FOOTER = struct.Struct("<QQQQQQ8s")


# ---------------------------------------------------------------- keys and numbers


def key_of(doc_id: int | None) -> bytes:
    """Bytes in the order of the ids; null is before all."""
    return b"" if doc_id is None else struct.pack(">BQ", 1, doc_id + 2**63)


def doc_id_of(key: bytes) -> int | None:
    return struct.unpack(">BQ", key)[1] - 2**63 if key else None


def put_varint(out: bytearray, n: int) -> None:
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)


def get_varint(data: memoryview, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        at += 1
        n |= (b & 127) << shift
        if b < 128:
            return n, at
        shift += 7


# ---------------------------------------------------------------- the format


def bloom_places(key: bytes, bits: int) -> list[int]:
    a, b = zlib.crc32(key), zlib.adler32(key[::-1]) * 2654435761 + 1 & 0xFFFFFFFF
    return [(a + i * (b | 1) + i * i) % bits for i in range(BLOOM_HASHES)]


class ShardWriter:
    """Entries must come in ascending key order."""

    def __init__(self, sink) -> None:
        self.sink, self.at, self.block, self.last = sink, 0, bytearray(), b""
        self.index: list[tuple[bytes, int, int]] = []
        self.keys: list[bytes] = []
        self.tokens = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        """ids: uint32. Stored in two bytes each where all fit."""
        if self.keys and key < self.keys[-1]:
            raise ValueError("keys must ascend")
        shared = 0
        if self.block:
            while shared < min(len(key), len(self.last)) and key[shared] == self.last[shared]:
                shared += 1
        narrow = not len(ids) or int(ids.max()) < 65536
        value = (ids.astype("<u2") if narrow else ids.astype("<u4")).tobytes()
        for n in (shared, len(key) - shared, len(ids) * 2 + (not narrow)):
            put_varint(self.block, n)
        self.block += key[shared:] + value
        self.last, self.tokens = key, self.tokens + len(ids)
        self.keys.append(key)
        if len(self.block) >= BLOCK_BYTES:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.sink.write(bytes(self.block))
            self.index.append((self.last, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = bytearray()
        for key, at, size in self.index:
            for n in (len(key), at, size):
                put_varint(index, n)
            index += key
        bits = max(64, len(self.keys) * BLOOM_BITS)
        bloom = np.zeros((bits + 7) // 8, np.uint8)
        for key in self.keys:
            for p in bloom_places(key, bits):
                bloom[p >> 3] |= 1 << (p & 7)
        self.sink.write(bytes(index))
        self.sink.write(bloom.tobytes())
        self.sink.write(_FOOTER.pack(self.at, len(index), len(bloom), bits, len(self.keys), self.tokens, MAGIC))


class Shard:
    """Reads a shard from a file that can seek."""

    def __init__(self, file) -> None:
        self.file = file
        size = file.size()
        if size < _FOOTER.size:
            raise ValueError("no shard: too short")
        at, n_index, n_bloom, self.bits, self.entries, self.tokens, magic = _FOOTER.unpack(self._read(size - _FOOTER.size, _FOOTER.size))
        if magic != MAGIC:
            raise ValueError("no shard: wrong magic")
        self.bloom = self._read(at + n_index, n_bloom)
        index, k = memoryview(self._read(at, n_index)), 0
        self.index: list[tuple[bytes, int, int]] = []
        while k < len(index):
            n, k = get_varint(index, k)
            where, k = get_varint(index, k)
            length, k = get_varint(index, k)
            self.index.append((bytes(index[k : k + n]), where, length))
            k += n

    def _read(self, at: int, n: int) -> bytes:
        self.file.seek(at)
        return self.file.read(n)

    def block(self, k: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, where, length = self.index[k]
        data, at, key = memoryview(self._read(where, length)), 0, b""
        while at < len(data):
            shared, at = get_varint(data, at)
            rest, at = get_varint(data, at)
            n, at = get_varint(data, at)
            key = key[:shared] + bytes(data[at : at + rest])
            at += rest
            n, wide = n >> 1, n & 1
            step = 4 if wide else 2
            yield key, np.frombuffer(data[at : at + n * step], "<u4" if wide else "<u2").astype("<u4")
            at += n * step

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for k in range(len(self.index)):
            yield from self.block(k)

    def may_hold(self, key: bytes) -> bool:
        return all(self.bloom[p >> 3] >> (p & 7) & 1 for p in bloom_places(key, self.bits))

    def lookup(self, doc_id: int | None) -> list[np.ndarray]:
        """The id lists under this key (several if rows repeat it)."""
        key, found = key_of(doc_id), []
        if self.may_hold(key):
            k = bisect.bisect_left(self.index, key, key=lambda e: e[0])
            while k < len(self.index):
                hits = [(x, ids) for x, ids in self.block(k) if x >= key]
                found += [ids for x, ids in hits if x == key]
                if any(x > key for x, _ in hits):
                    break
                k += 1
        return found


def open_shard(uri: str) -> Shard:
    fs, path = pafs.FileSystem.from_uri(uri)
    return Shard(fs.open_input_file(path))


# ---------------------------------------------------------------- encoding


class _Memo(dict):
    """The ids of pieces, learned where they are asked for; long ones aren't kept."""

    def __init__(self, learn: Callable[[str], bytes]) -> None:
        self.learn = learn

    def __missing__(self, text: str) -> bytes:
        ids = self.learn(text)
        if len(text) <= MEMO_CHARS:
            self[text] = ids
        return ids


class PieceEncoder:
    """Encodes texts by pieces, each distinct piece and each distinct pre-token once while it is remembered.

    The ids are those of the library's encode(text, add_special_tokens=False): a text that holds the string of an
    added token, such as that of the end of a text, is given to it whole, as that token cuts the text around it."""

    def __init__(self, tokenizer_file: str, pattern: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.model = self.tokenizer.model
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.findall = fast_pattern(pattern).findall
        self.letters = byte_letters()
        self.memo, self.known = _Memo(self._after_space), _Memo(self._token)

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text as little-endian unsigned 32-bit integers."""
        if len(self.memo) > MEMO_PIECES:
            self.memo.clear()
        if len(self.known) > MEMO_PIECES // 2:
            self.known.clear()
        ids, out = self.memo.__getitem__, []
        for text in texts:
            if any(x in text for x in self.added):
                out.append(array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes())
                continue
            head, *rest = pieces(text)
            out.append(self._piece(head) + b"".join(map(ids, rest)))
        return out

    def _after_space(self, piece: str) -> bytes:
        """A space and ASCII letters are one pre-token of all such patterns."""
        return self.known[" " + piece] if piece.isalpha() and piece.isascii() else self._piece(" " + piece)

    def _piece(self, piece: str) -> bytes:
        tokens = self.findall(piece)
        return self.known[piece] if len(tokens) == 1 else b"".join(map(self.known.__getitem__, tokens))

    def _token(self, token: str) -> bytes:
        if token.isascii() and token.isprintable():  # each character stands for itself but the space
            word = token.replace(" ", self.letters[32])
        else:
            word = token.encode().decode("latin-1").translate(self.letters)
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()


def byte_letters() -> dict[int, str]:
    """The printable character that byte-level vocabularies write for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


_encoders: dict[tuple[str, str], PieceEncoder] = {}


def encoder(tokenizer_file: str, pattern: str) -> PieceEncoder:
    """One for each worker process."""
    if (tokenizer_file, pattern) not in _encoders:
        _encoders[tokenizer_file, pattern] = PieceEncoder(tokenizer_file, pattern)
    return _encoders[tokenizer_file, pattern]


# ---------------------------------------------------------------- Spark

MANIFEST = "path string, first_key binary, entries long, tokens long"


class Table(NamedTuple):
    folder: str
    manifest: DataFrame  # a row for each shard that was committed


def write_token_table(docs: DataFrame, tokenizer_file: str, pattern: str, end_id: int = 2, folder: str | None = None) -> Table:
    """Encode docs(doc_id, text, ...), append end_id to each, write shards that are ranges of doc_id.

    An attempt writes a file of its own; only the manifest row of the attempt that Spark commits names it, so a
    repeated or speculative task leaves no wrong shard. One block and the encoder's memo are held at a time."""
    folder = folder or shared_dir(docs.sparkSession, "token-table")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs = writer = sink = None
        path, head = "", b""
        end = np.array([end_id], "<u4")
        for run in runs(batches, "text"):
            if writer is None:
                fs, root = pafs.FileSystem.from_uri(folder)
                fs.create_dir(root, recursive=True)
                name = f"shard-{uuid.uuid4().hex}.sst"
                sink = fs.open_output_stream(f"{root}/{name}")
                path, writer = f"{folder}/{name}", ShardWriter(sink)
            ids = run.rows.column(0).to_pylist()
            texts = [t or "" for t in run.rows.column(1).to_pylist()]
            for doc_id, got in zip(ids, encoder(tokenizer_file, pattern).encode(texts), strict=True):
                key = key_of(doc_id)
                head = head if writer.keys else key
                writer.add(key, np.concatenate([np.frombuffer(got, "<u4"), end]))
        if writer is not None:
            writer.close()
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "first_key": pa.array([head], pa.binary()), "entries": [len(writer.keys)], "tokens": [writer.tokens]})

    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    return Table(folder, materialise(ordered.mapInArrow(write, MANIFEST), "token-manifest"))


def read_token_table(table: Table) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), each read from the shards; start counts the ids of all documents before."""
    # A row for each shard: the running sum over them is small at any size of the corpus.
    before = F.sum("tokens").over(Window.orderBy("first_key").rowsBetween(Window.unboundedPreceding, -1))
    based = table.manifest.select("path", F.coalesce(before, F.lit(0)).alias("base"))
    tasks = max(1, int(table.manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                shard = open_shard(path)
                for k in range(len(shard.index)):
                    ids, start, n, crc = [], [], [], []
                    for key, tokens in shard.block(k):
                        ids.append(doc_id_of(key))
                        start.append(at)
                        n.append(len(tokens))
                        crc.append(zlib.crc32(tokens.tobytes()))
                        at += len(tokens)
                    yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (ids, start, n, crc)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return based.repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
