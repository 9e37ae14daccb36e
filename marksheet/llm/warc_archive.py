"""WARC archives of pages: writing with revisits and segments, reading with reassembly.

Writing: one record for a page; a payload of at least dedupe_bytes that a page of smaller id also has becomes a
revisit. Its block is an HTTP message with chunked transfer framing; a block longer than segment_bytes is cut into
a response with WARC-Segment-Number 1 and continuation records, which name it by WARC-Segment-Origin-ID.

Reading: records that are whole are decoded and checked where they are read; of segments the blocks are shuffled,
grouped by origin, ordered by segment number, checked against the total length, joined and decoded.

Defined results: null html is an empty payload; a null url is written as "urn:none"; rows that repeat a page_id are
each written; a null page_id is written without one and read back as null, always as a response; extra columns are
ignored. Pages are taken in runs of bounded bytes, so no task holds more than one of them and one long page.
"""

from __future__ import annotations

import gzip
import hashlib
import re
import uuid
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import materialise, shared_dir
from .textbuf import runs

SEGMENT_BYTES, CHUNK_BYTES, DEDUPE_BYTES = 16_384, 4_096, 100
DATE = "2024-01-01T00:00:00Z"


def record_uri(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '/'.join(map(str, parts)))}>"


def chunked(payload: bytes) -> bytes:
    parts = [payload[i : i + CHUNK_BYTES] for i in range(0, len(payload), CHUNK_BYTES)]
    return b"".join(b"%x\r\n%b\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    out, at = [], 0
    while True:
        line = body.index(b"\r\n", at)
        size = int(body[at:line].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        if len(body) < line + 4 + size or body[line + 2 + size : line + 4 + size] != b"\r\n":
            raise ValueError("broken chunk")
        out.append(body[line + 2 : line + 2 + size])
        at = line + 4 + size


def payload_of(block: bytes) -> bytes:
    """The payload of an HTTP message."""
    head, _, body = block.partition(b"\r\n\r\n")
    return dechunked(body) if re.search(rb"(?im)^transfer-encoding:\s*chunked\s*$", head.replace(b"\r\n", b"\n")) else body


def record(kind: str, headers: dict[str, object], block: bytes) -> bytes:
    head = {"WARC-Type": kind, "WARC-Date": DATE} | headers | {"Content-Length": len(block)}
    text = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head.items()) + "\r\n"
    return gzip.compress(text.encode() + block + b"\r\n\r\n", 1, mtime=0)


def page_records(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, segment_bytes: int, place: str) -> Iterator[bytes]:
    """digest and refers_to say what the page's record is; place is of this record alone."""
    own = {"WARC-Record-ID": record_uri(place, 1), "WARC-Target-URI": re.sub(r"[\r\n]", " ", url or "urn:none"), "WARC-Payload-Digest": f"sha256:{digest}", "X-Payload-Length": len(payload), "Content-Type": "application/http; msgtype=response"}
    if page_id is not None:
        own["X-Page-ID"] = page_id
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers_to is not None:
        more = {"X-Refers-To-Page": refers_to, "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        yield record("revisit", own | more, head + b"\r\n")
        return
    block = head + b"Transfer-Encoding: chunked\r\n\r\n" + chunked(payload)
    parts = [block[i : i + segment_bytes] for i in range(0, len(block), segment_bytes)]
    if len(parts) == 1:
        yield record("response", own, block)
        return
    yield record("response", own | {"WARC-Segment-Number": 1}, parts[0])
    for k, part in enumerate(parts[1:], 2):
        last = {"WARC-Segment-Total-Length": len(block)} if k == len(parts) else {}
        yield record("continuation", {"WARC-Record-ID": record_uri(place, k), "WARC-Segment-Origin-ID": own["WARC-Record-ID"], "WARC-Segment-Number": k, "WARC-Target-URI": own["WARC-Target-URI"]} | last, part)


def read_records(file: BinaryIO) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (names in lower case) and block of each record, one in memory at a time."""
    with gzip.GzipFile(fileobj=file) as f:
        while line := f.readline():
            if not line.strip():
                continue
            if not line.startswith(b"WARC/"):
                raise ValueError(f"no WARC record: {line[:40]!r}")
            headers = {}
            while (line := f.readline()).strip():
                k, _, v = line.decode().partition(":")
                headers[k.strip().lower()] = v.strip()
            block = f.read(n := int(headers["content-length"]))
            if len(block) != n:
                raise ValueError("record cut short")
            yield headers, block


# ---------------------------------------------------------------- Spark


def write_warc(pages: DataFrame, folder: str | None = None, segment_bytes: int = SEGMENT_BYTES, dedupe_bytes: int = DEDUPE_BYTES) -> DataFrame:
    """Write pages(page_id, url, html, ...) as one archive for each task; returns (path, records) of the committed ones.

    Only digests, sizes and ids are shuffled to find the first page of each payload."""
    folder = folder or shared_dir(pages.sparkSession, "warc")
    html = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select("page_id", "url", "html", F.sha2(html, 256).alias("digest"))
    large = rows.where(F.octet_length(F.coalesce("html", F.lit(""))) >= dedupe_bytes)
    # Only digests that several pages share matter, so an archive without copies joins with nothing.
    first = large.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1").select("digest", "first_id")
    revisits = large.select("page_id", "digest").join(first, "digest").where("page_id <> first_id").groupBy("page_id", "digest").agg(F.min("first_id").alias("refers_to"))
    marked = rows.join(revisits, ["page_id", "digest"], "left").select("page_id", "url", "html", "digest", "refers_to")

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sink, path, n = None, "", 0
        for run in runs(batches, "html"):
            for page_id, url, text, digest, refers_to in zip(*(c.to_pylist() for c in run.rows.columns), strict=True):
                if sink is None:
                    fs, root = pafs.FileSystem.from_uri(folder)
                    fs.create_dir(root, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    sink, path = fs.open_output_stream(f"{root}/{name}", compression=None), f"{folder}/{name}"
                    sink.write(record("warcinfo", {"WARC-Record-ID": f"<urn:uuid:{uuid.uuid4()}>", "Content-Type": "application/warc-fields"}, b"format: WARC File Format 1.1\r\n"))
                for part in page_records(page_id, url, (text or "").encode(), digest, refers_to, segment_bytes, f"{path}/{n}"):
                    sink.write(part)
                    n += 1
        if sink is not None:
            sink.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "records": [n]})

    return materialise(marked.mapInArrow(write, "path string, records long"), "warc-manifest")


PAGE = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
PART = f"{PAGE}, origin string, segment int, total long"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary()}


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _TYPES[t]) for c, (_, t) in zip(zip(*rows, strict=True), fields, strict=True)], names=[n for n, _ in fields])


def checked(page_id: int | None, digest: str, length: int, block: bytes) -> bytes:
    payload = payload_of(block)
    if len(payload) != length or hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"page {page_id}: the payload doesn't match its digest and length")
    return payload


def read_warc(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """Read the archives of manifest(path, ...): a row for each page, with its payload if asked for (null in revisits)."""
    tasks = max(1, int(manifest.sparkSession.conf.get("spark.sql.shuffle.partitions")))

    def scan(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lambda x: None if x is None else int(x)
        for batch in batches:
            for uri in batch.column(0).to_pylist():
                fs, path = pafs.FileSystem.from_uri(uri)
                rows, held = [], 0
                with fs.open_input_stream(path, compression=None) as file:
                    for h, block in read_records(file):
                        kind, segment = h["warc-type"], number(h.get("warc-segment-number"))
                        if kind not in ("response", "revisit", "continuation"):
                            continue
                        page_id, digest, length = number(h.get("x-page-id")), h.get("warc-payload-digest", "").partition(":")[2] or None, number(h.get("x-payload-length"))
                        if kind == "revisit":
                            data = None
                        elif segment is None:
                            data = checked(page_id, digest, length, block)
                            data = data if keep_payload else None
                        else:
                            data = block
                        rows.append((page_id, length, digest, kind, number(h.get("x-refers-to-page")), data, h.get("warc-segment-origin-id") or h["warc-record-id"], segment or 0, number(h.get("warc-segment-total-length"))))
                        held += 300 + len(data or b"")
                        if held > 4_000_000:
                            yield _batch(rows, PART)
                            rows, held = [], 0
                if rows:
                    yield _batch(rows, PART)

    def reassemble(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, held = [], 0
            for record_parts in batch.column(1):
                parts = sorted(record_parts.as_py(), key=lambda p: p["segment"])
                first = parts[0]
                payload = first["payload"]
                if first["segment"]:
                    block = b"".join(p["payload"] for p in parts)
                    if [p["segment"] for p in parts] != list(range(1, len(parts) + 1)) or parts[-1]["total"] != len(block):
                        raise ValueError(f"segments of page {first['page_id']} are missing or of wrong length")
                    payload = checked(first["page_id"], first["payload_digest"], first["payload_bytes"], block)
                    payload = payload if keep_payload else None
                out.append((*(first[k] for k in ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")), payload))
                held += len(payload or b"")
                if held > 4_000_000:
                    yield _batch(out, PAGE)
                    out, held = [], 0
            if out:
                yield _batch(out, PAGE)

    records = manifest.select("path").repartition(tasks).mapInArrow(scan, PART)
    columns = [f.split()[0] for f in PART.split(", ") if not f.startswith("origin")]
    # A group is one page's record: its size is the page's.
    pages = records.groupBy("origin").agg(F.collect_list(F.struct(*columns)).alias("parts")).mapInArrow(reassemble, PAGE)
    return pages if keep_payload else pages.drop("payload")
