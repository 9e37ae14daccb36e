"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its LENGTH nearest pivots and posted in the inverted files of the first POSTS
of them. A query visits the files of its first VISITS pivots. What is posted there is ranked by the footrule
distance of the orders, over all visited files together: a vector counts in the first visited file that it is posted
in, and those within the query's cut are ranked by the inner product. The cut is the distance within which about
RERANK of the vectors lie, read off a bounded sample. Large inner products are made near neighbours by one more
coordinate, so norms may differ. Files with many entries or queries are cut into blocks, each pair of blocks a task's
group; all entries stay.

Bounded samples, taken by the hash of the ids: the pivots, about twice the square root of the number of vectors and
MAX_PIVOTS at most, and CUT_SAMPLE vectors for the cuts. Every vector is indexed.

Defined results: vectors that are null, empty, zero, of another length than most, or that hold null or non-finite
components take no part, nor do rows without vec_id; of rows that repeat a vec_id, the one with the smallest vector
counts; ties go to the smaller vec_id; equal vectors are indexed once and expanded at the end; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise

LENGTH, POSTS, VISITS = 64, 8, 32
PIVOTS, MAX_PIVOTS, CUT_SAMPLE = 2.0, 32_768, 4_096
#: How many of n vectors a query ranks by the inner product: RERANK[0] * n ** RERANK[1].
RERANK = (5.5, 0.6)
#: A file is cut into blocks of about so many entries and queries.
BLOCK_ENTRIES, BLOCK_QUERIES = 16_384, 2_048


def _matrix(column: pa.ChunkedArray, kind: str, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(-1, width)


def _lift(x: np.ndarray, top: float) -> np.ndarray:
    """One more coordinate, so that all lie on a sphere of radius top."""
    x = x.astype(np.float64)
    return np.hstack([x, np.sqrt(np.maximum(top**2 - (x**2).sum(1), 0))[:, None]])


def orders(x: np.ndarray, pivots: np.ndarray, length: int) -> np.ndarray:
    """The nearest pivots of each row, nearest first; ties to the smaller number."""
    rows = max(1, 4_000_000 // len(pivots))
    parts = [np.argsort(-(x[i : i + rows] @ pivots.T), axis=1, kind="stable")[:, :length] for i in range(0, len(x), rows)]
    return np.concatenate(parts).astype(np.uint16) if parts else np.zeros((0, length), np.uint16)


class Footrule:
    """How near orders are to that of a query: length less the greater of both places, summed over common pivots. Twice
    this and the footrule distance (absent pivots at place length) have one sum for all orders."""

    def __init__(self, n_pivots: int, length: int) -> None:
        place = np.arange(length)
        self.gain = (length - np.maximum(place[:, None], place)).astype(np.int16)
        self.table, self.place, self.length = np.zeros((n_pivots, length), np.int16), np.full(n_pivots, length, np.int16), length  # place: absent ones are last
        self.order: np.ndarray | None = None

    def cells(self, perm: np.ndarray) -> np.ndarray:
        """Where in the table each place of each order is."""
        return perm.astype(np.int32) * np.int32(self.length) + np.arange(self.length, dtype=np.int32)

    def ask(self, order: np.ndarray) -> None:
        if self.order is not None:
            self.table[self.order], self.place[self.order] = 0, self.length
        self.order = order
        self.table[order], self.place[order] = self.gain, np.arange(self.length)

    def near(self, cells: np.ndarray) -> np.ndarray:
        return self.table.ravel()[cells].sum(1, dtype=np.int32)


def usable(embedding: Column) -> Column:
    ok = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return embedding.isNotNull() & ok & F.exists(embedding, lambda x: x != 0)


def inner_product(a: Column, b: Column) -> Column:
    """In double precision, summed in the order of the components."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def search(vectors: DataFrame, is_query: Column, k: int = 20) -> DataFrame:
    """vectors(vec_id, embedding array<float>, ...) to (query_id, rank, vec_id, score) for the rows where is_query."""
    spark = vectors.sparkSession
    rows = vectors.where(F.col("vec_id").isNotNull()).select("vec_id", F.col("embedding").cast("array<float>").alias("embedding")).where(usable(F.col("embedding")))
    dims = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").limit(1).collect()
    if not dims:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    dim = dims[0].dim
    rows = rows.where(F.size("embedding") == dim).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    key = F.struct(F.xxhash64("embedding").alias("a"), F.xxhash64(F.lit(7), "embedding").alias("b"))
    rows = materialise(rows.select("vec_id", "embedding", key.alias("key"), is_query.alias("is_query")), "vectors")
    classes = rows.groupBy("key").agg(F.min("vec_id").alias("rep"))
    distinct = materialise(rows.select(F.col("vec_id").alias("rep"), "embedding").join(classes.select("rep"), "rep", "left_semi"), "distinct-vectors")
    # Of equal vectors, the first k + 1 ids can be among anyone's k nearest.
    nth = F.row_number().over(Window.partitionBy("key").orderBy("vec_id"))
    copies = rows.select("key", "vec_id").withColumn("nth", nth).where(F.col("nth") <= k + 1).join(classes, "key").select("rep", "vec_id")
    asked = materialise(rows.where("is_query").select("key", F.col("vec_id").alias("query_id")).join(classes, "key").select("rep", "query_id"), "queries")

    n, top = distinct.agg(F.count("*"), F.max(inner_product(F.col("embedding"), F.col("embedding")))).first()
    top = float(np.sqrt(top))
    n_pivots = int(min(MAX_PIVOTS, max(8, PIVOTS * np.sqrt(n)), n))
    sample = distinct.orderBy(F.xxhash64("rep"), "rep").limit(n_pivots + CUT_SAMPLE).collect()
    sample = _lift(np.array([r.embedding for r in sample], np.float32), top)
    pivots, sample = sample[:n_pivots], sample[-CUT_SAMPLE:]
    length = min(LENGTH, n_pivots)
    sampled = orders(sample, pivots, length)
    # The place of the cut among the sample, from the nearest on.
    place = int(np.ceil(RERANK[0] * n ** RERANK[1] * len(sample) / n))

    def represent(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rule = Footrule(n_pivots, length)
        cells = rule.cells(sampled)
        for batch in batches:
            if batch.num_rows:
                flat = batch.column(1).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
                query = batch.column(2).to_numpy(zero_copy_only=False)
                lifted = _lift(flat, top)
                lifted[query, -1] = 0
                order = orders(lifted, pivots, length)
                cut = np.zeros(len(order), np.int32)
                for i in np.flatnonzero(query) if place < len(cells) else ():
                    rule.ask(order[i])
                    cut[i] = -np.partition(-rule.near(cells), place)[place]
                files = order[:, : VISITS if query.all() else POSTS].astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(files) + 1, dtype=np.int32) * files.shape[1]), pa.array(files.ravel()))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([v.tobytes() for v in flat], pa.binary()), pa.array([o.tobytes() for o in order], pa.binary()), pa.array(cut), lists], names=["id", "vec", "perm", "cut", "files"])

    kind = "id long, vec binary, perm binary, cut int, files array<int>"
    entries = materialise(distinct.select("rep", "embedding", F.lit(False).alias("q")).mapInArrow(represent, kind), "inverted-files")
    queries = distinct.join(asked.select("rep").distinct(), "rep", "left_semi").select("rep", "embedding", F.lit(True).alias("q"))
    queries = materialise(queries.mapInArrow(represent, kind), "visits")
    posts, visits = (d.select("id", "vec", "perm", "cut", F.explode("files").alias("file")) for d in (entries, queries))
    # A row for each pivot, MAX_PIVOTS at most: how many blocks its file is cut into.
    count = lambda d, size, name: F.broadcast(d.select(F.explode("files").alias("file")).groupBy("file").agg(F.ceil(F.count("*") / size).cast("int").alias(name)))
    blocks, calls = count(entries, BLOCK_ENTRIES, "eb"), count(queries, BLOCK_QUERIES, "qb")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    one = lambda n: F.pmod(F.xxhash64("id"), n).cast("int")
    left = posts.join(blocks, "file").join(calls, "file").select("file", one("eb").alias("e"), every("qb").alias("b"), "id", "vec", "perm")
    right = visits.join(blocks, "file").join(calls, "file").select("file", every("eb").alias("e"), one("qb").alias("b"), "id", "vec", "perm", "cut")

    def match(data: pa.Table, ask: pa.Table) -> pa.Table:
        out_q, out_v, out_s = [], [], []
        if data.num_rows and ask.num_rows:
            ids, x, perm = data["id"].to_numpy(), _matrix(data["vec"], np.float32, dim), _matrix(data["perm"], np.uint16, length)
            rule, file, home = Footrule(n_pivots, length), ask["file"][0].as_py(), perm[:, :POSTS]
            cells = rule.cells(perm)
            for q, vec, order, cut in zip(ask["id"].to_pylist(), _matrix(ask["vec"], np.float32, dim).astype(np.float64), _matrix(ask["perm"], np.uint16, length), ask["cut"].to_pylist(), strict=True):
                rule.ask(order)
                mine = np.flatnonzero(rule.place[home].min(1) == rule.place[file])
                near = mine[rule.near(cells[mine]) >= cut]
                score = x[near].astype(np.float64) @ vec
                if len(score) > k + 1:  # ties of the last that counts stay
                    fine = score >= np.partition(score, len(score) - k - 1)[len(score) - k - 1]
                    near, score = near[fine], score[fine]
                out_q.append(np.full(len(near), q, np.int64))
                out_v.append(ids[near])
                out_s.append(score)
        none = np.zeros(0)
        return pa.table({n: pa.array(np.concatenate(x) if x else none, t) for n, x, t in (("q", out_q, pa.int64()), ("v", out_v, pa.int64()), ("score", out_s, pa.float64()))})

    keys = ["file", "e", "b"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(match, "q long, v long, score double")
    nearest = lambda key, id: F.row_number().over(Window.partitionBy(key).orderBy(F.desc("score"), id))
    found = found.withColumn("r", nearest("q", "v")).where(F.col("r") <= k + 1).select("q", "v")
    # The score is worked out once for each pair that is left, on the vectors as they came.
    ends = distinct.select(F.col("rep").alias("v"), F.col("embedding").alias("to"))
    found = found.join(ends, "v").join(distinct.select(F.col("rep").alias("q"), F.col("embedding").alias("of")), "q")
    found = found.select("q", "v", inner_product(F.col("of"), F.col("to")).alias("score"))
    # From distinct vectors to rows; the query itself is left out.
    wide = found.join(copies.withColumnRenamed("rep", "v"), "v").withColumn("r", nearest("q", "vec_id")).where(F.col("r") <= k + 1)
    named = wide.join(asked.withColumnRenamed("rep", "q"), "q").where("vec_id <> query_id")
    return named.withColumn("rank", nearest("query_id", "vec_id").cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
