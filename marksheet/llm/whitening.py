"""Embedding whitening by hierarchical merging of singular value decompositions.

A part of the vectors is kept as its number, its sums and, of its vectors less their mean, all singular values times right
singular vectors (as many as there are dimensions). Two parts merge by stacking both and one row more,
sqrt(n m / (n + m)) (mean - mean'), and decomposing again: nothing is cut off, so the order of merging doesn't matter but
for rounding. Tasks fold their rows batch by batch, then a tree of merges, FANIN parts at a time, gives the whole; what a
task holds is one batch and one square of the dimensions.

Vectors are counted as whole numbers, x = floor(SCALE c) + SHIFT, and sums are exact, so a mean is subtracted without
rounding as (n x - S) / n. The fit is over each distinct x once; every row is whitened.

Defined results: rows whose vector is null or empty, holds null or non-finite entries or one whose x passes 2^53, or has
another length than most (of two lengths as frequent, the smaller counts) are left out; a null vec_id and rows that repeat
one are rows like any other; where the fit has no variance left for a component (an eigenvalue below NOTHING of the
trace), whitened is null; a deviation beyond 64 bits is null; no rows give none; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import materialise

SCALE, SHIFT, COMPONENTS = 64, 1_000_000, 16
#: Parts that one task of the tree merges, and rows that are decomposed at once.
FANIN, ROWS = 8, 4_096
#: Share of the trace below which an eigenvalue is rounding.
NOTHING = 1e-13


class Part(NamedTuple):
    n: int
    sums: list[int]  # of x - SHIFT, exact
    root: np.ndarray  # singular values times right singular vectors of the centred rows, dims x dims


def _compact(rows: np.ndarray, dims: int) -> np.ndarray:
    """The matrix of the same covariance with as many rows as dimensions."""
    _, s, vt = np.linalg.svd(rows, full_matrices=False)
    return np.vstack([s[:, None] * vt, np.zeros((dims - len(s), dims))])


def part_of(y: np.ndarray) -> Part:
    """Of rows of x - SHIFT."""
    n, dims = y.shape
    sums = [int(v) for v in y.sum(0)]
    return Part(n, sums, _compact(_centred(y, n, sums), dims))


def _centred(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """(n y - S) / n, with the numerator exact."""
    return _numerator(y, n, sums).astype(np.float64) / n


def _numerator(y: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n y - S: 64 bits where they do, else whole numbers of any size."""
    if n * (int(np.abs(y).max(initial=0)) + 1) < 2**62:
        return n * y - np.array(sums, np.int64)
    return n * y.astype(object) - np.array(sums, object)


def merge(a: Part, b: Part) -> Part:
    n = a.n + b.n
    # (mean - mean') sqrt(n m / (n + m)), from whole numbers: (m S - n S') / (n m) times that root.
    apart = np.array([float(b.n * s - a.n * t) for s, t in zip(a.sums, b.sums, strict=True)])
    row = apart / (float(a.n) * b.n) * np.sqrt(float(a.n) * b.n / n)
    return Part(n, [s + t for s, t in zip(a.sums, b.sums, strict=True)], _compact(np.vstack([a.root, b.root, row]), a.root.shape[1]))


class Whitening(NamedTuple):
    n: int
    sums: list[int]  # of x - SHIFT
    components: np.ndarray  # a row each, by falling eigenvalue
    eigenvalues: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def transform(self, y: np.ndarray) -> np.ndarray:
        """Whitened rows; NaN where nothing is left to divide by."""
        root = np.where(self.explained > NOTHING, np.sqrt(np.maximum(self.eigenvalues, 0)), np.nan)
        return _centred(y, self.n, self.sums) @ self.components.T / root

    def deviation(self, y: np.ndarray) -> list[int | None]:
        """sum of (n x - S)^2, exact; None beyond 64 bits."""
        top = self.n * (int(np.abs(y).max(initial=0)) + 1) + max(map(abs, self.sums), default=0)
        d = _numerator(y, self.n, self.sums)
        d = d if top**2 * y.shape[1] < 2**63 else d.astype(object)
        return [int(v) if v < 2**63 else None for v in (d * d).sum(1)]


def whitening_of(whole: Part, components: int = COMPONENTS) -> Whitening:
    _, s, vt = np.linalg.svd(whole.root)
    e = s**2 / whole.n
    total = e.sum()
    k = min(components, len(e))
    return Whitening(whole.n, whole.sums, vt[:k], e[:k], e[:k] / total if total else np.zeros(k))


# ---------------------------------------------------------------- Spark


def _rows(batch: pa.RecordBatch, dims: int) -> np.ndarray:
    return batch.column(batch.schema.get_field_index("x")).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _fold(batches: Iterable[pa.RecordBatch], dims: int, part: Callable[[np.ndarray], Part]) -> Part | None:
    whole = None
    for batch in batches:
        for i in range(0, batch.num_rows, ROWS):
            new = part(_rows(batch.slice(i, ROWS), dims))
            whole = merge(whole, new) if whole else new
    return whole


PART = "slot int, n long, sums array<string>, root binary"


def _row(slot: int, p: Part) -> pa.Table:
    return pa.table({"slot": pa.array([slot], pa.int32()), "n": pa.array([p.n], pa.int64()), "sums": pa.array([[str(s) for s in p.sums]]), "root": pa.array([p.root.tobytes()], pa.binary())})


def _parts(rows: pa.Table | pa.RecordBatch) -> list[Part]:
    out = []
    for r in rows.to_pylist():
        sums = [int(s) for s in r["sums"]]
        out.append(Part(r["n"], sums, np.frombuffer(r["root"], np.float64).reshape(len(sums), -1)))
    return out


def _merged(parts: list[Part]) -> Part:
    whole = parts[0]
    for p in parts[1:]:
        whole = merge(whole, p)
    return whole


def merged_parts(x: DataFrame, dims: int) -> Part:
    """x(x array<long>) of vectors of one length to the part of them all."""

    def fold(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = _fold(batches, dims, part_of)
        if whole:
            yield from _row(TaskContext.get().partitionId(), whole).to_batches()

    level = materialise(x.mapInArrow(fold, PART), "svd-parts")
    while level.count() > FANIN:
        # Slots are numbered anew, so each group has FANIN of them at most.
        numbered = level.select((F.col("slot") / FANIN).cast("int").alias("slot"), "n", "sums", "root")
        level = materialise(numbered.groupBy("slot").applyInArrow(lambda t: _row(t["slot"][0].as_py(), _merged(_parts(t))), PART), "svd-parts")
    return _merged(_parts(level.orderBy("slot").toArrow()))


def identity_error(x: DataFrame, dims: int, model: Whitening) -> float:
    """Largest entry of the whitened fit's covariance less the identity, over the components that are whitened."""
    live = np.flatnonzero(model.explained > NOTHING)

    def gram(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, sums = np.zeros((len(live), len(live))), np.zeros(len(live))
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                z = model.transform(_rows(batch.slice(i, ROWS), dims))[:, live]
                total += z.T @ z
                sums += z.sum(0)
        yield pa.RecordBatch.from_pydict({"place": pa.array(np.arange(total.size + len(live)), pa.int32()), "value": np.append(total.ravel(), sums)})

    if not len(live):
        return 0.0
    # Rows already have the mean subtracted; what rounding left of it is taken out of the sums of squares.
    values = np.array([r.value for r in x.mapInArrow(gram, "place int, value double").groupBy("place").agg(F.sum("value").alias("value")).orderBy("place").collect()])
    mean = values[len(live) ** 2 :] / model.n
    return float(np.abs(values[: len(live) ** 2].reshape(len(live), -1) / model.n - np.outer(mean, mean) - np.eye(len(live))).max())


def usable(embedding: Column) -> Column:
    return embedding.isNotNull() & (F.size(embedding) > 0) & F.forall(embedding, lambda c: c.isNotNull() & (F.abs(c.cast("double") * SCALE) < 2.0**53))


def quantised(embedding: Column) -> Column:
    """x - SHIFT of each entry."""
    return F.transform(embedding, lambda c: F.floor(c.cast("double") * SCALE))


def fit(x: DataFrame, dims: int, components: int = COMPONENTS) -> Whitening:
    """x(x array<long>), one row for each distinct vector."""
    model = whitening_of(merged_parts(x, dims), components)
    return model._replace(identity_error=identity_error(x, dims, model))


WHITENED = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"


def apply(rows: DataFrame, dims: int, model: Whitening) -> DataFrame:
    """rows(vec_id, x) to a row for each of them and each component."""
    k = len(model.components)

    def whiten(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS):
                some = batch.slice(i, ROWS)
                y = _rows(some, dims)
                z, m = model.transform(y).ravel(), len(y)
                yield pa.RecordBatch.from_arrays(
                    [
                        some.column(0).take(pa.array(np.repeat(np.arange(m), k))), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, model.n)),
                        pa.array(model.deviation(y), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))), pa.array(z, mask=np.isnan(z)), pa.array(np.tile(model.explained, m)), pa.array(np.full(m * k, model.identity_error)),
                    ],
                    names=[f.split()[0] for f in WHITENED.split(", ")],
                )

    return rows.select("vec_id", "x").mapInArrow(whiten, WHITENED)


def whiten_embeddings(vectors: DataFrame, components: int = COMPONENTS) -> DataFrame:
    """vectors(vec_id, embedding, ...) to WHITENED."""
    rows = vectors.select("vec_id", F.col("embedding")).where(usable(F.col("embedding")))
    sizes = rows.groupBy(F.size("embedding").alias("dims")).count().orderBy(F.desc("count"), "dims").limit(1).collect()
    if not sizes:
        return vectors.sparkSession.createDataFrame([], WHITENED)
    dims = sizes[0].dims
    rows = rows.where(F.size("embedding") == dims).select("vec_id", quantised(F.col("embedding")).alias("x"))
    # Copies meet in the map-side part of the aggregation, so a vector that many rows share is shuffled once a task.
    distinct = materialise(rows.select("x").distinct(), "distinct-vectors")
    return apply(rows, dims, fit(distinct, dims, components))
