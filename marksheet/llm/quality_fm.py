"""Document quality by a factorisation machine.

score = sigmoid(b + sum w_f x_f + sum over f < g of <v_f, v_g> x_f x_g), over hashed words, statistics of structure
and sizes. The pairwise sum is taken in linear time: half of (sum v_f x_f)^2 - sum v_f^2 x_f^2, for each factor.

Defined results: null and empty texts are scored by their (zero) statistics; without a row to learn from every score
is 0.5; labels that are null or contradict each other for a document aren't learned from; repeated rows give equal
results; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbuf import Run, runs, shingle_hashes, word_hashes, words

BUCKETS, FACTORS = 4096, 8
#: Bound of the sample that is learned from: documents of each label.
SAMPLE_PER_LABEL = 1500

_CLASSES = np.zeros((7, 256), np.int64)
_CLASSES[0, 65:91] = 1  # capitals
_CLASSES[1, 48:58] = 1  # digits
_CLASSES[2, list(b"#$%&*|@^~=+<>{}[]\\_`")] = 1  # symbols
_CLASSES[3, list(b".,;:?'\"()-")] = 1  # punctuation of sentences
_CLASSES[4, list(b"!")] = 1
_CLASSES[5, list(b"\n")] = 1
_CLASSES[6, 128:] = 1  # beyond ASCII
N_STATS = 16


def statistics(run: Run) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(texts, N_STATS) of structure; word buckets; each text's first word."""
    n = run.rows.num_rows
    size = np.diff(run.offsets)
    w = words(run.data, run.offsets)
    h = word_hashes(run.data, w)
    n_words = np.diff(w.first)
    out = np.zeros((n, N_STATS))
    for k in range(7):
        total = np.append(0, np.cumsum(_CLASSES[k][run.data]))
        out[:, k] = (total[run.offsets[1:]] - total[run.offsets[:-1]]) / np.maximum(size, 1)
    out[:, 7], out[:, 8] = np.log1p(n_words), np.log1p(size)
    out[:, 9] = size / np.maximum(n_words, 1)
    three, begin = shingle_hashes(h, w.first, 3)
    length = w.end - w.start
    for k, (a, b, c, d) in enumerate(zip(w.first[:-1].tolist(), w.first[1:].tolist(), begin[:-1].tolist(), begin[1:].tolist(), strict=True)):
        if b > a:
            _, counts = np.unique(h[a:b], return_counts=True)
            out[k, 10] = len(counts) / (b - a)
            out[k, 11] = counts.max() / (b - a)
            own = np.sort(three[c:d])
            out[k, 12] = 1 - (1 + np.count_nonzero(own[1:] != own[:-1])) / (d - c)
            out[k, 13] = min(length[a:b].max(), 200)
            out[k, 14] = (length[a:b] <= 2).mean()
    out[:, 15] = n_words == 0
    return out, (h >> np.uint64(52)).astype(np.int64), w.first


class Model:
    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> None:
        self.bias, self.w, self.v, self.mean, self.scale = bias, w, v, mean, scale

    def scores(self, run: Run) -> np.ndarray:
        stats, bucket, first = statistics(run)
        dense = np.clip((stats - self.mean) / self.scale, -5, 5)
        linear = self.bias + dense @ self.w[BUCKETS:]
        total = dense @ self.v[BUCKETS:]
        squares = dense**2 @ self.v[BUCKETS:] ** 2
        square_of = self.v**2
        for k, (a, b) in enumerate(itertools.pairwise(first.tolist())):
            if b > a:
                count = np.bincount(bucket[a:b], minlength=BUCKETS)
                own = np.flatnonzero(count)
                x = count[own] / np.sqrt(float((count[own] ** 2).sum()))
                linear[k] += x @ self.w[own]
                total[k] += x @ self.v[own]
                squares[k] += x**2 @ square_of[own]
        z = linear + 0.5 * (total**2 - squares).sum(1)
        return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def fit(texts: list[str], labels: list[int], epochs: int = 12, seed: int = 5) -> Model | None:
    """Minibatch Adam on the logistic loss; both labels weigh the same."""
    y = np.array(labels, float)
    if not len(y):
        return None
    batch = pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())})
    dense, sparse = [], []
    for run in runs([batch], "text"):
        stats, bucket, first = statistics(run)
        dense.append(stats)
        for a, b in itertools.pairwise(first.tolist()):
            count = np.bincount(bucket[a:b], minlength=BUCKETS).astype(np.float32)
            sparse.append(count / max(1e-9, float(np.sqrt(count @ count))))
    stats = np.vstack(dense)
    mean, scale = stats.mean(0), stats.std(0) + 1e-3
    x = np.hstack([np.array(sparse, np.float32), np.clip((stats - mean) / scale, -5, 5).astype(np.float32)])
    rng = np.random.default_rng(seed)
    w = np.zeros(x.shape[1], np.float32)
    v = rng.normal(0, 0.02, (x.shape[1], FACTORS)).astype(np.float32)
    bias = np.zeros(1, np.float32)
    weight = np.where(y == 1, 0.5 / max(1, (y == 1).sum()), 0.5 / max(1, (y == 0).sum())) * len(y)
    state = [[np.zeros_like(p), np.zeros_like(p)] for p in (bias, w, v)]
    t = 0
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for at in range(0, len(y), 128):
            part = order[at : at + 128]
            xb = x[part]
            xv = xb @ v
            z = bias[0] + xb @ w + 0.5 * (xv**2 - xb**2 @ v**2).sum(1)
            e = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[part]) * weight[part] / len(part)).astype(np.float32)
            grads = [np.array([e.sum()], np.float32), xb.T @ e + 1e-4 * w, xb.T @ (e[:, None] * xv) - v * ((xb**2).T @ e)[:, None] + 1e-3 * v]
            t += 1
            for p, g, s in zip((bias, w, v), grads, state, strict=True):
                s[0] = 0.9 * s[0] + 0.1 * g
                s[1] = 0.99 * s[1] + 0.01 * g * g
                p -= 0.02 * (s[0] / (1 - 0.9**t)) / (np.sqrt(s[1] / (1 - 0.99**t)) + 1e-8)
    return Model(float(bias[0]), w.astype(float), v.astype(float), mean, scale)


def held_out(doc_id: str = "doc_id") -> Column:
    """Never learned from: crc32 of the id as text leaves 1 when divided by 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_on(docs: DataFrame, labels: DataFrame, per_label: int = SAMPLE_PER_LABEL) -> Model | None:
    """Learns from at most per_label labelled documents of each label, taken by the hash of their ids; of texts
    that repeat an id, the smallest counts."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("other")).where("quality = other and quality in (0, 1)")
    usable = one.where(~held_out()).select("doc_id", "quality")
    here = docs.where("text is not null").select("doc_id").distinct()
    usable = usable.join(here, "doc_id", "left_semi")
    pick = lambda q: usable.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_label)
    ids = pick(0).unionByName(pick(1))
    rows = docs.select("doc_id", "text").where("text is not null").join(F.broadcast(ids), "doc_id").groupBy("doc_id").agg(F.min("quality").alias("quality"), F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [int(r.quality) for r in rows])


def score(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, score, predicted); one pass, no shuffle."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "text"):
            got = model.scores(run) if model else np.full(run.rows.num_rows, 0.5)
            yield pa.RecordBatch.from_arrays([run.rows.column(0), pa.array(got), pa.array((got >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, score double, predicted int")


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Learns from the labelled part and scores all: (doc_id, held_out, score, predicted)."""
    return score(docs, fit_on(docs, labels)).withColumn("held_out", held_out())


def keep_good(docs: DataFrame, model: Model | None) -> DataFrame:
    """The rows of docs, all columns, that are predicted as good; all of them if there was nothing to learn from."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "text"):
            yield run.rows.filter(pa.array(model.scores(run) >= 0.5)) if model else run.rows

    return docs.mapInArrow(work, docs.schema)
