"""Language identification by error-correcting output codes.

Each language has a codeword of bits; a binary classifier over hashed byte n-grams predicts each bit. Decoding takes
the language whose codeword has the smallest loss, the bits weighted by how well their classifiers did in training;
a small gap to the second marks the prediction as ambiguous.

Defined results: a null text and one without a letter give "und" with score 0; so does every text if there is no
row to learn from. Rows with null lang aren't learned from. With one language learned, it is always predicted, with
score 1. Repeated rows give equal results; columns other than doc_id, text and lang are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .textbuf import Run, runs

BUCKETS = 4096
#: Bounds of the sample that is learned from: documents of a language, documents and bytes of all. Every language that is
#: labelled has one document at least.
SAMPLE_PER_LANG, SAMPLE_DOCS, SAMPLE_BYTES = 250, 16_000, 64_000_000
#: Counts of up to so many languages go to every task; more are joined by shuffling.
MAX_BROADCAST = 100_000
UND = "und"
AMBIGUOUS_GAP = 0.05

#: Letters count in lower case; all other ASCII bytes as a space.
_FOLD = np.arange(256, dtype=np.uint32)
_FOLD[:128] = 32
_FOLD[97:123] = np.arange(97, 123)
_FOLD[65:91] = np.arange(97, 123)
#: In UTF-8, capitals with accents differ from small ones in the second byte: C3 80-9E and C3 A0-BE.
_IS_ASCII_LETTER = (_FOLD != 32) & (np.arange(256) < 128)


def hashed_ngrams(data: np.ndarray) -> np.ndarray:
    """A bucket for the 2-gram and the 3-gram at each byte: shape (2, len)."""
    b = _FOLD[data]
    capital = np.zeros(len(b), bool)
    if len(b) > 1:
        capital[1:] = (b[:-1] == 0xC3) & (b[1:] >= 0x80) & (b[1:] < 0x9F)
    b = b + np.where(capital, np.uint32(0x20), np.uint32(0))
    out = np.zeros((2, len(b)), np.int64)
    two = b[:-1] * np.uint32(257) + b[1:]
    out[0, : len(two)] = (two * np.uint32(2654435761)) >> np.uint32(20)
    three = two[:-1] + b[2:] * np.uint32(66049) + np.uint32(77)
    out[1, : len(three)] = (three * np.uint32(2246822519)) >> np.uint32(20)
    return out


def vectors(run: Run) -> Iterator[np.ndarray]:
    """Square roots of n-gram counts, scaled to length one, for each text of the run."""
    grams = hashed_ngrams(run.data)
    for a, b in itertools.pairwise(run.offsets.tolist()):
        x = np.bincount(grams[0, a : max(a, b - 1)], minlength=BUCKETS) + np.bincount(grams[1, a : max(a, b - 2)], minlength=BUCKETS)
        x = np.sqrt(x, dtype=np.float32)
        yield x / max(1e-9, float(np.sqrt(x @ x)))


def codewords(n: int) -> np.ndarray:
    """(n, bits) of -1 and 1: all ways to split up to 7 languages, beyond that random splits from a fixed seed."""
    if n <= 7:
        rows = [[1] * (2 ** (n - 1) - 1)] + [[1 if (c >> r) & 1 else -1 for c in range(2 ** (n - 1) - 1)] for r in range(n - 1)]
        return np.array(rows, np.float32).reshape(n, -1)
    rng = np.random.default_rng(11)
    best, gap = None, -1
    for _ in range(min(200, max(3, 8_000_000 // n**2))):
        code = rng.choice([-1.0, 1.0], (n, int(np.ceil(10 * np.log2(n))))).astype(np.float32)
        alike = code @ code.T - 2 * code.shape[1] * np.eye(n, dtype=np.float32)
        least = int((code.shape[1] - alike.max()) // 2)
        if least > gap and (np.abs(code.sum(0)) < n).all():
            best, gap = code, least
    return best


class Model:
    def __init__(self, langs: list[str], code: np.ndarray, w: np.ndarray, weight: np.ndarray) -> None:
        self.langs, self.code, self.w, self.weight = langs, code, w, weight

    def losses(self, x: np.ndarray) -> np.ndarray:
        """Weighted logistic loss of each row against each codeword."""
        margin = np.clip(x @ self.w[:-1] + self.w[-1], -8, 8)
        ones, rest = (self.code > 0) * self.weight, (self.code < 0) * self.weight
        return (np.log1p(np.exp(-margin)) @ ones.T + np.log1p(np.exp(margin)) @ rest.T) / max(1e-9, float(self.weight.sum()))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, score and whether it is ambiguous."""
        if len(self.langs) == 1:
            return [self.langs[0]] * len(x), np.ones(len(x)), np.zeros(len(x), bool)
        loss = self.losses(x)
        rank = np.argsort(loss, 1, kind="stable")
        rows = np.arange(len(x))
        best, second = loss[rows, rank[:, 0]], loss[rows, rank[:, 1]]
        p = np.exp(-(loss - best[:, None]) * 4)
        return [self.langs[k] for k in rank[:, 0]], 1 / p.sum(1), second - best < AMBIGUOUS_GAP


def fit(texts: list[str], langs: list[str], rounds: int = 120) -> Model | None:
    """Logistic regression for each bit by Adam, from zero; short pieces of the texts are learned from, too."""
    names = sorted(set(langs))
    if not names:
        return None
    if len(names) == 1:
        return Model(names, np.zeros((1, 0)), np.zeros((BUCKETS + 1, 0)), np.zeros(0))
    more, tags = [], []
    for k, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        cut = text.split()
        for size in (2, 6, 20):
            at = (k * 7919 + size * 31) % max(1, len(cut) - size)
            if piece := " ".join(cut[at : at + size]):
                more.append(piece)
                tags.append(lang)
    batch = pa.RecordBatch.from_pydict({"text": pa.array([*texts, *more], pa.string())})
    x = np.array([v for run in runs([batch], "text") for v in vectors(run)], np.float32)
    code = codewords(len(names))
    number = {lang: k for k, lang in enumerate(names)}
    y = code[[number[lang] for lang in [*langs, *tags]]]
    x1 = np.hstack([x, np.ones((len(x), 1), np.float32)])
    balance = {lang: 1 / n for lang, n in zip(*np.unique([*langs, *tags], return_counts=True), strict=True)}
    importance = np.array([balance[lang] for lang in [*langs, *tags]], np.float32)[:, None] / len(names)
    w = np.zeros((BUCKETS + 1, code.shape[1]), np.float32)
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = x1.T @ (-y / (1 + np.exp(np.clip(y * (x1 @ w), -30, 30))) * importance) + 1e-5 * w
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        w -= 0.3 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    right = ((np.sign(x1 @ w) == y) * importance).sum(0)
    return Model(names, code, w, np.maximum(2 * right - 1, 0.01))


def held_out(doc_id: str = "doc_id") -> Column:
    """Never learned from: crc32 of the id as text leaves 2 when divided by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit_on(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG, in_all: int = SAMPLE_DOCS, in_bytes: int = SAMPLE_BYTES) -> Model | None:
    """Learns every language that is labelled, from at most per_lang documents of each, taken by the hash of their ids. With many
    languages each has fewer, in_all documents and in_bytes bytes together, but one each. Of texts that repeat an id and
    language, the smallest counts. Documents without id are not learned from."""
    known = docs.where(F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out())
    slim = known.select("doc_id", "lang", F.octet_length("text").alias("bytes"), (F.pmod(F.xxhash64("doc_id"), F.lit(1 << 40)) / (1 << 40)).alias("u"))
    counts = slim.groupBy("lang").agg(F.approx_count_distinct("doc_id").alias("ids"))
    n_langs = counts.count()
    each, share = max(1, min(per_lang, in_all // max(1, n_langs))), in_bytes // max(1, n_langs)
    # The smallest hashes alone come to the sort: some more than are wanted of each language, however many rows it has.
    near = slim.join(F.broadcast(counts) if n_langs <= MAX_BROADCAST else counts, "lang").where(F.col("u") * F.col("ids") < 3 * each + 40)
    near = near.groupBy("lang", "doc_id", "u").agg(F.min("bytes").alias("bytes"))
    order = Window.partitionBy("lang").orderBy("u", "doc_id")
    ids = near.withColumn("k", F.row_number().over(order)).withColumn("sum", F.sum("bytes").over(order)).where((F.col("k") <= each) & ((F.col("k") == 1) | (F.col("sum") <= share)))
    rows = known.select("doc_id", "lang", "text").join(F.broadcast(ids.select("doc_id", "lang")), ["doc_id", "lang"]).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows.sort(key=lambda r: (r.doc_id, r.text, r.lang))
    return fit([r.text for r in rows], [r.lang for r in rows])


def identify(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, lang_pred, score, ambiguous); one pass, no shuffle."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "text"):
            langs, score, doubt = predict_run(run, model)
            yield pa.RecordBatch.from_arrays([run.rows.column(0), pa.array(langs, pa.string()), pa.array(score.astype(float)), pa.array(doubt)], names=["doc_id", "lang_pred", "score", "ambiguous"])

    return docs.select("doc_id", "text").mapInArrow(work, "doc_id long, lang_pred string, score double, ambiguous boolean")


def keep_known(docs: DataFrame, model: Model | None, least: float = 0.5) -> DataFrame:
    """The rows of docs, all columns, whose language is found with a score of at least this; all if nothing was learned."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for run in runs(batches, "text"):
            if model:
                langs, score, _ = predict_run(run, model)
                yield run.rows.filter(pa.array([p != UND and s >= least for p, s in zip(langs, score.tolist(), strict=True)]))
            else:
                yield run.rows

    return docs.mapInArrow(work, docs.schema)


def predict_run(run: Run, model: Model | None) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, score and whether it is ambiguous, for each text of the run."""
    n = run.rows.num_rows
    letters = np.append(0, np.cumsum(_IS_ASCII_LETTER[run.data]))
    lettered = letters[run.offsets[1:]] > letters[run.offsets[:-1]]
    for k in np.flatnonzero(~lettered & (run.offsets[1:] > run.offsets[:-1])):
        lettered[k] = any(c.isalpha() for c in bytes(run.data[run.offsets[k] : run.offsets[k + 1]]).decode("utf-8", "replace"))
    usable = lettered & run.valid & (model is not None)
    langs, score, doubt = [UND] * n, np.zeros(n), np.ones(n, bool)
    if usable.any():
        got: list[tuple[list[str], np.ndarray, np.ndarray]] = []
        pile: list[np.ndarray] = []
        for x in vectors(run):
            pile.append(x)
            if len(pile) == 512:
                got.append(model.predict(np.array(pile)))
                pile = []
        if pile:
            got.append(model.predict(np.array(pile)))
        every = list(itertools.chain.from_iterable(g[0] for g in got))
        langs = [p if u else UND for p, u in zip(every, usable.tolist(), strict=True)]
        score = np.where(usable, np.concatenate([g[1] for g in got]), 0.0)
        doubt = ~usable | np.concatenate([g[2] for g in got])
    return langs, score, doubt


def detect_languages(docs: DataFrame) -> DataFrame:
    """Learns from docs and predicts for all of them: (doc_id, held_out, lang_pred, score, ambiguous)."""
    return identify(docs, fit_on(docs)).withColumn("held_out", held_out())
