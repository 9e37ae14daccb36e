"""N-gram Jaccard self-join by vertical partitioning.

Two documents link when 100 |A and B| >= percent |A or B| over their sets of distinct shingles of so many words (a Rule).

1. Documents with equal sets are one class; only its smallest doc_id goes on.
2. In a global order of shingles (by hash), two sets that link share at least need(n) shingles among the first
   reach(n) of each. These few shingles are shuffled; a document of whose none or too few recur links with nothing.
   Of the rest a document drops its need(n) - 1 most frequent, which are never the only ones that a link shares: so a
   passage that many documents have chains them only where it makes up much of a document. What remains connects
   documents into candidate groups, by edges to the smallest document of each shingle: as many as occurrences.
3. In a group, the order of shingles is cut into fragments; overlaps are counted for each fragment by itself and
   summed for each pair. Large groups are cut into blocks by set size, of BLOCK documents and BLOCK_SHINGLES shingles at
   most (one larger set is a block of its own), and pairs of blocks whose sizes can't link are left out; a task has two
   blocks at a time, and gives the links between them as a spanning forest and counts, so no task emits all pairs of a group.
4. Links and classes make the components.

Defined results: a null, empty or blank text has no set, links with nothing and is its own component; a text of fewer
words than a shingle has the whole sequence as its one shingle; rows that repeat a doc_id are one document if their
texts have equal sets, else the one with the smallest set hash counts; a null doc_id is left out; extra columns are ignored.
Shingles are compared by 64-bit hashes. Frequent shingles, classes and sizes are counted by pre-aggregation and joined
back, so that a key that a third of all rows share is split like any skewed join.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import materialise, remove
from .textbuf import runs, shingle_hashes, word_hashes, words

#: Documents and shingles of a block, and distinct shingles of a fragment that are counted at once.
BLOCK, BLOCK_SHINGLES, FRAGMENT = 1024, 2_000_000, 4096
#: Survivors up to this number are sent to the tasks that read the texts again; more are joined by shuffling.
MAX_BROADCAST = 1_000_000


class Rule(NamedTuple):
    """words: words of a shingle; percent: the least Jaccard similarity of two sets that link."""

    words: int = 5
    percent: int = 80

    def must_share(self, n):
        """Shingles that a set of n has in common with any set that it links with, at least."""
        return -((-self.percent * n) // 100)

    def need(self, n):
        return n * (100 - self.percent) // 100 + 1

    def reach(self, n):
        return np.minimum(n, n - self.must_share(n) + self.need(n))

    def least_need(self, n: Column) -> Column:
        """need() of the smallest set that one of n can link with."""
        return F.floor(-F.floor(-n * self.percent / 100) * (100 - self.percent) / 100) + 1


def doc_sets(run, size: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    w = words(run.data, run.offsets)
    h, begin = shingle_hashes(word_hashes(run.data, w), w.first, size)
    for a, b in zip(begin[:-1].tolist(), begin[1:].tolist(), strict=True):
        x = np.sort(h[a:b])
        yield x[np.append(True, x[1:] != x[:-1])] if b > a else x


def _signature(x: np.ndarray) -> bytes:
    import hashlib

    return hashlib.blake2b(x.tobytes(), digest_size=16).digest()


def _summaries(batches: Iterable[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, "text"):
        n, sig, prefix = [], [], []
        for x in doc_sets(run, rule.words):
            n.append(len(x))
            sig.append(_signature(x))
            prefix.append(x[: int(rule.reach(len(x)))].view(np.int64))
        offs = np.append(0, np.cumsum([len(p) for p in prefix])).astype(np.int32)
        yield pa.RecordBatch.from_arrays([run.rows.column(0), pa.array(n, pa.int64()), pa.array(sig, pa.binary()), pa.ListArray.from_arrays(pa.array(offs), pa.array(np.concatenate(prefix) if prefix else np.zeros(0, np.int64)))], names=["doc_id", "n", "sig", "prefix"])


def _full_sets(batches: Iterable[pa.RecordBatch], rule: Rule) -> Iterator[pa.RecordBatch]:
    for run in runs(batches, "text"):
        sets = list(doc_sets(run, rule.words))
        yield pa.RecordBatch.from_arrays([run.rows.column(0), run.rows.column(1), pa.array([x.tobytes() for x in sets], pa.binary()), pa.array([_signature(x) for x in sets], pa.binary())], names=["doc_id", "grp", "shingles", "sig"])


# ---------------------------------------------------------------- connected components


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """edges(a, b) to (node, root): the smallest node that each can reach. Alternating large and small stars; each
    round's edges are written to the shared folder, those of the round before removed."""
    edges = materialise(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        low = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(low, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.a", "e.b")
        before, edges = edges, materialise(small.where("a <> b").distinct(), name)
        remove(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now


# ---------------------------------------------------------------- overlaps of two blocks


def overlaps(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Shared shingles of each pair: partial counts of each fragment of the global order, summed for each pair."""
    a, b = np.concatenate(left), np.concatenate(right)
    shared = np.intersect1d(a, b) if left is not right else None
    if shared is None:
        got, counts = np.unique(a, return_counts=True)
        shared = got[counts > 1]
    row_a = np.repeat(np.arange(len(left)), [len(x) for x in left])
    row_b = np.repeat(np.arange(len(right)), [len(x) for x in right])
    total = np.zeros((len(left), len(right)), np.int64)
    order_a, order_b = np.argsort(a, kind="stable"), np.argsort(b, kind="stable")
    sorted_a, sorted_b = a[order_a], b[order_b]
    for at in range(0, len(shared), FRAGMENT):
        part = shared[at : at + FRAGMENT]

        def grid(values: np.ndarray, order: np.ndarray, rows: np.ndarray, n: int) -> np.ndarray:
            lo, hi = np.searchsorted(values, part[0]), np.searchsorted(values, part[-1], "right")
            col = np.minimum(np.searchsorted(part, values[lo:hi]), len(part) - 1)
            fits = part[col] == values[lo:hi]
            out = np.zeros((n, len(part)), np.float32)
            out[rows[order[lo:hi][fits]], col[fits]] = 1
            return out

        x = grid(sorted_a, order_a, row_a, len(left))
        y = x if left is right else grid(sorted_b, order_b, row_b, len(right))
        total += (x @ y.T).astype(np.int64)  # FRAGMENT at most, so exact
    if left is right:  # a document's own shingles that no other has
        np.fill_diagonal(total, [len(x) for x in left])
    return total


def forest(link: np.ndarray) -> list[tuple[int, int]]:
    """Edges (row, column) of a spanning forest of a bipartite link matrix."""
    rows, cols = np.ones(link.shape[0], bool), np.ones(link.shape[1], bool)
    out = []
    for start in range(link.shape[0]):
        if not rows[start]:
            continue
        rows[start], front = False, [start]
        while front:
            i = front.pop()
            for j in np.flatnonzero(link[i] & cols).tolist():
                cols[j] = False
                out.append((i, j))
                for k in np.flatnonzero(link[:, j] & rows).tolist():
                    rows[k] = False
                    out.append((k, j))
                    front.append(k)
    return out


def _links(batches: Iterable[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (grp, bi, bj, side): the edges of each pair of blocks (b is null where links are counted)."""
    key, sides = None, ([], [])

    def done() -> Iterator[pa.RecordBatch]:
        if key is None or not sides[0]:
            return
        same = key[1] == key[2]
        left = sides[0]
        right = left if same else sides[1]
        if not right:
            return
        ids_l, ids_r = [i for i, _ in left], [i for i, _ in right]
        sets_l = [s for _, s in left]
        sets_r = sets_l if same else [s for _, s in right]
        o = overlaps(sets_l, sets_r)
        size_l, size_r = np.array([len(s) for s in sets_l]), np.array([len(s) for s in sets_r])
        link = 100 * o >= percent * (size_l[:, None] + size_r[None] - o)
        if same:
            np.fill_diagonal(link, False)
        a, b, c = [], [], []
        for i, j in forest(link):
            a.append(ids_l[i])
            b.append(ids_r[j])
            c.append(0)
        for ids, counts in ((ids_l, link.sum(1)),) + (() if same else ((ids_r, link.sum(0)),)):
            for i in np.flatnonzero(counts).tolist():
                a.append(ids[i])
                b.append(None)
                c.append(int(counts[i]))
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.int64())], names=["a", "b", "links"])

    for batch in batches:
        for grp, bi, bj, side, doc_id, data in zip(*batch.columns, strict=True):
            grp, bi, bj, side, doc_id, data = grp.as_py(), bi.as_py(), bj.as_py(), side.as_py(), doc_id.as_py(), data.as_py()
            if (grp, bi, bj) != key:
                yield from done()
                key, sides = (grp, bi, bj), ([], [])
            sides[side].append((doc_id, np.frombuffer(data, np.uint64)))
    yield from done()


# ---------------------------------------------------------------- Spark


def near_duplicates(docs: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """docs(doc_id, text, ...) to (doc_id, n_shingles, component_id, class_id, n_links).

    class_id: smallest document with an equal set; n_links: other sets that the document's set links with."""
    texts = docs.where("doc_id is not null").select("doc_id", "text")
    table = materialise(texts.mapInArrow(lambda b: _summaries(b, rule), "doc_id long, n long, sig binary, prefix array<long>"), "shingle-prefixes")
    one = materialise(table.groupBy("doc_id").agg(F.min(F.struct("sig", "n")).alias("s")).select("doc_id", "s.sig", "s.n"), "shingle-sets")
    classes = materialise(one.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep")), "shingle-classes")
    # The prefix of each class that some document stands for; equal sets have equal prefixes.
    prefixes = table.where("n > 0").groupBy("sig").agg(F.first("n").alias("n"), F.first("prefix").alias("prefix")).join(classes, "sig")
    posts = materialise(prefixes.select("rep", "n", F.explode("prefix").alias("h")), "shingle-posts")
    remove(table)
    often = posts.groupBy("h").agg(F.count("*").alias("df")).where("df > 1")
    shared = materialise(posts.join(often, "h"), "shared-shingles")
    enough = shared.groupBy("rep", "n").agg(F.count("*").alias("c")).where(F.col("c") >= rule.least_need(F.col("n"))).select("rep")
    # Without its need - 1 most frequent; ties by hash, so all documents keep the same order.
    order = Window.partitionBy("rep").orderBy(F.desc("df"), F.desc("h"))
    kept = shared.join(enough, "rep", "left_semi").withColumn("k", F.row_number().over(order)).where(F.col("k") >= rule.least_need(F.col("n")))
    kept = materialise(kept.select("rep", "n", "h"), "kept-shingles")
    hubs = kept.groupBy("h").agg(F.min("rep").alias("hub"))
    edges = materialise(kept.join(hubs, "h").select("rep", "n", "hub").distinct(), "candidate-edges")
    for done in (posts, shared, kept):
        remove(done)
    size = edges.select("rep", "n").distinct()
    group = components(edges.select(F.col("rep").alias("a"), F.col("hub").alias("b")), "candidate-groups")
    roots = group.select(F.col("root").alias("node"), "root").distinct()
    placed = group.unionByName(roots).join(size.withColumnRenamed("rep", "node"), "node")
    # Blocks are runs of a group's members by set size, from counts for each size; a size of several blocks is dealt by hash.
    share = F.greatest(F.lit(1 / BLOCK), F.col("n") / BLOCK_SHINGLES)
    sizes = placed.groupBy("root", "n").agg((F.count("*") * share).alias("room"))
    before = F.coalesce(F.sum("room").over(Window.partitionBy("root").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    sizes = sizes.select("root", "n", F.floor(before).alias("run"), F.ceil("room").alias("parts"))
    part = F.when(F.col("parts") > 1, 1 + F.pmod(F.xxhash64("node"), "parts")).otherwise(0)
    members = placed.join(sizes, ["root", "n"]).select(F.col("node").alias("doc_id"), F.col("root").alias("grp"), F.struct("run", part.alias("part")).alias("blk"), "n")
    members = materialise(members, "candidate-blocks")
    spans = members.groupBy("grp", "blk").agg(F.min("n").alias("lo"), F.max("n").alias("hi"))
    i, j = spans.alias("i"), spans.alias("j")
    low, high = (lambda f: f("i.lo", "j.lo")), (lambda f: f("i.hi", "j.hi"))
    near = (high(F.least) * 100 >= low(F.greatest) * rule.percent) & (F.col("i.blk") <= F.col("j.blk"))
    pairs = i.join(j, (F.col("i.grp") == F.col("j.grp")) & near).select("i.grp", F.col("i.blk").alias("bi"), F.col("j.blk").alias("bj"))

    few = members.select("doc_id", "grp", "blk")
    n_members = few.count()
    side = F.broadcast(few) if n_members <= MAX_BROADCAST else few
    again = texts.join(side, "doc_id").select("doc_id", F.struct("grp", "blk").alias("grp"), "text")
    block = "struct<run: long, part: long>"
    full = again.mapInArrow(lambda b: _full_sets(b, rule), f"doc_id long, grp struct<grp: long, blk: {block}>, shingles binary, sig binary")
    full = full.join(classes.withColumnRenamed("rep", "doc_id"), ["doc_id", "sig"], "left_semi").dropDuplicates(["doc_id"]) if n_members else full
    full = materialise(full.select("doc_id", "grp.grp", "grp.blk", "shingles"), "candidate-sets")
    left = full.join(pairs.select("grp", F.col("bi").alias("blk"), "bi", "bj"), ["grp", "blk"]).select("grp", "bi", "bj", F.lit(0).alias("side"), "doc_id", "shingles")
    right = full.join(pairs.where("bi < bj").select("grp", F.col("bj").alias("blk"), "bi", "bj"), ["grp", "blk"]).select("grp", "bi", "bj", F.lit(1).alias("side"), "doc_id", "shingles")
    tasks = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = left.unionByName(right).repartition(tasks, "grp", "bi", "bj").sortWithinPartitions("grp", "bi", "bj", "side", "doc_id")
    links = materialise(dealt.mapInArrow(lambda b: _links(b, rule.percent), "a long, b long, links long"), "links")
    remove(full)
    linked = components(links.where("b is not null").select("a", "b"), "components")
    n_links = links.where("b is null").groupBy("a").agg(F.sum("links").alias("n_links"))
    named = classes.join(linked, classes.rep == linked.node, "left").join(n_links, F.col("rep") == F.col("a"), "left")
    named = named.select("sig", F.col("rep").alias("class_id"), F.coalesce("root", "rep").alias("component_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return one.join(named, "sig", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"),
        F.when(F.col("n") > 0, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"),
    )
