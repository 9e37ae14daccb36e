"""Each stage of the pipeline against a plain version on its own input."""

from collections import Counter

import corpus_pipeline
import pyarrow.parquet as pq
from marksheet.llm import decontaminate, quality_fm, shingle_join

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    texts = {r["doc_id"]: r["text"] for r in pq.read_table(f"{SF}/documents.parquet").to_pylist()}
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = {r.doc_id for r in docs.select("doc_id").collect()}
        out = corpus_pipeline.materialise(stage(spark, docs, SF), f"test-{name}")
        after = {r.doc_id for r in out.select("doc_id").collect()}
        assert out.columns == columns and after <= before
        if name == "quality":
            model = quality_fm.fit_on(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert after == {r.doc_id for r in quality_fm.score(docs, model).where("predicted = 1").collect()}
        elif name == "language":
            assert all(any(c.isalpha() for c in texts[d]) for d in after) and len(after) > 0.95 * len(before)
        elif name == "near_duplicates":
            found = {r.doc_id: r.component_id for r in shingle_join.near_duplicates(docs, shingle_join.Rule(words=5, percent=80)).collect()}
            assert after == set(found.values())
        else:
            bad = {r.doc_id for r in decontaminate.find_contaminated(docs, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
            items = [" ".join(r["text"].lower().split()) for r in pq.read_table(f"{SF}/benchmark.parquet").to_pylist()]
            assert after == before - bad and not any(i in " ".join(texts[d].lower().split()) for d in after for i in items)
        docs = out
    got = {r.doc_id for r in corpus_pipeline.STAGES[-1][1](spark, docs, SF).collect()}
    assert got == {r.doc_id for r in docs.collect()}


ODD = "doc_id long, text string, lang string, source string, n_chars long, score double, predicted int, component_id long, item_id long, ids array<int>, h long"


def rows_of(df):
    return Counter((r.doc_id, r.text) for r in df.collect())


def test_stages_with_odd_rows(spark):
    """Nulls, empty and long texts, repeated rows and ids, and columns with the names that operators use inside."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    real = docs.orderBy("doc_id").limit(300)
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where("length(text) > 60").orderBy("item_id").first().text
    one = real.first().text
    # -1 repeats with another text; -2 is an exact copy in two rows; -7 holds an item in one of its two rows.
    texts = [(None, None), (None, one), (None, item), (-1, one + " and some more words here"), (-1, one), (-2, one), (-2, one), (-3, None), (-4, ""), (-5, " 12 + "), (-6, " ".join([one] * 200)), (-7, f"{one} {item}"), (-7, one)]
    odd = spark.createDataFrame([(d, t, "en", "s", 1, 0.5, 1, 7, 7, [1], 7) for d, t in texts], ODD)
    mixed = real.unionByName(odd, allowMissingColumns=True)
    stages = dict(corpus_pipeline.STAGES)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, mixed, SF)
        before, after = rows_of(mixed), rows_of(out)
        assert out.columns == mixed.columns and after <= before
        assert all(stage(spark, mixed.limit(0), SF).columns == mixed.columns and stage(spark, m, SF).count() <= m.count() for m in (mixed.limit(0), odd.where("text is null")))
        if name == "quality":
            assert (after[None, None] > 0) == (after[-3, None] > 0) == (after[-4, ""] > 0) and after[-2, one] in (0, 2)
        elif name == "language":
            assert not any(after[k] for k in ((None, None), (-3, None), (-4, ""), (-5, " 12 + "))) and after[-2, one] == 2 and after[-6, " ".join([one] * 200)] == 1
        elif name == "near_duplicates":
            first = real.first().doc_id
            assert after[None, None] == after[-3, None] == after[-4, ""] == 1 and not after[None, one]
            kept = {d for (d, t), n in after.items() if n and t == one and d is not None}
            assert kept == {-7} or first not in kept
            assert all(n == before[k] for k, n in after.items() if n)
        else:
            assert not after[None, item] and after[None, None] == after[None, one] == 1 and not after[-7, one] and not after[-7, f"{one} {item}"] and after[-2, one] == 2 and after[-3, None] == 1
    alone = spark.createDataFrame([(None, f"{one} {k}", k) for k in (1, 1, 2)] + [(None, "  ", 3), (None, "  ", 4)], "doc_id long, text string, dropped_id int")
    assert rows_of(stages["near_duplicates"](spark, alone, SF)) in ({(None, f"{one} {k}"): 1, (None, "  "): 2} for k in (1, 2))
    out = stages["tokens"](spark, mixed, SF)
    assert out.columns == ["doc_id", "ids", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() == mixed.count()
    assert {r.n_tokens for r in out.where("doc_id in (-3, -4)").collect()} == {0} and stages["tokens"](spark, mixed.limit(0), SF).count() == 0
