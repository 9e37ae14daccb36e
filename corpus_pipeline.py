"""A corpus pipeline of five operators, each over all that its predecessor kept.

Quality classifier, language identification, n-gram Jaccard join (one document of each group stays), benchmark
decontamination, byte-level BPE. All but the last return the columns of documents; the last returns the token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.llm import bpe_replay, decontaminate, language_id, quality_fm, shingle_join
from marksheet.llm.shared import materialise, named, read_table, without


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what the factorisation machine predicts as bad. Null and empty texts are scored like any other; without a
    label to learn from, nothing is dropped."""
    return quality_fm.keep_good(docs, quality_fm.fit_on(docs, read_table(spark, sf_dir, "labels", "doc_id", "quality")))


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no letter (so null and empty texts), or no language that stands out: a score below one half."""
    return language_id.keep_known(docs, language_id.fit_on(docs))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates (five words, similarity 0.8), the document of smallest id stays, with all its rows.

    Documents without words stay. Rows without doc_id come after all others, each text a document; of those with words and
    an equal text one row stays."""
    found = shingle_join.near_duplicates(named(docs), shingle_join.Rule(words=5, percent=80))
    kept = without(docs, found.where(F.col("doc_id") != F.col("component_id")))
    nameless = F.col("doc_id").isNull() & F.coalesce(F.col("text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return kept.where(~nameless).unionByName(kept.where(nameless).dropDuplicates(["text"]))


def contamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item, also with other numbers, names or units; of rows that repeat a doc_id, all
    go if one of them holds an item; of rows without doc_id, those whose text does. Null and empty texts hold none."""
    return without(docs, decontaminate.find_contaminated(named(docs), read_table(spark, sf_dir, "benchmark", "item_id", "text")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, ids, n_tokens, ids_sha256, decoded_sha256) of what is left, a row for each; null texts count as empty.

    Small blocks, as the workers and heaps of the earlier stages live on."""
    return bpe_replay.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, block_bytes=bpe_replay.SMALL_BLOCK_BYTES)


STAGES = [("quality", quality), ("language", language), ("near_duplicates", near_duplicates), ("contamination", contamination), ("tokens", tokens)]
#: Models and byte-pair merges have no SQL form; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
