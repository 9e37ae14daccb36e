"""The numbered queries: each operator over its whole table, with digests of what it made."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe_replay, chat_format, decontaminate, fill_middle, language_id, main_text, paragraph_sketch, permutation_index, quality_fm, shingle_join, token_table, warc_archive, whitening
from .shared import read_table


def op1_token_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    table = token_table.write_token_table(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2)
    return token_table.read_token_table(table)


def op2_bpe_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents", "doc_id", "text")
    return bpe_replay.encode_documents(docs, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep_ids=False)


def op3_shingle_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shingle_join.near_duplicates(read_table(spark, sf_dir, "documents", "doc_id", "text"), shingle_join.Rule(words=4, percent=85))


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read_table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    return chat_format.digests(chat_format.read_back(chat_format.format_conversations(rows.unionByName(chat_format.probe(spark)))))


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_contaminated(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "benchmark", "item_id", "text"))


def op6_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return permutation_index.search(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"), F.col("vec_id") % 20 == 0)


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.detect_languages(read_table(spark, sf_dir, "documents", "doc_id", "text", "lang"))


def op8_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_archive.read_warc(warc_archive.write_warc(read_table(spark, sf_dir, "pages", "page_id", "url", "html")))


def op9_quality_fm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_fm.score_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"), read_table(spark, sf_dir, "labels", "doc_id", "quality"))


def op10_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text.extract_main_text(read_table(spark, sf_dir, "pages", "page_id", "url", "html"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten_embeddings(read_table(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def op12_paragraph_sketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paragraph_sketch.fingerprint_documents(read_table(spark, sf_dir, "documents", "doc_id", "text"))


def op13_fill_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_middle.digests(fill_middle.transform(read_table(spark, sf_dir, "documents", "doc_id", "text")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_token_table, op2_bpe_replay, op3_shingle_join, op4_chat_format, op5_decontaminate, op6_permutation_index, op7_language_id, op8_warc, op9_quality_fm, op10_main_text,
        op11_whitening, op12_paragraph_sketch, op13_fill_middle,
    )
}
