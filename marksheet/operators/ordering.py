"""Orders and groups in which checks are shown. Places count from 1."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet import schema
from marksheet.functions import scores as S

from .scoring import check_order

#: Name of the group of checks without a file; jobs that are kept.
GENERAL, KEEP_JOBS = "General", 200


def issue_order() -> list[Column]:
    """Status, severity, id."""
    return [S.report_rank(F.col("status")), S.severity_rank(F.col("severity")), F.col("check_id")]


def ordered_issues(checks: DataFrame) -> DataFrame:
    return checks.where(S.is_issue(F.col("status"))).withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy(*issue_order())))


def by_category(checks: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Checks of the categories of a run, worst first in each; category_place is the category's place in the list."""
    names = categories or [*schema.SCORED_CATEGORIES, schema.HEURISTIC_CATEGORY]
    rows = checks.where(F.col("category").isin(*names)).withColumn("category_place", S.rank_of(F.col("category"), names) + 1)
    return rows.withColumn("place", F.row_number().over(Window.partitionBy("run_id", "category").orderBy(*check_order())))


def file_key() -> Column:
    return F.coalesce(F.when(F.col("file") != "", F.col("file")), F.when(F.col("location_file") != "", F.col("location_file")))


def by_file_of_subject(checks: DataFrame, files: DataFrame) -> DataFrame:
    """Issues by file: the subject's files(path, pos) in their order, others by path, those without a file last."""
    rows = ordered_issues(checks).withColumn("key", F.coalesce(file_key(), F.lit(GENERAL)))
    known = files.groupBy("path").agg(F.min("pos").alias("file_pos"))
    groups = rows.select("run_id", "key").distinct().join(known, F.col("key") == F.col("path"), "left")
    bucket = F.when(F.col("file_pos").isNotNull(), 0).when(F.col("key") != GENERAL, 1).otherwise(2)
    groups = groups.withColumn("group_place", F.row_number().over(Window.partitionBy("run_id").orderBy(bucket, "file_pos", "key"))).select("run_id", "key", "group_place")
    return rows.join(groups, ["run_id", "key"]).withColumn("place", F.row_number().over(Window.partitionBy("run_id", "key").orderBy(*issue_order())))


def file_groups(checks: DataFrame) -> DataFrame:
    """A row for each file that issues are about: the worst group first, by its worst check (without its emission), then
    the larger, groups without a file after others, then the path."""
    rows = checks.where(S.is_issue(F.col("status"))).withColumn("key", F.coalesce(file_key(), F.lit("")))
    worst = F.min(F.struct(S.report_rank(F.col("status")).alias("a"), S.severity_rank(F.col("severity")).alias("b"), (~F.col("mandatory")).alias("c")))
    groups = rows.groupBy("run_id", "key").agg(F.count("*").alias("issues"), worst.alias("worst"))
    return groups.withColumn("place", F.row_number().over(Window.partitionBy("run_id").orderBy("worst", F.desc("issues"), F.col("key") == "", "key"))).drop("worst")


def check_filters() -> dict[str, Column]:
    """Named filters of checks."""
    status = F.col("status")
    return {"issues": status.isin(*schema.FAILING), "warnings": status.isin("warning", "info"), "bonus": F.col("bonus") | (status == "bonus"), "passed": status == "pass", "all": F.lit(True)}


def filter_counts(checks: DataFrame) -> DataFrame:
    return checks.groupBy("run_id").agg(*[F.count_if(c).alias(f"n_{name}") for name, c in check_filters().items()])


def evicted_jobs(jobs: DataFrame, keep: int = KEEP_JOBS) -> DataFrame:
    """jobs(owner, job_id, created, finished): beyond `keep` of an owner, as many of the oldest finished ones go."""
    extra = jobs.groupBy("owner").agg((F.count("*") - keep).alias("extra")).where("extra > 0")
    old = jobs.where("finished").withColumn("nth", F.row_number().over(Window.partitionBy("owner").orderBy("created", "job_id")))
    return old.join(extra, "owner").where("nth <= extra").select("owner", "job_id")
