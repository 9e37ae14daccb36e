"""Comparing runs, and their history."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marksheet import schema

PAIR = ("subject_id", "project_id")


def compare_runs(base: DataFrame, head: DataFrame) -> DataFrame:
    """Checks of two runs by pair_id and check_id, a row for each list that a change is in. Fixed is what failed, was skipped
    or warned and passes now."""
    b = base.select("pair_id", "check_id", F.col("status").alias("before"))
    h = head.select("pair_id", "check_id", F.col("status").alias("after"))
    both = b.join(h, ["pair_id", "check_id"], "full_outer")
    was, now = F.coalesce(F.col("before").isin(*schema.FAILING), F.lit(False)), F.coalesce(F.col("after").isin(*schema.FAILING), F.lit(False))
    lists = F.array_compact(
        F.array(
            F.when(F.col("before").isin(*schema.FIXABLE) & (F.col("after") == "pass"), "fixed"), F.when(~was & now, "new_failures"), F.when(was & now, "still_failing"), F.when(F.col("before").isNull(), "new_checks"), F.when(F.col("after").isNull(), "removed_checks")
        )
    )
    return both.select("pair_id", "check_id", "before", "after", F.explode(lists).alias("change"))


def readiness_deltas(analyses: DataFrame) -> DataFrame:
    """Each run's change against the run before it of the same subject and project, by time, then number."""
    w = Window.partitionBy(*PAIR).orderBy("created_at", "number", "id")
    return analyses.withColumn("previous", F.lag("readiness").over(w)).withColumn("delta", F.floor((F.col("readiness") - F.col("previous")) * 10 + 0.5) / 10)


def latest_runs(analyses: DataFrame) -> DataFrame:
    w = Window.partitionBy(*PAIR).orderBy(F.desc("created_at"), F.desc("number"), F.desc("id"))
    return analyses.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def previous_analysis(analyses: DataFrame) -> DataFrame:
    """The latest run of a smaller number, by number, then time; runs of one number have the same."""
    below = Window.partitionBy(*PAIR).orderBy("number").rangeBetween(Window.unboundedPreceding, -1)
    return analyses.withColumn("previous_id", F.max(F.struct("number", "created_at", "id")).over(below)["id"])


def readiness_change(base: DataFrame, head: DataFrame) -> DataFrame:
    """(pair_id, readiness) of two runs: the change to one decimal, half to even."""
    return base.select("pair_id", F.col("readiness").alias("before")).join(head.select("pair_id", F.col("readiness").alias("after")), "pair_id").select("pair_id", F.bround(F.col("after") - F.col("before"), 1).alias("readiness_delta"))


def next_numbers(analyses: DataFrame) -> DataFrame:
    return analyses.groupBy(*PAIR).agg((F.greatest(F.count("*"), F.coalesce(F.max("number"), F.lit(0)).cast("long")) + 1).alias("next_number"))


def list_analyses(analyses: DataFrame, subject_id: str | None = None, project_id: str | None = None, limit: int = 50) -> DataFrame:
    """Newest first; each filter only if given; 1 to 1000 rows."""
    for name, value in (("subject_id", subject_id), ("project_id", project_id)):
        if value is not None:
            analyses = analyses.where(F.col(name) == value)
    return analyses.orderBy(F.desc("created_at"), F.desc("number"), F.desc("id")).limit(max(1, min(1000, limit)))


def list_by_subject(analyses: DataFrame, limit: int = 50) -> DataFrame:
    """The newest of every subject, 1 to 1000 rows each."""
    w = Window.partitionBy("subject_id").orderBy(F.desc("created_at"), F.desc("number"), F.desc("id"))
    return analyses.withColumn("k", F.row_number().over(w)).where(F.col("k") <= max(1, min(1000, limit))).drop("k")


def keep_newest(items: DataFrame, keys: list[str], order: str, n: int, protected: DataFrame | None = None) -> DataFrame:
    """What retention would drop: all but the n last of each key, and what is protected by id."""
    w = Window.partitionBy(*keys).orderBy(F.desc(order), F.desc("id"))
    old = items.withColumn("k", F.row_number().over(w)).where(F.col("k") > n).drop("k")
    return old.join(protected.select("id"), "id", "left_anti") if protected is not None else old


def upsert(table: DataFrame, changes: DataFrame, key: str, version: str) -> DataFrame:
    """Latest version of each key."""
    w = Window.partitionBy(key).orderBy(F.desc(version))
    return table.unionByName(changes).withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")
