"""Short accounts of many rows: sections of a report, the largest folders, functions found in another module."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _part(n: str, one: str, many: str) -> Column:
    """Null where there are none, so that concat_ws leaves it out."""
    return F.when(F.col(n) > 0, F.concat_ws(" ", F.col(n).cast("string"), F.when(F.col(n) == 1, one).otherwise(many)))


def section_summaries(checks: DataFrame, by: list[str]) -> DataFrame:
    """What each section of a report says of its checks, and its tone. A missed bonus sets the tone only where nothing else does."""
    failed, mandatory = F.col("status").isin("fail", "skipped"), F.coalesce(F.col("mandatory"), F.lit(False)) & ~F.coalesce(F.col("bonus"), F.lit(False))
    n = checks.groupBy(*by).agg(
        F.count("*").alias("n"), F.count_if(F.col("status") == "pass").alias("passed"), F.count_if(failed).alias("failing"), F.count_if(F.col("status") == "warning").alias("warnings"),
        F.count_if(F.col("status") == "bonus").alias("missed"), F.coalesce(F.bool_or(failed & mandatory), F.lit(False)).alias("blocking"),
    )
    # The wording of a summary.
    head = F.concat(F.col("passed").cast("string"), F.lit(" / "), F.col("n").cast("string"), F.lit(" passed"))
    summary = F.concat_ws(" · ", head, _part("failing", "failing", "failing"), _part("warnings", "warning", "warnings"), _part("missed", "bonus not done", "bonus not done"))
    tone = F.when(F.col("blocking"), "fail").when((F.col("failing") > 0) | (F.col("warnings") > 0), "warning").when(F.col("missed") > 0, "bonus").otherwise("pass")
    return n.select(*by, summary.alias("summary"), tone.alias("tone"))


def heaviest_entries(tree: DataFrame, top: int = 3) -> DataFrame:
    """Of each project, the top-level names that hold the most files, ties by name: a report of the first few."""
    counts = tree.where("kind = 'file'").groupBy("project_id", F.substring_index("path", "/", 1).alias("name")).agg(F.count("*").alias("files"))
    w = Window.partitionBy("project_id").orderBy(F.desc("files"), "name")
    return counts.withColumn("place", F.row_number().over(w)).where(F.col("place") <= top)


def defined_elsewhere(expected: DataFrame, functions: DataFrame) -> DataFrame:
    """Functions of expected(project_id, path, name) that their module lacks and another defines: the first by path,
    its line, and how many more modules define it. functions: project_id, path, name, line; a name that a module
    defines twice counts once, by its first line."""
    defined = functions.groupBy("project_id", "path", "name").agg(F.min("line").alias("line"))
    missing = expected.join(defined, ["project_id", "path", "name"], "left_anti")
    other = defined.withColumnRenamed("path", "found_path")
    hit = missing.join(other, ["project_id", "name"])
    first = F.min(F.struct("found_path", "line")).alias("first")
    return hit.groupBy("project_id", "path", "name").agg(first, (F.count("*") - 1).alias("more")).select("project_id", "path", "name", "first.found_path", "first.line", "more")
