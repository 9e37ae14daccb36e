"""Unified diffs of replaced lines: written from files and changes, and read back line by line.

Hunks are the changed lines with their context, those that overlap or touch merged by a running maximum; a line finds its hunk by
an equality join, as each change names the few lines around it. Reading numbers the lines by running counts within each hunk.

A file without changes has no patch; changes of lines that a file doesn't have are left out, and of changes of one line the smallest
text counts; null sources have no lines. A patch is one row, so its size is bounded by that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: What marks a last line without its end, and how a hunk begins.
NO_NEWLINE, HUNK = "\\ No newline at end of file", r"\A@@ -(\d+)(?:,\d+)? \+(\d+)(?:,\d+)? @@"
CONTEXT = 1


def file_lines(files: DataFrame) -> DataFrame:
    """files(file_id, path, source) to (file_id, path, line, text, at_eof): lines from 1 without their ends; at_eof: the last one, if
    it has no end."""
    rows = files.where("source <> ''").select("file_id", "path", F.split("source", r"\r\n|\r|\n", -1).alias("parts"))
    rows = rows.withColumn("open", F.element_at("parts", -1) != "")
    lines = F.when(F.col("open"), F.col("parts")).otherwise(F.slice("parts", F.lit(1), F.size("parts") - 1))
    rows = rows.select("file_id", "path", "open", F.size(lines).alias("n"), F.posexplode(lines).alias("pos", "text"))
    return rows.select("file_id", "path", (F.col("pos") + 1).alias("line"), "text", (F.col("open") & (F.col("pos") + 1 == F.col("n"))).alias("at_eof"))


def _span(first: Column, n: Column) -> Column:
    return F.when(n == 1, first.cast("string")).otherwise(F.concat(first.cast("string"), F.lit(","), n.cast("string")))


def write_patches(files: DataFrame, changes: DataFrame, context: int = CONTEXT) -> DataFrame:
    """files(file_id, path, source) and changes(file_id, line, new) to (file_id, path, patch)."""
    lines = file_lines(files)
    new = changes.groupBy("file_id", "line").agg(F.min("new").alias("new"))
    n_lines = lines.groupBy("file_id").agg(F.max("line").alias("n"))
    near = new.join(n_lines, "file_id").where((F.col("line") >= 1) & (F.col("line") <= F.col("n")))
    near = near.select("file_id", "line", F.greatest(F.lit(1), F.col("line") - context).alias("first"), F.least(F.col("n"), F.col("line") + context).alias("last"))
    order = Window.partitionBy("file_id").orderBy("line")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    near = near.withColumn("begins", F.coalesce(F.col("first") > before + 1, F.lit(True)).cast("int")).withColumn("hunk", F.sum("begins").over(order))
    around = near.select("file_id", "hunk", F.explode(F.sequence("first", "last")).alias("line")).distinct()
    rows = lines.join(around, ["file_id", "line"]).join(new, ["file_id", "line"], "left")
    end = lambda: F.when(F.col("at_eof"), F.array(F.lit(NO_NEWLINE))).otherwise(F.expr("cast(array() as array<string>)"))
    kept = F.concat(F.array(F.concat(F.lit(" "), "text")), end())
    changed = F.concat(F.array(F.concat(F.lit("-"), "text")), end(), F.array(F.concat(F.lit("+"), "new")), end())
    part = F.when(F.col("new").isNull(), kept).otherwise(changed)
    hunks = rows.groupBy("file_id", "path", "hunk").agg(F.min("line").alias("first"), F.count("*").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("line", part.alias("part")))), lambda x: x["part"])).alias("body"))
    span = _span(F.col("first"), F.col("n"))
    text = F.concat(F.array(F.concat(F.lit("@@ -"), span, F.lit(" +"), span, F.lit(" @@"))), F.col("body"))
    whole = hunks.groupBy("file_id", "path").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("hunk", text.alias("text")))), lambda x: x["text"])).alias("all"))
    head = F.array(F.concat(F.lit("--- a/"), "path"), F.concat(F.lit("+++ b/"), "path"))
    return whole.select("file_id", "path", F.concat(F.array_join(F.concat(head, F.col("all")), "\n"), F.lit("\n")).alias("patch"))


def parse_patches(patches: DataFrame) -> DataFrame:
    """(patch_id, patch) to (patch_id, pos, kind, text, old_no, new_no): kind is file, hunk, add, del, context or meta; lines before
    any hunk count from 0."""
    plain = F.regexp_replace(F.regexp_replace("patch", r"\r\n?", "\n"), r"\n\z", "")
    rows = patches.select("patch_id", F.posexplode(F.split(plain, "\n", -1)).alias("pos", "raw"))
    raw, first = F.col("raw"), F.substring("raw", 1, 1)
    kind = (
        F.when(raw.rlike(r"\A(?:---|\+\+\+) "), "file").when(raw.rlike(HUNK), "hunk").when(first == "+", "add").when(first == "-", "del").when((first == " ") | (raw == ""), "context").otherwise("meta")
    )
    rows = rows.withColumn("kind", kind).withColumn("hunk", F.sum(F.when(F.col("kind") == "hunk", 1).otherwise(0)).over(Window.partitionBy("patch_id").orderBy("pos")))
    own = Window.partitionBy("patch_id", "hunk").orderBy("pos")
    begin = lambda k: F.coalesce(F.first(F.when(F.col("kind") == "hunk", F.regexp_extract("raw", HUNK, k).cast("long"))).over(own), F.lit(0))
    before = lambda *kinds: F.coalesce(F.sum(F.col("kind").isin(*kinds).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    text = F.when(F.col("kind").isin("add", "del", "context"), F.substring("raw", 2, 2**31 - 1)).otherwise(raw)
    number = lambda k, *kinds: F.when(F.col("kind").isin(*kinds), begin(k) + before(*kinds))
    return rows.select("patch_id", "pos", "kind", text.alias("text"), number(1, "del", "context").alias("old_no"), number(2, "add", "context").alias("new_no"))
