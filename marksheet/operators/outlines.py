"""What an entry of an outline stands below: headings by level, lines of a listing by indent, sections of an exercise.

An entry is open at a later place while nothing of its level or less has come between. Of each level that a document uses, the
last entry before a place is found by a running window, one for each level; those after which no smaller level came are the
path, so no stack is folded in Python and a document's rows stream through windows.

Rows are ordered by pos within their document; of rows that repeat a pos the order is not defined. A null level of a row that
is no entry stands below everything that is open; entries have a level.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def with_open(rows: DataFrame, entries: DataFrame) -> DataFrame:
    """rows(doc_id, pos, level, ...) with above, array<struct<level, pos, name>>: those of entries(doc_id, pos, level, name) that are
    open at the row and of a smaller level, outermost first."""
    levels = entries.select("doc_id", F.col("level").alias("of")).distinct()
    asked = rows.select("doc_id", "pos", "level").join(levels, "doc_id").where(F.col("level").isNull() | (F.col("of") < F.col("level")))
    asked = asked.select("doc_id", "of", "pos", F.lit(None).cast("string").alias("name"), F.lit(True).alias("asks"))
    every = entries.select("doc_id", F.col("level").alias("of"), "pos", "name", F.lit(False).alias("asks")).unionByName(asked)
    so_far = Window.partitionBy("doc_id", "of").orderBy("pos", F.desc("asks"))
    last = F.last(F.when(~F.col("asks"), F.struct(F.col("of").alias("level"), "pos", "name")), ignorenulls=True).over(so_far)
    found = every.withColumn("last", last).where("asks and last is not null").groupBy("doc_id", "pos").agg(F.array_sort(F.collect_list("last")).alias("lasts"))
    # From the smallest level on: an entry counts if it came after all that count before it.
    kind = "array<struct<level: {0}, pos: {1}, name: string>>".format(*(dict(entries.dtypes)[c] for c in ("level", "pos")))
    start = F.struct(F.lit(None).cast(dict(entries.dtypes)["pos"]).alias("after"), F.expr(f"cast(array() as {kind})").alias("open"))

    def step(s: Column, e: Column) -> Column:
        later = s["after"].isNull() | (e["pos"] > s["after"])
        return F.struct(F.when(later, e["pos"]).otherwise(s["after"]).alias("after"), F.when(later, F.concat(s["open"], F.array(e))).otherwise(s["open"]).alias("open"))

    above = F.coalesce(F.aggregate("lasts", start, step)["open"], F.expr(f"cast(array() as {kind})"))
    return rows.join(found, ["doc_id", "pos"], "left").withColumn("above", above).drop("lasts")


def _names(entries: Column) -> Column:
    return F.transform(entries, lambda e: e["name"])


def heading_sections(blocks: DataFrame) -> DataFrame:
    """blocks(doc_id, pos, kind, level, text) with section, the headings above joined by " > ", a heading's own included.

    A first heading of level 1 that is the only one of that level is the title: its section is its text, and it is above
    nothing. A heading without level is of level 1."""
    is_heading = F.col("kind") == "heading"
    level = F.when(is_heading, F.coalesce(F.when(F.col("level") > 0, F.col("level")), F.lit(1)))
    rows = blocks.withColumn("own", level)
    heads = rows.where("own is not null").groupBy("doc_id").agg(F.min(F.struct("pos", "own")).alias("first"), F.count_if(F.col("own") == 1).alias("tops"))
    titles = heads.where("first.own = 1 and tops = 1").select("doc_id", F.col("first.pos").alias("title_pos"))
    rows = rows.join(titles, "doc_id", "left").withColumn("is_title", F.coalesce(F.col("pos") == F.col("title_pos"), F.lit(False)))
    entries = rows.where("own is not null and not is_title").select("doc_id", "pos", F.col("own").alias("level"), F.col("text").alias("name"))
    placed = with_open(rows.select("doc_id", "pos", F.col("own").alias("level")), entries).select("doc_id", "pos", "above")
    path = F.concat(_names("above"), F.when(F.col("own").isNotNull(), F.array("text")).otherwise(F.expr("cast(array() as array<string>)")))
    out = rows.join(placed, ["doc_id", "pos"])
    return out.select(*blocks.columns, F.when(F.col("is_title"), F.col("text")).otherwise(F.array_join(path, " > ")).alias("section"))


def listing_paths(lines: DataFrame) -> DataFrame:
    """lines(doc_id, pos, width, name) of an indented listing with path, is_dir and has_children: a line is a folder if its name ends
    with a slash or the next line is indented more."""
    following = F.lead("width").over(Window.partitionBy("doc_id").orderBy("pos"))
    rows = lines.withColumn("has_children", F.coalesce(following > F.col("width"), F.lit(False)))
    rows = rows.withColumn("clean", F.regexp_replace("name", "/+$", "")).withColumn("level", F.col("width"))
    placed = with_open(rows, rows.select("doc_id", "pos", "level", F.col("clean").alias("name")))
    path = F.array_join(F.concat(_names("above"), F.array("clean")), "/")
    return placed.select(*lines.columns, path.alias("path"), (F.endswith("name", F.lit("/")) | F.col("has_children")).alias("is_dir"), "has_children")


def exercise_sections(sections: DataFrame) -> DataFrame:
    """sections(doc_id, pos, level, has_heading, has_file, bonus_title, bonus_body) with role, exercise_pos and bonus.

    A section that names a file is an exercise; those after it that are deeper, with no other between, are parts of it; all
    else is other. An exercise is bonus by its own words, or if the last section of role other with a bonus title is less deep and
    nothing as little deep came since."""
    order = Window.partitionBy("doc_id").orderBy("pos")
    rows = sections.withColumn("nth", F.sum(F.col("has_file").cast("int")).over(order))
    within = Window.partitionBy("doc_id", "nth").orderBy("pos")
    start = F.first(F.struct("pos", "level", "has_file")).over(within)
    # A section without heading belongs to nothing, and ends what came before.
    depth = F.when(F.col("has_file"), None).when(F.col("has_heading"), F.col("level")).otherwise(F.lit(-1))
    rows = rows.withColumn("start", start).withColumn("least", F.min(depth).over(within))
    part = ~F.col("has_file") & F.col("start.has_file") & (F.col("least") > F.col("start.level"))
    rows = rows.withColumn("role", F.when(F.col("has_file"), "exercise").when(part, "part").otherwise("other"))
    opens = (F.col("role") == "other") & F.col("has_heading") & F.col("bonus_title")
    rows = rows.withColumn("opened", F.sum(opens.cast("int")).over(order))
    context = Window.partitionBy("doc_id", "opened").orderBy("pos")
    outer = F.first(F.struct("level", opens.alias("opens"), "pos")).over(context)
    since = F.min(F.when(F.col("has_heading") & ~opens, F.col("level"))).over(context)
    rows = rows.withColumn("outer", outer).withColumn("since", since)
    in_bonus = F.col("outer.opens") & (F.col("since") > F.col("outer.level")) & (F.col("level") > F.col("outer.level"))
    bonus = F.when(F.col("role") == "exercise", F.coalesce(in_bonus, F.lit(False)) | F.col("bonus_title") | F.col("bonus_body"))
    return rows.select(*sections.columns, "role", F.when(F.col("role") != "other", F.col("start.pos")).alias("exercise_pos"), bonus.alias("bonus"))
