"""Ordered input and output events of jobs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marksheet.functions.text import lines_kept


def output_offsets(events: DataFrame) -> DataFrame:
    """Where in a job's output the text of each output event begins and ends, in code points."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.length("text")).over(w)
    return events.where("kind = 'output'").withColumn("end_off", end).withColumn("start_off", F.col("end_off") - F.length("text"))


def consistent_offsets(events: DataFrame, outputs: DataFrame) -> DataFrame:
    """output_offsets of the events that outputs(job_id, stdout) bears out, up to the first that it doesn't (a stream may have been
    cut); events without text are left out. A job without output has none."""
    rows = output_offsets(events.where("length(text) > 0")).join(outputs.select("job_id", "stdout"), "job_id")
    so_far = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    same = F.coalesce(F.substr("stdout", (F.col("start_off") + 1).cast("int"), F.length("text")) == F.col("text"), F.lit(False))
    return rows.withColumn("same", same).withColumn("fine", F.bool_and("same").over(so_far)).where("fine").drop("same", "fine", "stdout")


def first_edit(segments: Column, actual: Column) -> Column:
    """The character of an actual line that its first difference is put down to, from 0, by segments array<struct<op, expected,
    actual>>: what is missing there belongs to who wrote the character before. Without a difference, the line's length."""
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("hit"))

    def step(s: Column, seg: Column) -> Column:
        here = F.when((seg["op"] == "delete") & (s["at"] > 0), s["at"] - 1).otherwise(s["at"])
        hit = F.when(s["hit"].isNotNull(), s["hit"]).when(seg["op"] != "equal", here)
        return F.struct((s["at"] + F.length(F.coalesce(seg["actual"], F.lit("")))).alias("at"), hit.alias("hit"))

    return F.coalesce(F.aggregate(F.coalesce(segments, F.expr("cast(array() as array<struct<op: string, expected: string, actual: string>>)")), start, step)["hit"], F.length(F.coalesce(actual, F.lit(""))))


def line_sources(lines: DataFrame, events: DataFrame, outputs: DataFrame) -> DataFrame:
    """lines(job_id, op, actual_lineno, actual, segments) of a diff with event_seq, the event that wrote the first differing
    character of a changed line, else the line's beginning; null where the stream bears out none. Line numbers count from 1."""
    parts = outputs.select("job_id", F.posexplode(lines_kept(F.col("stdout"))).alias("n", "part"))
    begins = F.coalesce(F.sum(F.length("part")).over(Window.partitionBy("job_id").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = parts.select("job_id", (F.col("n") + 1).alias("actual_lineno"), begins.alias("start"))
    rows = lines.join(starts, ["job_id", "actual_lineno"], "left").withColumn("edit", F.col("start") + F.when(F.col("op") == "changed", first_edit(F.col("segments"), F.col("actual"))).otherwise(0))
    probes = rows.where("start is not null").select("job_id", F.explode(F.array("start", "edit")).alias("off")).distinct()
    found = event_at(consistent_offsets(events, outputs), probes)
    at = lambda off, name: found.select("job_id", F.col("off").alias(off), F.col("event_seq").alias(name))
    rows = rows.join(at("edit", "by_edit"), ["job_id", "edit"], "left").join(at("start", "by_start"), ["job_id", "start"], "left")
    return rows.select(*lines.columns, F.coalesce("by_edit", "by_start").alias("event_seq"))


def event_at(offsets: DataFrame, probes: DataFrame) -> DataFrame:
    """probes(job_id, off): the event that wrote that character. An as-of join by one sort: events and probes of a job in
    the order of their offsets, and the last event before each probe."""
    a = offsets.select("job_id", F.col("start_off").alias("off"), F.lit(0).alias("is_probe"), "seq", "end_off")
    b = probes.select("job_id", F.col("off").cast("long").alias("off"), F.lit(1).alias("is_probe"), F.lit(None).cast("long").alias("seq"), F.lit(None).cast("long").alias("end_off"))
    w = Window.partitionBy("job_id").orderBy("off", "is_probe", "seq").rowsBetween(Window.unboundedPreceding, 0)
    got = F.last(F.when(F.col("is_probe") == 0, F.struct("seq", "end_off")), ignorenulls=True).over(w)
    return a.unionByName(b).withColumn("e", got).where("is_probe = 1").select("job_id", "off", F.when(F.col("e.end_off") > F.col("off"), F.col("e.seq")).alias("event_seq"))


def prompt_groups(events: DataFrame) -> DataFrame:
    """What was printed before each input (and after the last), joined in order."""
    w = Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where("kind in ('output', 'input')").withColumn("grp", F.coalesce(F.sum(F.when(F.col("kind") == "input", 1).otherwise(0)).over(w), F.lit(0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == "output", F.struct("seq", "text")))), lambda x: x["text"]), "")
    return rows.groupBy("job_id", "grp").agg(text.alias("prompt"), F.max(F.when(F.col("kind") == "input", F.col("text"))).alias("answer"))


def after_consuming(events: DataFrame, consumed: DataFrame) -> DataFrame:
    """Events of the call itself: of each job, those before which at least consumed(job_id, chars) characters were printed
    (null or 0: all). Of any kind; once reached, all later ones."""
    before = F.sum(F.when(F.col("kind") == "output", F.length("text")).otherwise(0)).over(Window.partitionBy("job_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    rows = events.withColumn("printed", F.coalesce(before, F.lit(0))).join(consumed, "job_id", "left")
    return rows.where(F.col("printed") >= F.coalesce("chars", F.lit(0))).drop("printed", "chars")


def steps_io(steps: DataFrame) -> DataFrame:
    """A session's standard input (a line for each input step) and expected output."""
    pick = lambda kind, tail: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, F.struct("step_no", "text")))), lambda s: F.concat(s["text"], F.lit(tail))), "")
    return steps.groupBy("session_id").agg(pick("input", "\n").alias("stdin"), pick("output", "").alias("stdout"))


def merge_steps(steps: DataFrame) -> DataFrame:
    """Neighbouring outputs become one, inputs stay; empty outputs are dropped first. A last output loses its blank tail but
    for one line end, and goes if it is blank."""
    w = Window.partitionBy("session_id").orderBy("step_no")
    kept = steps.where("kind <> 'output' or text <> ''")
    new = (F.col("kind") != "output") | ~F.coalesce(F.lag("kind").over(w) == "output", F.lit(False))
    rows = kept.withColumn("new", new.cast("int")).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step_no", "text"))), lambda s: s["text"]), "")
    merged = rows.groupBy("session_id", "island", "kind").agg(text.alias("text"), F.count("*").alias("steps"))
    last = (F.col("island") == F.max("island").over(Window.partitionBy("session_id"))) & (F.col("kind") == "output")
    cut = F.regexp_replace("text", r"(?:\n[ \t]*)+\z", "\n")
    tail = F.when(F.endswith(cut, F.lit("\n")), cut).otherwise(F.concat(cut, F.lit("\n")))
    return merged.withColumn("last", last).where(~F.col("last") | F.col("text").rlike(r"(?U)\S")).withColumn("text", F.when(F.col("last"), tail).otherwise(F.col("text"))).drop("last")


def merge_intervals(spans: DataFrame) -> DataFrame:
    """Overlapping or touching (start, stop) of a document become one. Spans without start come last, each by itself; one without stop
    comes after those of its start and reaches no further than they do."""
    w = Window.partitionBy("doc_id").orderBy(F.asc_nulls_last("start"), F.asc_nulls_last("stop"))
    before = F.max("stop").over(w.rowsBetween(Window.unboundedPreceding, -1))
    rows = spans.withColumn("new", F.coalesce((F.col("start") > before).cast("int"), F.lit(1))).withColumn("island", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return rows.groupBy("doc_id", "island").agg(F.min("start").alias("start"), F.max("stop").alias("stop"))


def best_session(sessions: DataFrame) -> DataFrame:
    """Of each script, the first with the most prompts."""
    w = Window.partitionBy("script_id").orderBy(F.desc("prompts"), "session_id")
    return sessions.withColumn("k", F.row_number().over(w)).where("k = 1").drop("k")


def job_states(progress: DataFrame) -> DataFrame:
    """Progress never falls; the stage is the last that was told."""
    return progress.groupBy("job_id").agg(F.max(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("progress")))).alias("progress"), F.max_by("stage", "seq").alias("stage"))
