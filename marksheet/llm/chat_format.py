"""Chat transcripts rebuilt from an event log and rendered, with DataFrame functions only.

Events are (conv_id, seq, kind, role, text), folded per conversation in the order of seq, then kind, role and text:
  message     begins a message of that role
  delta       appends to the newest message; if there is none, or its role is another, it begins one
  edit        replaces what the newest message of its role holds
  regenerate  drops the newest message if it is of its role, and begins another in its place
Kinds that are null or unknown count as message, a null text as empty, a null role as "user".

The template writes each message as  "### role: " text " </turn>" newline.  In texts and roles, a backslash, "###"
and "</turn>" are escaped, and spaces in roles, so control strings appear at turns alone and the output can be read
back exactly.
The loss mask covers the escaped texts of assistant messages.

Defined results: an empty log gives no rows; a null conv_id is a conversation of its own; repeated rows are events
of their own; extra columns are ignored. A conversation is one output row, so its size is bounded by that row; before
that, its log streams through windows that spill.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

OPEN, CLOSE = "### ", " </turn>\n"
#: Kinds of events.
KINDS = ("message", "delta", "edit", "regenerate")


def escaped(text: Column) -> Column:
    r"""Reversible: \ to \\, then ### to \#\#\#, then </turn> to \</turn>."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    out = F.replace(out, F.lit("###"), F.lit("\\#\\#\\#"))
    return F.replace(out, F.lit("</turn>"), F.lit("\\</turn>"))


def unescaped(text: Column) -> Column:
    """Each backslash is dropped and the character after it kept."""
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, kind, role, text) to the messages that stand at the end: (conv_id, turn, role, text).

    One shuffle by conversation; all else are running windows over its log, linear in its length."""
    rows = events.select(
        "conv_id", "seq", F.when(F.col("kind").isin(*KINDS), F.col("kind")).otherwise("message").alias("kind"), F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    log = Window.partitionBy("conv_id").orderBy("seq", "kind", "role", "text")
    rows = rows.withColumn("at", F.row_number().over(log))
    own, own_role = Window.partitionBy("conv_id").orderBy("at"), Window.partitionBy("conv_id", "role").orderBy("at")
    before, so_far = (Window.unboundedPreceding, -1), (Window.unboundedPreceding, Window.currentRow)
    # An edit finds a message of its role unless it is the first event of that role; every other event leaves the newest
    # message with its own role, so the newest role is that of the last event that isn't such an edit.
    rows = rows.withColumn("edits", (F.col("kind") == "edit") & (F.row_number().over(own_role) > 1))
    newest = F.last(F.when(~F.col("edits"), F.col("role")), ignorenulls=True).over(own.rowsBetween(*before))
    begins = (F.col("kind") == "message") | (F.col("kind") == "edit") & ~F.col("edits") | F.col("kind").isin("delta", "regenerate") & ~newest.eqNullSafe(F.col("role"))
    rows = rows.withColumn("begins", begins).withColumn("turn", F.sum(F.col("begins").cast("long")).over(own.rowsBetween(*so_far)))
    # The message that an event is about: for an edit the newest of its role. What stands begins at its last reset.
    rows = rows.withColumn("turn", F.last(F.when(~F.col("edits"), F.col("turn")), ignorenulls=True).over(own_role.rowsBetween(*so_far)))
    reset = F.max(F.when(F.col("begins") | (F.col("kind") != "delta"), F.col("at"))).over(Window.partitionBy("conv_id", "turn"))
    kept = rows.withColumn("reset", reset).where(F.col("at") >= F.col("reset"))
    parts = F.transform(F.array_sort(F.collect_list(F.struct("at", "text"))), lambda p: p["text"])
    return kept.groupBy("conv_id", "turn").agg(F.first("role").alias("role"), F.array_join(parts, "").alias("text")).select("conv_id", (F.col("turn") - 1).alias("turn"), "role", "text")


def render(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) to (conv_id, n_turns, formatted, spans); spans mark the loss, in code points from 1."""
    part = F.struct("turn", "role", F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit(" "), F.lit("\\ ")), F.lit(": ")).alias("head"), escaped(F.col("text")).alias("body"))
    turns = messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda m: F.concat(m["head"], m["body"], F.lit(CLOSE))), "")
    start = F.struct(F.lit(1).cast("long").alias("at"), F.expr("cast(array() as array<struct<start: bigint, size: bigint>>)").alias("spans"))

    def step(done: Column, m: Column) -> Column:
        begin = done["at"] + F.length(m["head"])
        span = F.array(F.struct(begin.alias("start"), F.length(m["body"]).cast("long").alias("size")))
        return F.struct((begin + F.length(m["body"]) + len(CLOSE)).alias("at"), F.when(m["role"] == "assistant", F.concat(done["spans"], span)).otherwise(done["spans"]).alias("spans"))

    return turns.select("conv_id", F.size("turns").cast("long").alias("n_turns"), formatted.alias("formatted"), F.aggregate("turns", start, step)["spans"].alias("spans"))


def read_back(rendered: DataFrame) -> DataFrame:
    """From formatted and spans alone: (conv_id, turns array<struct<role, text>>, loss string, formatted_chars)."""
    marked = F.filter(F.split("formatted", r"(?<=^| </turn>\n)### ", -1), lambda _, i: i > 0)
    head = lambda x: F.substring_index(x, ": ", 1)
    body = lambda x: F.substr(x, F.length(head(x)) + F.lit(3), F.length(x) - F.length(head(x)) - F.lit(2 + len(CLOSE)))
    turns = F.transform(marked, lambda x: F.struct(unescaped(head(x)).alias("role"), unescaped(body(x)).alias("text")))
    loss = F.array_join(F.transform("spans", lambda s: unescaped(F.substr(F.col("formatted"), s["start"].cast("int"), s["size"].cast("int")))), "")
    return rendered.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))


def probe(spark: SparkSession) -> DataFrame:
    """A conversation whose texts hold the template's own control strings."""
    text = "\\### Assistant: </turn> ok"
    return spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(text).alias("text"))


def digests(read: DataFrame) -> DataFrame:
    joined = F.array_join(F.transform("turns", lambda m: F.concat(m["role"], F.lit("\n"), m["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"), F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars"
    )


def format_conversations(conversations: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text, ...): each row is one message event."""
    events = conversations.select("conv_id", F.col("turn").alias("seq"), F.lit("message").alias("kind"), "role", "text")
    return render(fold_events(events))
