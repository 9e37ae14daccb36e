"""Which string literal of a module most likely printed a text.

Five tiers: the literal is the text; a template whose places ({}) fit it; a literal that holds it; a literal whose parts all
stand in it; a common piece of MIN_COMMON characters at least, in any case. Within a tier, arguments of print and input come
first, then longer literals (shorter ones where the literal holds the text; the longer common piece), then earlier lines, then
the order of the literals.

Pairs to compare share a run of MIN_COMMON characters; literals with places or fewer characters than that, and texts as
short, are compared with all of their module. Null or blank texts and literals match nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksheet.sources.tables import by_shuffle, once

#: Characters in common at least, and the calls whose arguments come first.
MIN_COMMON, IO_CALLS = 4, ("print", "input")
_SPACE_ENDS = r"(?U)\A[\s\x1c-\x1f]+|[\s\x1c-\x1f]+\z"


def _strip(s: Column) -> Column:
    return F.regexp_replace(s, _SPACE_ENDS, "")


def longest_common(a: Column, b: Column) -> Column:
    """Length of the longest piece that both hold, by bisection: who holds one of n characters holds one of n - 1."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)

    def held(s: Column) -> Column:
        def halve(lohi: Column, _: Column) -> Column:
            mid = F.ceil((lohi["lo"] + lohi["hi"]) / 2).cast("int")
            pieces = F.sequence(F.lit(1), F.length(s["short"]) - mid + 1)
            has = (lohi["lo"] == lohi["hi"]) | F.exists(pieces, lambda i: F.contains(s["long"], F.substr(s["short"], i, mid)))
            return F.struct(F.when(has, mid).otherwise(lohi["lo"]).alias("lo"), F.when(has, lohi["hi"]).otherwise(mid - 1).alias("hi"))

        start = F.struct(F.lit(0).alias("lo"), F.length(s["short"]).alias("hi"))
        return F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(F.length(s["short"]) + 1)).cast("int")), start, halve)["lo"]

    # One element, so that both strings are worked out once.
    return F.element_at(F.transform(F.array(F.struct(short.alias("short"), long.alias("long"))), held), 1)


def template_pattern(value: Column) -> Column:
    """A pattern that the whole of a text printed by the template fits."""
    parts = F.transform(F.split(value, r"\{\}", -1), lambda p: F.regexp_replace(p, r"([\\.\[\]{}()*+?^$|&~#-])", r"\\$1"))
    return F.concat(F.lit(r"(?s)\A"), F.array_join(parts, ".*"), F.lit(r"\z"))


def _told(tier: int, in_call: Column, n: Column, line: Column) -> Column:
    io = F.coalesce(in_call.isin(*IO_CALLS), F.lit(False)).cast("int")
    return F.struct(F.lit(tier).alias("tier"), io.alias("io"), n.cast("int").alias("n"), (-line).alias("line"))


def scored(pairs: DataFrame) -> DataFrame:
    """pairs(text, value, is_template, in_call, line, ...) with score, (tier, io, n, line), that sorts as the tiers do; null where
    nothing matches. The longest common piece is looked for where no higher tier holds."""
    text, value, call, line = (F.col(c) for c in ("text", "value", "in_call", "line"))
    fixed = F.replace(value, F.lit("{}"), F.lit(""))
    parts = F.filter(F.split(value, r"\{\}", -1), lambda p: p != "")
    high = (
        F.when(value == text, _told(5, call, F.length(value), line))
        .when(F.coalesce(F.col("is_template"), F.lit(False)) & F.rlike(text, template_pattern(value)), _told(4, call, F.length(value), line))
        .when(F.contains(value, text), _told(3, call, -F.length(value), line))
        .when((F.length(_strip(fixed)) >= MIN_COMMON) & F.forall(parts, lambda p: F.contains(text, p)), _told(2, call, F.length(fixed), line))
    )
    rows = once(once(pairs, high=high), common=F.when(F.col("high").isNull(), longest_common(F.lower(text), F.lower(fixed))))
    return once(rows, score=F.coalesce("high", F.when(F.col("common") >= MIN_COMMON, _told(1, call, F.col("common"), line)))).drop("high", "common")


def _runs(s: Column) -> Column:
    n = F.length(s) - (MIN_COMMON - 1)
    return F.when(n > 0, F.array_distinct(F.transform(F.sequence(F.lit(1), n), lambda i: F.substr(s, i, F.lit(MIN_COMMON)))))


def locate_texts(texts: DataFrame, literals: DataFrame) -> DataFrame:
    """texts(text_id, module_id, text) and literals(module_id, pos, value, line, in_call, is_template) to the literal of each
    text that has one: (text_id, module_id, pos, tier, io, n, line)."""
    ends = r"\A[\r\n]+|[\r\n]+\z"
    asked = texts.where("text is not null").select("text_id", "module_id", F.regexp_replace("text", ends, "").alias("text")).where(_strip(F.col("text")) != "")
    # A text that many outputs share is compared once with its module.
    one = asked.select("module_id", "text").distinct()
    known = literals.where(F.col("value").isNotNull() & (_strip(F.col("value")) != ""))
    fixed = F.lower(F.replace("value", F.lit("{}"), F.lit("")))
    a = one.select("module_id", "text", F.explode(_runs(F.lower("text"))).alias("run"))
    b = known.select("module_id", "pos", F.explode(_runs(fixed)).alias("run"))
    sharing = a.join(by_shuffle(b), ["module_id", "run"]).select("module_id", "text", "pos")
    # Where either side is short, its own few rows are what the join begins with.
    brief, open_ = F.length("text") < MIN_COMMON, F.contains("value", F.lit("{}")) | (F.length(fixed) < MIN_COMMON)
    loose = one.where(brief).join(by_shuffle(known.select("module_id", "pos")), "module_id").unionByName(one.where(~brief).join(by_shuffle(known.where(open_).select("module_id", "pos")), "module_id"))
    pairs = sharing.unionByName(loose.select("module_id", "text", "pos")).distinct().join(by_shuffle(known), ["module_id", "pos"])
    best = scored(pairs).where("score is not null").groupBy("module_id", "text").agg(F.max(F.struct("score", (-F.col("pos")).alias("back"))).alias("best"))
    named = asked.join(by_shuffle(best), ["module_id", "text"])
    return named.select("text_id", "module_id", (-F.col("best.back")).alias("pos"), "best.score.tier", "best.score.io", "best.score.n", (-F.col("best.score.line")).alias("line"))
