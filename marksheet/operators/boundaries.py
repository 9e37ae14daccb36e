"""Test cases from the rules of functions: base arguments, points around each comparison, what the first matching rule expects.

Conditions come as rows of comparisons that all have to hold; expressions are read elsewhere. Values are struct<kind, num, text>: kind the
Python type's name, num the number of an int, float or bool (0 or 1), text a string (or the repr of anything else). Tables:

functions(function_id, spec_id, name, provenance, must_return, reference), reference a value or null;
params(function_id, pos, name, annotation, default): annotation int, float, str, bool, other or null; default a value or null;
calls(function_id, pos, provenance) with args(function_id, call_pos, name, value), one row a parameter at most;
rules(function_id, rule_pos, provenance, raises, returns, returns_param); one without comparisons always holds;
comparisons(function_id, rule_pos, pos, left_param, left_value, op, right_param, right_value): a chain a < b < c is two rows; a side that
is neither a parameter nor a constant has both null and can't be evaluated.

A function's parameters, rules and comparisons are collected into one short array, as are a call's arguments; a function's calls
never are: they meet the arrays by a join on the function and are evaluated inside expressions. All joins are by shuffle, as any of the
tables may be too large for the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksheet.sources.tables import by_shuffle, once, written

from .spec_merge import free_numbers

VALUE = "struct<kind:string,num:double,text:string>"
#: Who may be relied on, whose arguments come first, what stands in for an argument, confidences, comparisons with points.
TRUSTED = ["explicit", "user", "ai_extracted"]
FIRST = ["explicit", "user"]
CONFIDENCE, AI_CONFIDENCE = 0.9, 0.6
OPS = ["<", "<=", ">", ">=", "==", "!="]


def value(kind: str | Column, num: Column | None = None, text: Column | None = None) -> Column:
    kind = F.lit(kind) if isinstance(kind, str) else kind
    none = F.lit(None)
    return F.struct(kind.alias("kind"), (none if num is None else num).cast("double").alias("num"), (none if text is None else text).cast("string").alias("text"))


def call_key(assignment: Column) -> Column:
    """Equal for calls with the same arguments: 1 and 1.0 are the same, True and 1 are not."""
    kind = lambda v: F.when(v["kind"].isin("int", "float"), "num").when(v["kind"].isin("bool", "str"), v["kind"]).otherwise("repr")
    return F.transform(assignment, lambda a: F.struct(kind(a["value"]).alias("kind"), (a["value"]["num"] + 0.0).alias("num"), a["value"]["text"].alias("text")))


def bound_calls(calls: DataFrame, args: DataFrame, params: DataFrame) -> DataFrame:
    """(function_id, pos, provenance, assignment): calls whose arguments all are parameters and leave none without a value; assignment has
    struct<pos, name, value> of each parameter in order."""
    given = args.groupBy("function_id", F.col("call_pos").alias("pos")).agg(F.collect_list(F.struct("name", "value")).alias("given"))
    slots = params.where("name IS NOT NULL").groupBy("function_id").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("name", "default").alias("param")))).alias("slots"))
    every = calls.join(by_shuffle(given), ["function_id", "pos"], "left").join(by_shuffle(slots), "function_id", "left")
    every = every.withColumn("given", F.coalesce("given", F.array().cast(f"array<struct<name:string,value:{VALUE}>>"))).withColumn("slots", F.coalesce("slots", F.array().cast(slots.schema["slots"].dataType)))
    own = lambda name: F.get(F.filter("given", lambda g: g["name"] == name), F.lit(0))["value"]
    every = once(every, assignment=F.transform("slots", lambda s: F.struct(s["pos"].alias("pos"), s["param"]["name"].alias("name"), F.coalesce(own(s["param"]["name"]), s["param"]["default"]).alias("value"))))
    known = F.forall("given", lambda g: F.exists("slots", lambda s: F.coalesce(s["param"]["name"] == g["name"], F.lit(False))))
    return every.where(known & F.forall("assignment", lambda a: a["value"].isNotNull())).select("function_id", "pos", "provenance", "assignment")


def base_values(params: DataFrame, bound: DataFrame) -> DataFrame:
    """(function_id, base): array<struct<pos, name, value, kind>> of each parameter, from the first bound call (the subject's own and the
    user's before others), else its default, else one of its type; value is null if none of these is known. kind is the simple type of
    the parameter, of its value where it isn't annotated, null where that isn't simple either."""
    first = bound.groupBy("function_id").agg(F.min_by("assignment", F.struct((~F.col("provenance").isin(FIRST)).alias("late"), "pos")).alias("first"))
    # Arguments of a type.
    of_type = F.when(F.coalesce("annotation", F.lit("int")) == "int", value("int", F.lit(1))).when(F.col("annotation") == "float", value("float", F.lit(1))).when(F.col("annotation") == "str", value("str", None, F.lit("a"))).when(F.col("annotation") == "bool", value("bool", F.lit(1)))
    own = F.get(F.filter("first", lambda a: a["name"] == F.col("name")), F.lit(0))["value"]
    rows = params.join(by_shuffle(first), "function_id", "left").withColumn("value", F.coalesce(own, F.col("default"), of_type))
    kind = F.coalesce("annotation", F.when(F.col("value.kind").isin("int", "float", "str", "bool"), F.col("value.kind")))
    return rows.groupBy("function_id").agg(F.sort_array(F.collect_list(F.struct("pos", "name", "value", kind.alias("kind")))).alias("base"))


def _of(assignment: Column, name: Column) -> Column:
    return F.get(F.filter(assignment, lambda a: a["name"] == name), F.lit(0))


def _around(const: Column, kind: Column, op: Column) -> Column:
    """Values around a constant, null where there are none."""
    num = lambda k, *cs: F.array(*[value(k, c) for c in cs])
    c, whole = const["num"], F.floor(const["num"]).cast("double")
    numeric = const["kind"].isin("int", "float") & (F.abs(c) < float("inf")) & F.coalesce(kind.isin("int", "float"), F.lit(True))
    return (
        F.when((const["kind"] == "str") & F.coalesce(kind == "str", F.lit(True)) & op.isin("==", "!="), F.array(value("str", None, const["text"])))
        .when(numeric & ((kind == "float") | (kind.isNull() & (const["kind"] == "float"))), num("float", c, c + 0.5, c - 0.5))
        .when(numeric & (whole != c), num("int", whole, whole + 1))
        .when(numeric, num("int", whole - 1, whole, whole + 1))
    )


def _beside(pivot: Column, kind: Column) -> Column:
    """Values around another parameter's base value, null where there are none."""
    p = pivot["num"]
    usable = pivot["kind"].isin("int", "float") & F.coalesce(kind.isin("int", "float"), F.lit(True))
    as_float = F.coalesce(kind == "float", F.lit(False)) | (kind.isNull() & (pivot["kind"] == "float"))
    points = lambda k, step: F.array(*[value(k, p + d) for d in (0.0, step, -step)])
    return F.when(usable & as_float, points("float", 0.5)).when(usable & ((pivot["kind"] == "int") | (F.floor(p) == p)), points("int", 1.0))


def boundary_cases(comparisons: DataFrame, base: DataFrame) -> DataFrame:
    """(function_id, rule_pos, pos, point, param, assignment): calls around every comparison of a parameter with a constant or another
    parameter, the other arguments as in base. Of equal calls of a function the first in order of rule, comparison and point."""
    c = comparisons.where(F.col("op").isin(OPS)).join(by_shuffle(base), "function_id")
    c = c.withColumn("left", _of(F.col("base"), F.col("left_param"))).withColumn("right", _of(F.col("base"), F.col("right_param")))
    l, r = F.col("left"), F.col("right")
    points = F.when(l.isNotNull() & r.isNotNull(), F.when(l["name"] != r["name"], _beside(r["value"], l["kind"]))).when(l.isNotNull(), _around(F.col("right_value"), l["kind"], F.col("op"))).when(r.isNotNull(), _around(F.col("left_value"), r["kind"], F.col("op")))
    rows = c.withColumn("param", F.coalesce(l["name"], r["name"])).select("function_id", "rule_pos", "pos", "param", "base", F.posexplode(points).alias("point", "at"))
    assignment = F.transform("base", lambda b: F.struct(b["pos"].alias("pos"), b["name"].alias("name"), F.when(b["name"] == F.col("param"), F.col("at")).otherwise(b["value"]).alias("value")))
    rows = once(rows, assignment=assignment).where(F.forall("assignment", lambda a: a["value"].isNotNull()))
    first = rows.groupBy("function_id", call_key(F.col("assignment")).alias("key")).agg(F.min(F.struct("rule_pos", "pos", "point", "param", "assignment")).alias("c"))
    return first.select("function_id", "c.*")


def _truth(c: Column, assignment: Column) -> Column:
    a, b = F.coalesce(_of(assignment, c["left_param"])["value"], c["left_value"]), F.coalesce(_of(assignment, c["right_param"])["value"], c["right_value"])
    number = lambda v: v["kind"].isin("int", "float", "bool")
    said = lambda x, y: F.when(c["op"] == "<", x < y).when(c["op"] == "<=", x <= y).when(c["op"] == ">", x > y).when(c["op"] == ">=", x >= y).when(c["op"] == "==", x == y).when(c["op"] == "!=", x != y)
    equal = (a["kind"] == b["kind"]) & a["text"].eqNullSafe(b["text"])
    holds = F.when(number(a) & number(b), said(a["num"], b["num"])).when((a["kind"] == "str") & (b["kind"] == "str"), said(a["text"], b["text"])).when(c["op"] == "==", equal).when(c["op"] == "!=", ~equal)
    return F.when(a.isNull() | b.isNull() | holds.isNull(), "error").otherwise(F.when(holds, "true").otherwise("false"))


def with_outcome(calls: DataFrame, functions: DataFrame, rules: DataFrame, comparisons: DataFrame) -> DataFrame:
    """calls(function_id, assignment, ...) with outcome: struct<kind, value, exception, rule_pos, provenance> of the first rule that holds,
    else of the reference. kind is value, raises, unknown (nothing says) or error: a rule that can't be evaluated ends the search, as
    does a comparison before a later one that fails."""
    c = comparisons.groupBy("function_id", "rule_pos").agg(F.sort_array(F.collect_list(F.struct("pos", F.struct("left_param", "left_value", "op", "right_param", "right_value").alias("c")))).alias("comparisons"))
    rule = F.struct("rule_pos", F.struct("provenance", F.when(F.col("raises") != "", F.col("raises")).alias("raises"), "returns", "returns_param", "comparisons").alias("rule"))
    programs = rules.join(by_shuffle(c), ["function_id", "rule_pos"], "left").groupBy("function_id").agg(F.sort_array(F.collect_list(rule)).alias("rules"))
    known = functions.select("function_id", F.col("reference").alias("of_reference")).join(by_shuffle(programs), "function_id", "left")
    every = calls.join(by_shuffle(known), "function_id")
    assignment = F.col("assignment")
    status = lambda r: F.coalesce(F.get(F.filter(F.transform(r["rule"]["comparisons"], lambda x: _truth(x["c"], assignment)), lambda s: s != "true"), F.lit(0)), F.lit("true"))
    met = F.get(F.filter(F.transform("rules", lambda r: F.struct(status(r).alias("status"), r["rule_pos"].alias("rule_pos"), r["rule"].alias("rule"))), lambda r: r["status"] != "false"), F.lit(0))
    every = once(every, met=met)
    r = F.col("met.rule")
    returned = F.when(r["returns_param"].isNotNull(), _of(assignment, r["returns_param"])["value"]).otherwise(r["returns"])
    gives = F.when(F.col("met").isNull(), F.col("of_reference")).when((F.col("met.status") == "true") & r["raises"].isNull(), returned)
    kind = F.when(F.col("met.status") == "error", "error").when(r["raises"].isNotNull(), "raises").when(r["returns_param"].isNotNull() & gives.isNull(), "error").when(gives.isNull(), "unknown").otherwise("value")
    failed = kind == "error"
    outcome = F.struct(kind.alias("kind"), gives.alias("value"), F.when(~failed, r["raises"]).alias("exception"), F.when(~failed, F.col("met.rule_pos")).alias("rule_pos"), F.when(~failed, r["provenance"]).alias("provenance"))
    return once(every, outcome=outcome).drop("met", "rules", "of_reference")


def trusted(functions: DataFrame, rules: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What expectations may be derived from: rules and references that weren't derived themselves."""
    reference = F.when(F.col("provenance").isin(TRUSTED), F.col("reference"))
    return functions.withColumn("reference", reference), rules.where(F.col("provenance").isin(TRUSTED))


def filled_calls(functions: DataFrame, params: DataFrame, calls: DataFrame, args: DataFrame, rules: DataFrame, comparisons: DataFrame) -> DataFrame:
    """(function_id, pos, expected, exception): what calls without an expectation are to give, where a value or an exception is known. Calls
    that have one are not asked for here; functions that needn't return give none."""
    able, sure = trusted(functions.where("must_return"), rules)
    got = with_outcome(bound_calls(calls, args, params), able, sure, comparisons).where("outcome.kind IN ('value', 'raises')")
    return got.select("function_id", "pos", F.col("outcome.value").alias("expected"), F.col("outcome.exception").alias("exception"))


def derived_tests(functions: DataFrame, params: DataFrame, calls: DataFrame, args: DataFrame, rules: DataFrame, comparisons: DataFrame, used: DataFrame) -> DataFrame:
    """(function_id, test_id, rule_pos, pos, point, assignment, expected, exception, confidence): a test for each boundary case that no
    given call makes already and whose outcome is known. Less is said for it where an extracted rule gave the case or the outcome. Ids
    are free beside used(spec_id, test_id). Calls with their arguments are written, as base values and the calls made already both read them."""
    able, sure = trusted(functions.where("must_return"), rules)
    bound = written(bound_calls(calls, args, params), "bound-calls")
    cases = boundary_cases(comparisons.join(by_shuffle(sure.select("function_id", "rule_pos", F.col("provenance").alias("said_by"))), ["function_id", "rule_pos"]).drop("said_by"), base_values(params, bound))
    taken = bound.select("function_id", call_key(F.col("assignment")).alias("key")).distinct()
    fresh = cases.withColumn("key", call_key(F.col("assignment"))).join(by_shuffle(taken), ["function_id", "key"], "left_anti").drop("key")
    told = with_outcome(fresh, able, sure, comparisons).where("outcome.kind IN ('value', 'raises')")
    told = told.join(by_shuffle(sure.select("function_id", "rule_pos", F.col("provenance").alias("said_by"))), ["function_id", "rule_pos"])
    extracted = (F.col("said_by") == "ai_extracted") | F.coalesce(F.col("outcome.provenance") == "ai_extracted", F.lit(False))
    told = told.join(by_shuffle(functions.select("function_id", "spec_id", "name")), "function_id").withColumn("prefix", F.concat("name", F.lit("#derived")))
    wanted = told.withColumn("confidence", F.when(extracted, AI_CONFIDENCE).otherwise(CONFIDENCE)).withColumn("in_rule", F.col("pos")).withColumn("pos", F.struct("function_id", "rule_pos", "in_rule", "point"))
    return free_numbers(wanted, used).select("function_id", "test_id", "rule_pos", F.col("in_rule").alias("pos"), "point", "assignment", F.col("outcome.value").alias("expected"), F.col("outcome.exception").alias("exception"), "confidence")
