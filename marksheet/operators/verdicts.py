"""What the result of a job says: ordered ladders, the first rung that fits counts. Values are (kind, num, text) columns:
kind is the Python type's name, num the number of an int, float or bool, text what str() gives. Containers are tables of
their parts, see match_containers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marksheet.functions.text import strip

#: Relative and absolute tolerance of floats, words that are booleans, what float() reads.
TOLERANCE = 1e-9
BOOL_WORDS = ["True", "False", "true", "false"]
NUMERIC = r"^[+-]?(\d+(_\d+)*\.?(\d+(_\d+)*)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"
#: Status of a job that didn't end well, in the order asked, with its diagnosis.
FAILURES = {"timeout": "timeout", "output_limit": "output_limit", "import_error": "import_crash", "syntax_error": "syntax_error", "crash": "exception", "harness_error": None, "exception": "exception"}
#: A heuristic failure is one notch less severe.
HEURISTIC_SEVERITY = {"critical": "major", "major": "minor", "minor": "minor", "style": "style"}


def verdict(status: str, kind: str, severity: str | None = None, diagnosis: str | None = None) -> Column:
    return F.struct(F.lit(status).alias("status"), F.lit(kind).alias("kind"), F.lit(severity).cast("string").alias("severity"), F.lit(diagnosis).cast("string").alias("diagnosis"))


def fail(kind: str, severity: str | Column = "major", diagnosis: str | None = None) -> Column:
    level = F.lit(severity) if isinstance(severity, str) else severity
    return F.struct(F.lit("fail").alias("status"), F.lit(kind).alias("kind"), level.alias("severity"), F.lit(diagnosis or kind).alias("diagnosis"))


def runtime_failure(status: Column, blocked: Column) -> Column:
    """Null where a job ended well. blocked: the array of forbidden operations that it tried; these come first."""
    ladder = F.when(F.size(F.coalesce(blocked, F.expr("cast(array() as array<string>)"))) > 0, verdict("fail", "blocked_syscall", "critical", "blocked_syscall"))
    for name, diagnosis in FAILURES.items():
        ladder = ladder.when(status == name, verdict("fail", name, "critical", diagnosis))
    return ladder


def is_number(v: Column) -> Column:
    return v["kind"].isin("int", "float")


def close(a: Column, b: Column) -> Column:
    return (a == b) | (F.abs(a - b) <= F.greatest(F.lit(TOLERANCE) * F.greatest(F.abs(a), F.abs(b)), F.lit(TOLERANCE)))


def match(e: Column, a: Column, tolerant: Column) -> Column:
    """equal, close, int_for_float or different, by value and type; NaN equals nothing."""
    nan = F.isnan(e["num"]) | F.isnan(a["num"])
    both = is_number(e) & is_number(a)
    near = tolerant & close(e["num"], a["num"])
    return (
        F.when(both & F.coalesce(nan, F.lit(False)), "different")
        .when(both & (e["kind"] == a["kind"]), F.when(e["num"] == a["num"], "equal").when((e["kind"] == "float") & near, "close").otherwise("different"))
        .when(both & (e["kind"] == "float"), F.when((e["num"] == a["num"]) | near, "int_for_float").otherwise("different"))
        .when(both | (e["kind"] != a["kind"]), "different")
        .otherwise(F.when(e["text"].eqNullSafe(a["text"]), "equal").otherwise("different"))
    )


#: How well values match, best first, and the kinds that hold others.
MATCHES = ("equal", "close", "int_for_float", "different")
CONTAINERS = ("list", "tuple", "dict", "set", "frozenset")


def match_containers(expected: DataFrame, actual: DataFrame, compare: DataFrame) -> DataFrame:
    """How well values of any depth match: (case_id, match, tolerant) for each case of compare(case_id, compare).

    Both are tables of parts, (case_id, path, kind, num, text, size): the value itself has the path "", an item of a list or
    tuple its place, a value of a dict its key's repr, an item of a set its own repr, each after "/". Containers match if they
    are of one kind and size and each part has a counterpart; the worst part decides. A float on either side makes "auto"
    tolerant. A case without any part, or with parts of one side alone, is different."""
    floats = expected.unionByName(actual).groupBy("case_id").agg(F.bool_or(F.col("kind") == "float").alias("floats"))
    cases = compare.join(floats, "case_id", "left").select("case_id", ((F.col("compare") == "float_tolerance") | (F.col("compare") == "auto") & F.coalesce("floats", F.lit(False))).alias("tolerant"))
    part = lambda df, name: df.select("case_id", "path", F.struct("kind", "num", "text", "size").alias(name))
    both = cases.join(part(expected, "e").join(part(actual, "a"), ["case_id", "path"], "full"), "case_id", "left")
    e, a = F.col("e"), F.col("a")
    held = (e["kind"] == a["kind"]) & e["size"].eqNullSafe(a["size"])
    one = F.when(e.isNull() | a.isNull(), "different").when(e["kind"].isin(*CONTAINERS) | a["kind"].isin(*CONTAINERS), F.when(held, "equal").otherwise("different")).otherwise(match(e, a, F.col("tolerant")))
    rank = F.array_position(F.array(*map(F.lit, MATCHES)), one)
    worst = both.groupBy("case_id", "tolerant").agg(F.max(rank).alias("worst"))
    return worst.select("case_id", F.element_at(F.array(*map(F.lit, MATCHES)), F.col("worst").cast("int")).alias("match"), "tolerant")


def printed(text: Column, stdout: Column) -> Column:
    """Whether an output shows a value: as a line of its own, or anywhere if it has three characters at least."""
    lines = F.split(F.coalesce(stdout, F.lit("")), r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x85\u2028\u2029]")
    return (F.coalesce(stdout, F.lit("")) != "") & (F.exists(lines, lambda x: strip(x) == text) | (F.length(text) >= 3) & F.contains(stdout, text))


def value_verdict(e: Column, a: Column, compare: Column, stdout: Column, slip: Column) -> Column:
    """What a returned scalar says against the expected one. compare: auto, exact or float_tolerance; a.literal: the value is
    a literal (else only its text and kind are known); slip: two strings differ by slips alone."""
    tolerant = (compare == "float_tolerance") | (compare == "auto") & ((e["kind"] == "float") | (a["kind"] == "float"))
    m, other = match(e, a, tolerant), e["kind"] != a["kind"]
    bare = strip(a["text"])
    return (
        F.when(~a["literal"], F.when((e["text"] == a["text"]) & ~other, verdict("pass", "equal")).when(other, fail("wrong_type")).otherwise(fail("wrong_value")))
        .when(m == "equal", verdict("pass", "equal"))
        .when(m == "close", verdict("pass", "float_close"))
        .when(m == "int_for_float", F.when(compare == "exact", fail("wrong_type")).otherwise(verdict("warning", "int_instead_of_float", "minor", "int_instead_of_float")))
        .when((e["kind"] == "bool") & (a["kind"] == "str") & bare.isin(*BOOL_WORDS), fail("str_instead_of_bool"))
        .when(is_number(e) & (a["kind"] == "str") & bare.rlike(NUMERIC), fail("number_as_str"))
        .when((a["kind"] == "NoneType") & (e["kind"] != "NoneType"), F.when(printed(e["text"], stdout), fail("prints_instead_of_returns")).otherwise(fail("returns_none")))
        .when((e["kind"] == "str") & (a["kind"] == "str"), fail("wrong_string", F.when(slip, "minor").otherwise("major")))
        .when(other & ~(is_number(e) & is_number(a) & (e["kind"] == "float")), fail("wrong_type"))
        .otherwise(fail("wrong_value"))
    )


def type_verdict(a: Column, allowed: Column, annotated: Column, stdout: Column) -> Column:
    """Where only a type is known: allowed lists the names that it accepts, null if it can't be checked."""
    bare, has = strip(a["text"]), lambda t: F.array_contains(allowed, t)
    return (
        F.when(~annotated, verdict("pass", "no_crash"))
        .when(allowed.isNull(), verdict("pass", "type_unchecked"))
        .when(F.array_contains(allowed, a["kind"]), verdict("pass", "type_ok"))
        .when((a["kind"] == "int") & has("float"), verdict("warning", "int_instead_of_float", "minor", "int_instead_of_float"))
        .when(has("bool") & (a["kind"] == "str") & bare.isin(*BOOL_WORDS), fail("str_instead_of_bool"))
        .when((has("int") | has("float")) & (a["kind"] == "str") & bare.rlike(NUMERIC), fail("number_as_str"))
        .when(a["kind"] == "NoneType", F.when(strip(F.coalesce(stdout, F.lit(""))) != "", fail("prints_instead_of_returns")).otherwise(fail("returns_none")))
        .otherwise(fail("wrong_type"))
    )


def check_policy(outcome: Column, severity: Column, required: Column, bonus: Column, category: Column) -> Column:
    """What an outcome (pass, warning, fail, skipped) becomes: bonus items never block, heuristic ones only warn."""
    heuristic = category == "heuristic_tests"
    softer = F.coalesce(F.create_map(*[F.lit(x) for pair in HEURISTIC_SEVERITY.items() for x in pair])[F.coalesce(severity, F.lit("minor"))], F.lit("minor"))
    failed = F.when(bonus, "bonus").when(heuristic, "warning").otherwise("fail")
    status = F.when(outcome == "fail", failed).otherwise(outcome)
    level = F.when(outcome.isin("pass", "skipped"), F.lit(None)).when((outcome == "fail") & ~bonus & heuristic, softer).otherwise(severity)
    return F.struct(status.alias("status"), level.alias("severity"), (required & ~bonus & ~heuristic).alias("mandatory"), bonus.alias("bonus"))
