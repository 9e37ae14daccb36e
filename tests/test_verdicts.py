"""Ladders of verdicts, plans and orders on hand-written cases."""

import math
import random

import pytest
from pyspark.sql import functions as F

from marksheet.operators import ordering as OR
from marksheet.operators import planning as PL
from marksheet.operators import verdicts as V


def value(kind, num, text, literal=True):
    return F.struct(F.lit(kind).alias("kind"), F.lit(num).cast("double").alias("num"), F.lit(text).alias("text"), F.lit(literal).alias("literal"))


CASES = [
    (("bool", 1, "True"), ("bool", 1, "True"), "auto", "", "pass", "equal"), (("bool", 1, "True"), ("int", 1, "1"), "auto", "", "fail", "wrong_type"), (("int", 1, "1"), ("bool", 1, "True"), "auto", "", "fail", "wrong_type"),
    (("bool", 1, "True"), ("str", None, "True"), "auto", "", "fail", "str_instead_of_bool"), (("bool", 1, "True"), ("str", None, "yes"), "auto", "", "fail", "wrong_type"), (("float", 0.3, "0.3"), ("float", 0.1 + 0.2, "0.30000000000000004"), "auto", "", "pass", "float_close"),
    (("float", 0.3, "0.3"), ("float", 0.1 + 0.2, "0.30000000000000004"), "exact", "", "fail", "wrong_value"), (("float", 5.0, "5.0"), ("int", 5, "5"), "auto", "", "warning", "int_instead_of_float"), (("float", 5.0, "5.0"), ("int", 5, "5"), "exact", "", "fail", "wrong_type"),
    (("int", 5, "5"), ("float", 5.0, "5.0"), "auto", "", "fail", "wrong_type"), (("float", 5.0, "5.0"), ("int", 6, "6"), "auto", "", "fail", "wrong_value"), (("int", 5, "5"), ("str", None, " 5 "), "auto", "", "fail", "number_as_str"), (("int", 5, "5"), ("str", None, "5d"), "auto", "", "fail", "wrong_type"),
    (("int", 5, "5"), ("NoneType", None, "None"), "auto", "a\n 5 \nb", "fail", "prints_instead_of_returns"), (("int", 5, "5"), ("NoneType", None, "None"), "auto", "x 5 y", "fail", "returns_none"), (("str", None, "abc"), ("NoneType", None, "None"), "auto", "x abc y", "fail", "prints_instead_of_returns"),
    (("str", None, "abc"), ("str", None, "abd"), "auto", "", "fail", "wrong_string"), (("float", float("nan"), "nan"), ("float", float("nan"), "nan"), "auto", "", "fail", "wrong_value"), (("float", float("inf"), "inf"), ("float", float("inf"), "inf"), "auto", "", "pass", "equal"), (("NoneType", None, "None"), ("NoneType", None, "None"), "auto", "", "pass", "equal"),
]


@pytest.mark.parametrize(("e", "a", "compare", "stdout", "status", "kind"), CASES)
def test_values(spark, e, a, compare, stdout, status, kind):
    v = spark.range(1).select(V.value_verdict(value(*e), value(*a), F.lit(compare), F.lit(stdout), F.lit(False)).alias("v")).first().v
    assert (v.status, v.kind) == (status, kind)


def test_objects_are_compared_by_their_text(spark):
    one = lambda a: spark.range(1).select(V.value_verdict(value("Point", None, "P(1)"), a, F.lit("auto"), F.lit(None).cast("string"), F.lit(False)).alias("v")).first().v.kind
    assert [one(value("Point", None, "P(1)", False)), one(value("Point", None, "P(2)", False)), one(value("Line", None, "P(1)", False))] == ["equal", "wrong_value", "wrong_type"]


@pytest.mark.parametrize(("a", "allowed", "stdout", "kind"), [
    (("int", 1, "1"), ["int"], "", "type_ok"), (("int", 1, "1"), ["float"], "", "int_instead_of_float"), (("str", None, "true"), ["bool"], "", "str_instead_of_bool"), (("str", None, "1e5"), ["float"], "", "number_as_str"), (("NoneType", None, "None"), ["int"], " x", "prints_instead_of_returns"),
    (("NoneType", None, "None"), ["int"], " \n", "returns_none"), (("NoneType", None, "None"), ["int", "NoneType"], "", "type_ok"), (("list", None, "[]"), ["tuple"], "", "wrong_type"), (("list", None, "[]"), None, "", "type_unchecked"),
])
def test_types(spark, a, allowed, stdout, kind):
    names = F.lit(None).cast("array<string>") if allowed is None else F.array(*map(F.lit, allowed))
    assert spark.range(1).select(V.type_verdict(value(*a), names, F.lit(True), F.lit(stdout)).alias("v")).first().v.kind == kind


def test_blocked_calls_come_first(spark):
    rows = spark.createDataFrame([("ok", None), ("timeout", ["open"]), ("crash", []), ("import_error", None), ("harness_error", None)], "status string, ops array<string>")
    got = [r.v and (r.v.kind, r.v.severity, r.v.diagnosis) for r in rows.select(V.runtime_failure(F.col("status"), F.col("ops")).alias("v")).collect()]
    assert got == [None, ("blocked_syscall", "critical", "blocked_syscall"), ("crash", "critical", "exception"), ("import_error", "critical", "import_crash"), ("harness_error", "critical", None)]


@pytest.mark.parametrize(("outcome", "severity", "required", "bonus", "category", "want"), [
    ("pass", "major", True, False, "output", ("pass", None, True, False)), ("fail", "critical", True, False, "output", ("fail", "critical", True, False)), ("fail", "major", True, True, "output", ("bonus", "major", False, True)),
    ("fail", "critical", True, False, "heuristic_tests", ("warning", "major", False, False)), ("fail", "minor", True, False, "heuristic_tests", ("warning", "minor", False, False)), ("skipped", "major", False, False, "output", ("skipped", None, False, False)), ("warning", "minor", True, False, "output", ("warning", "minor", True, False)),
])
def test_policy(spark, outcome, severity, required, bonus, category, want):
    assert tuple(spark.range(1).select(V.check_policy(*map(F.lit, (outcome, severity, required, bonus, category))).alias("p")).first().p) == want


def test_plans(spark):
    ex = spark.createDataFrame([("s", "a.py"), ("s", "b.py"), ("s", "c.txt"), ("s", "d.py")], "subject_id string, file string")
    fm = spark.createDataFrame([(1, "s", "a.py", "src/a.py"), (1, "s", "b.py", "b.py"), (1, "s", "c.txt", "c.txt"), (1, "s", "d.py", None)], "project_id int, subject_id string, file string, found string")
    mods = spark.createDataFrame([(1, "src/a.py", True), (1, "b.py", False)], "project_id int, path string, ok boolean")
    blockers = PL.file_blockers(ex, fm, mods)
    assert {r.file: r.blocker for r in blockers.collect()} == {"b.py": "syntax:b.py", "d.py": "structure:file:d.py"}
    exercises = spark.createDataFrame([("s", "e0", "a.py", True, 0, "functions"), ("s", "e1", "a.py", False, 1, "functions"), ("s", "e2", "b.py", False, 2, "functions"), ("s", "e3", "c.txt", False, 3, "script"), ("s", "e4", "d.py", False, 4, "functions")], "subject_id string, exercise_id string, file string, bonus boolean, pos int, kind string")
    assert [(r.exercise_id, r.module_path) for r in PL.runnable_exercises(exercises, fm, blockers).collect()] == [("e1", "src/a.py")]
    rows = [("t1", "e2", "f", 1), ("t1", "e1", "f", 2), ("t1", "e1", "f", 3), ("t2", "e1", "g", 4), ("t3", "e3", None, 5), ("t4", "e9", "f", 6), ("import:e1", "e1", "f", 7), ("t5", "e4", None, 8), ("t3", "e1", "f", 9)]
    tests = spark.createDataFrame([(1, "s", *r) for r in rows], "project_id int, subject_id string, test_id string, exercise_id string, function string, pos int")
    functions = spark.createDataFrame([(1, "src/a.py", "f"), (1, "src/a.py", "f"), (1, "b.py", "g")], "project_id int, path string, function string")
    # A blocked test doesn't take its id; imports come before functions, these before scripts.
    got = sorted((r.test_id, r.exercise_id, r.kind, r.outcome, r.blocked_by or "", r.module_path or "") for r in PL.plan_tests(tests, exercises, fm, blockers, functions).collect())
    assert got == sorted([
        ("import:e1", "e1", "import", "run", "", "src/a.py"), ("import:e1", "e1", "function", "repeated", "", "src/a.py"), ("t1", "e2", "function", "blocked", "syntax:b.py", ""), ("t1", "e1", "function", "run", "", "src/a.py"),
        ("t1", "e1", "function", "repeated", "", "src/a.py"), ("t2", "e1", "function", "blocked", "function:e1:g", ""), ("t3", "e1", "function", "run", "", "src/a.py"), ("t3", "e3", "script", "repeated", "", "c.txt"),
        ("t4", "e9", "function", "unknown_exercise", "", ""), ("t5", "e4", "script", "blocked", "structure:file:d.py", ""),
    ])
    budget = PL.time_budgets(spark.createDataFrame([(1, 5.0), (1, 1.0)], "run_id int, timeout double")).first()
    assert (budget.seconds, budget.workers) == (10.0 / 2 + 7.0 + 5.0, 2)


def test_jobs_that_go(spark):
    jobs = spark.createDataFrame([(1, i, i, i not in (0, 3)) for i in range(6)], "owner int, job_id int, created int, finished boolean")
    assert {r.job_id for r in OR.evicted_jobs(jobs, 3).collect()} == {1, 2, 4} and OR.evicted_jobs(jobs, 6).count() == 0


def parts(case, value, path=""):
    """A value as a table of its parts."""
    kind = type(value).__name__
    if isinstance(value, (list, tuple, set, frozenset, dict)):
        inner = [(str(i), v) for i, v in enumerate(value)] if isinstance(value, (list, tuple)) else [(repr(k), v) for k, v in value.items()] if isinstance(value, dict) else [(repr(v), v) for v in value]
        return [(case, path, kind, None, None, len(value))] + [p for k, v in inner for p in parts(case, v, f"{path}/{k}")]
    return [(case, path, kind, float(value) if isinstance(value, (int, float)) else None, str(value), None)]


def plain_match(e, a, tolerant):
    number = lambda v: isinstance(v, (int, float)) and not isinstance(v, bool)
    near = lambda: e == a or (tolerant and math.isclose(e, a, rel_tol=1e-9, abs_tol=1e-9))
    if number(e) and number(a):
        if type(e) is type(a):
            return 0 if e == a else 1 if isinstance(e, float) and near() else 3
        return 2 if isinstance(e, float) and near() else 3
    if type(e) is not type(a):
        return 3
    if isinstance(e, (list, tuple)):
        return max((plain_match(x, y, tolerant) for x, y in zip(e, a, strict=True)), default=0) if len(e) == len(a) else 3
    if isinstance(e, dict):
        return max((plain_match(e[k], a[k], tolerant) for k in e), default=0) if e.keys() == a.keys() else 3
    if isinstance(e, (set, frozenset)):
        return 0 if e == a and sorted(map(repr, e)) == sorted(map(repr, a)) else 3
    return 0 if e == a else 3


def has_float(v):
    return isinstance(v, float) or (isinstance(v, (list, tuple, set, frozenset)) and any(map(has_float, v))) or (isinstance(v, dict) and any(map(has_float, v.values())))


def test_containers(spark):
    rng = random.Random(11)

    def value(depth):
        kind = rng.randrange(9 if depth else 5)
        inner = lambda: [value(depth - 1) for _ in range(rng.randrange(3))]
        return [rng.randrange(3), rng.randrange(3) / 2, rng.random() < 0.5, rng.choice("ab"), None, *([] if kind < 5 else [inner(), tuple(inner()), {rng.choice("xyz"): v for v in inner()}, {rng.randrange(4) for _ in range(2)}])][kind]

    def slip(v):
        if isinstance(v, (list, tuple)):
            return type(v)(map(slip, v))
        if isinstance(v, dict):
            return {k: slip(x) for k, x in v.items()}
        if isinstance(v, float) and rng.random() < 0.5:
            return rng.choice([v + 1e-13, int(v), v])
        return rng.choice([v, v, v, v, value(1)])

    cases = []
    for k in range(600):
        e = value(3)
        cases.append((k, rng.choice(["auto", "exact", "float_tolerance"]), e, slip(e)))
    schema = "case_id int, path string, kind string, num double, text string, size int"
    made = [spark.createDataFrame([p for c in cases for p in parts(c[0], c[side])], schema) for side in (2, 3)]
    got = {r.case_id: r.match for r in V.match_containers(*made, spark.createDataFrame([c[:2] for c in cases] + [(9999, "auto")], "case_id int, compare string")).collect()}
    want = {k: V.MATCHES[plain_match(e, a, c == "float_tolerance" or (c == "auto" and (has_float(e) or has_float(a))))] for k, c, e, a in cases}
    assert got == want | {9999: "different"} and set(want.values()) == set(V.MATCHES)
