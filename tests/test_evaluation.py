"""Outcomes of calls, scripts and imports against plain functions over all combinations."""

import itertools

from pyspark.sql import functions as F

from marksheet.operators import evaluation as E

STATES = ["ok", "exception", "timeout", "import_error", "crash", "harness_error", None]
DIAGNOSES = {"timeout": "timeout", "import_error": "import_crash", "crash": "exception", "exception": "exception"}
VERDICT = "struct<status: string, kind: string, severity: string, diagnosis: string>"


def failure(status, blocked):
    if blocked:
        return ("fail", "critical", "blocked_syscall")
    return ("fail", "critical", DIAGNOSES[status]) if status in DIAGNOSES else None


def call(status, blocker, blocked, raised, wanted, value, stdout, expected, slips, may_print):
    if status in (None, "harness_error") or blocker:
        return ("skipped", None, None)
    if wanted:
        if status == "exception" and raised and not blocked:
            got = ("pass", None, None) if raised == wanted else ("fail", "major", "exception")
        else:
            got = failure(status, blocked) or ("fail", "major", "wrong_value")
    else:
        got = failure(status, blocked) or value
    if status == "ok" and expected is not None:
        if stdout != expected and got[0] != "fail":
            got = ("fail", "minor" if slips else "major", "stdout_mismatch")
    elif status == "ok" and stdout and may_print is False and got[0] == "pass":
        got = ("warning", "major", "unexpected_stdout")
    return got


def script(status, blocker, blocked, raised, stdout, expected, match, ops, slips, code):
    if status in (None, "harness_error") or blocker:
        return ("skipped", None, None)
    if raised == "EOFError" and not blocked:
        return ("fail", "critical", "eof_error")
    if not (raised == "SystemExit" and status in ("ok", "exception") and not blocked):
        if status in ("ok", "exception") and raised and not blocked:
            return ("fail", "critical", "script_crash")
        got = failure(status, blocked)
        if got:
            return (*got[:2], "script_crash" if got[2] in ("exception", "import_crash") else got[2])
    if expected is not None and match == "contains" and expected not in (stdout or ""):
        return ("fail", "major", "missing_output")
    if expected is not None and match == "exact" and ops:
        why = "missing_output" if not stdout or ops == ["missing"] else "extra_output" if ops == ["extra"] else "stdout_mismatch"
        return ("fail", "minor" if slips else "major", why)
    return ("fail", "major", "exit_code") if code not in (None, 0) else ("pass", None, None)


def imported(status, blocker, blocked, raised, inputs, outputs, text, kind, allowed):
    if kind != "functions" or status in (None, "harness_error") or blocker:
        return None
    if inputs or raised == "EOFError":
        return ("warning", "major", "import_waits_input")
    if status != "ok" or blocked or raised not in (None, "SystemExit"):
        return ("warning", "major", "import_crash")
    return ("warning", "major", "import_side_effects") if (outputs or text) and not allowed else ("pass", None, None)


def outcomes(spark, cases, schema, outcome):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)], f"i int, {schema}")
    return {r.i: None if r.o is None else (r.o.status, r.o.severity, r.o.diagnosis) for r in df.select("i", outcome.alias("o")).collect()}


c = F.col


def test_calls(spark):
    values = [("pass", None, None), ("warning", "minor", "int_instead_of_float"), ("fail", "major", "wrong_type")]
    cases = list(itertools.product(STATES, [None, "file:a.py"], [None, ["open"]], [None, "ValueError", "TypeError"], [None, "ValueError"], values, ["", "x"], [None, "x"], [True, False], [None, True, False]))
    rows = [(*x[:5], (x[5][0], "k", *x[5][1:]), *x[6:]) for x in cases]
    schema = f"status string, blocker string, blocked array<string>, raised string, wanted string, value {VERDICT}, stdout string, expected string, slips boolean, may_print boolean"
    got = outcomes(spark, rows, schema, E.call_outcome(c("status"), c("blocker"), c("blocked"), c("raised"), c("wanted"), c("value"), c("stdout"), c("expected"), c("stdout") == c("expected"), c("slips"), c("may_print")))
    assert got == {i: call(*x) for i, x in enumerate(cases)}


def test_scripts(spark):
    cases = list(itertools.product(STATES, [None, "file:a.py"], [[], ["open"]], [None, "EOFError", "SystemExit", "ValueError"], [None, "", "abc"], [None, "b"], ["exact", "contains"], [[], ["missing"], ["extra"], ["changed", "extra"]], [True, False], [None, 0, 3]))
    schema = "status string, blocker string, blocked array<string>, raised string, stdout string, expected string, match string, ops array<string>, slips boolean, code int"
    got = outcomes(spark, cases, schema, E.script_outcome(c("status"), c("blocker"), c("blocked"), c("raised"), c("stdout"), c("expected"), c("match"), c("ops"), c("slips"), c("code"), F.lit(0)))
    assert got == {i: script(*x) for i, x in enumerate(cases)}


def test_imports(spark):
    cases = list(itertools.product([*STATES], [None, "file:a.py"], [None, ["open"]], [None, "EOFError", "SystemExit", "ValueError"], [0, 2], [0, 1], [None, "", "x"], ["functions", "script"], [None, True, False]))
    schema = "status string, blocker string, blocked array<string>, raised string, inputs int, outputs int, text string, kind string, allowed boolean"
    got = outcomes(spark, cases, schema, E.import_outcome(c("status"), c("blocker"), c("blocked"), c("raised"), c("inputs"), c("outputs"), F.lit(""), c("text"), c("kind"), c("allowed")))
    assert got == {i: imported(*x) for i, x in enumerate(cases)}


def test_rows_follow_the_policy(spark):
    schema = f"id string, category string, required boolean, bonus boolean, file string, outcome {VERDICT}"
    bad, well = ("fail", "k", "critical", "script_crash"), ("pass", "k", None, "kept")
    rows = [("a", "output", True, False, "f", bad), ("b", "output", True, True, "f", bad), ("c", "heuristic_tests", True, False, "f", bad), ("d", "output", True, False, "f", well), ("e", "output", True, False, "f", None)]
    got = {r.check_id: (r.status, r.severity, r.mandatory, r.diagnosis, r.file) for r in E.check_rows(spark.createDataFrame(rows, schema), "test").collect()}
    assert got == {"test:a": ("fail", "critical", True, "script_crash", "f"), "test:b": ("bonus", "critical", False, "script_crash", "f"), "test:c": ("warning", "major", False, "script_crash", "f"), "test:d": ("pass", None, True, None, "f")}
    assert E.check_rows(spark.createDataFrame([], schema), "test").count() == 0
