"""What a job's result says about its test: outcomes (status, kind, severity, diagnosis) of calls, scripts and imports, first rung
first, and their check rows. diagnosis is null where all is well."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import verdicts as V

_NO_OPS = "cast(array() as array<string>)"


def _tried(blocked: Column) -> Column:
    return F.size(F.coalesce(blocked, F.expr(_NO_OPS))) > 0


def _printed(text: Column) -> Column:
    return F.coalesce(text, F.lit("")) != ""


def not_run(status: Column, blocker: Column) -> Column:
    """skipped where a test has no result (null status), is blocked or met an error of the harness; null else."""
    return F.when(status.isNull() | blocker.isNotNull() | (status == "harness_error"), V.verdict("skipped", "not_run"))


def exception_outcome(expected: Column, status: Column, blocked: Column, exception: Column) -> Column:
    """Of a call that has to raise: expected and exception are names of types. Forbidden operations come before what it raised."""
    raised = (status == "exception") & exception.isNotNull() & ~_tried(blocked)
    return (
        F.when(raised & (exception == expected), V.verdict("pass", "raises")).when(raised, V.fail("wrong_exception", diagnosis="exception"))
        .otherwise(F.coalesce(V.runtime_failure(status, blocked), V.fail("no_exception", diagnosis="wrong_value")))
    )


def call_outcome(status: Column, blocker: Column, blocked: Column, exception: Column, expected_exception: Column, value: Column, stdout: Column, expected_stdout: Column, same: Column, slips: Column, may_print: Column) -> Column:
    """Of a function's test. value: the verdict on what it returned; same and slips: whether its output equals the expected one, or
    differs by slips alone; may_print: null where the function isn't known. An output is judged only after a call that ended well,
    and makes worse only what isn't failed already."""
    asked = F.when(expected_exception.isNotNull(), exception_outcome(expected_exception, status, blocked, exception)).otherwise(F.coalesce(V.runtime_failure(status, blocked), value))
    ok, judged = status == "ok", expected_stdout.isNotNull()
    differs = ok & judged & ~F.coalesce(same, F.lit(False)) & (asked["status"] != "fail")
    prints = ok & ~judged & _printed(stdout) & F.coalesce(~may_print, F.lit(False)) & (asked["status"] == "pass")
    level = F.when(slips, "minor").otherwise("major")
    outcome = F.when(differs, V.fail("stdout_mismatch", level)).when(prints, V.verdict("warning", "unexpected_stdout", "major", "unexpected_stdout")).otherwise(asked)
    return F.coalesce(not_run(status, blocker), outcome)


def script_outcome(status: Column, blocker: Column, blocked: Column, exception: Column, stdout: Column, expected_stdout: Column, match: Column, ops: Column, slips: Column, exit_code: Column, expected_exit: Column) -> Column:
    """Of a program's session: how it failed, else its output, else its exit code. match: exact or contains; ops: which of changed,
    missing and extra its diff has, none if equal. Ending by SystemExit is judged by output and code."""
    tried, left = _tried(blocked), (exception == "SystemExit") & status.isin("ok", "exception")
    failure = V.runtime_failure(status, blocked)
    named = F.coalesce(failure["diagnosis"], F.lit("script_crash"))
    named = F.when(named.isin("exception", "import_crash"), "script_crash").otherwise(named)
    critical = lambda name: F.struct(F.lit("fail").alias("status"), name.alias("kind"), F.lit("critical").alias("severity"), name.alias("diagnosis"))
    crashed = (
        F.when((exception == "EOFError") & ~tried, critical(F.lit("eof_error"))).when(left & ~tried, F.lit(None))
        .when(status.isin("ok", "exception") & exception.isNotNull() & ~tried, critical(F.lit("script_crash"))).when(failure.isNotNull(), critical(named))
    )
    name = F.when(~_printed(stdout) | (ops == F.array(F.lit("missing"))), "missing_output").when(ops == F.array(F.lit("extra")), "extra_output").otherwise("stdout_mismatch")
    level = F.when(slips, "minor").otherwise("major")
    unlike = F.struct(F.lit("fail").alias("status"), name.alias("kind"), level.alias("severity"), name.alias("diagnosis"))
    printed = F.when(expected_stdout.isNotNull(), F.when(match == "contains", F.when(~F.contains(F.coalesce(stdout, F.lit("")), expected_stdout), V.fail("missing_output"))).when(F.size(ops) > 0, unlike))
    code = F.when(exit_code != expected_exit, V.fail("exit_code"))
    return F.coalesce(not_run(status, blocker), crashed, printed, code, V.verdict("pass", "output_matches"))


def import_outcome(status: Column, blocker: Column, blocked: Column, exception: Column, n_inputs: Column, n_outputs: Column, stdout: Column, import_stdout: Column, kind: Column, side_effects: Column) -> Column:
    """Of importing an exercise's module; null, so no check, for exercises that aren't of functions and where checks of structure or
    syntax say it already. Problems only warn. side_effects: whether printing is allowed."""
    no_check = status.isNull() | (kind != "functions") | kind.isNull() | status.isin("harness_error", "syntax_error") | blocker.isNotNull()
    warn = lambda name: V.verdict("warning", name, "major", name)
    other = F.coalesce(exception != "SystemExit", F.lit(False))
    outcome = (
        F.when((n_inputs > 0) | (exception == "EOFError"), warn("import_waits_input")).when((status != "ok") | _tried(blocked) | other, warn("import_crash"))
        .when(((n_outputs > 0) | _printed(import_stdout) | _printed(stdout)) & ~F.coalesce(side_effects, F.lit(False)), warn("import_side_effects")).otherwise(V.verdict("pass", "no_side_effects"))
    )
    return F.when(~no_check, outcome)


def check_rows(outcomes: DataFrame, prefix: str) -> DataFrame:
    """(check_id, ..., status, severity, mandatory, bonus, diagnosis) of rows with id, category, required, bonus and an outcome; rows
    without an outcome give no check. check_id is prefix:id."""
    policy = V.check_policy(F.col("outcome.status"), F.col("outcome.severity"), F.col("required"), F.col("bonus"), F.col("category"))
    rows = outcomes.where("outcome is not null").withColumn("policy", policy)
    kept = [c for c in outcomes.columns if c not in ("id", "required", "bonus", "outcome", "status", "severity", "mandatory", "diagnosis", "check_id")]
    return rows.select(F.concat(F.lit(f"{prefix}:"), F.col("id").cast("string")).alias("check_id"), *kept, "policy.*", F.when(F.col("outcome.status") != "pass", F.col("outcome.diagnosis")).alias("diagnosis"))
