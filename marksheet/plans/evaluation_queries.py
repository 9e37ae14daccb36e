"""Queries of evaluated jobs as check rows, with their SQL: orders are calls, events are sessions of programs, users' events imports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.operators import evaluation as E
from marksheet.operators import verdicts as V

from . import adapters as A
from .queries import query
from .verdict_queries import _CASES, _VERDICT, cases

_STATES = ["ok", "ok", "ok", "ok", "exception", "timeout", "import_error", "crash", "syntax_error", "harness_error", "output_limit"]
_RAISED = ["EOFError", "SystemExit", "ValueError"]
_CATEGORIES = ["explicit_tests", "heuristic_tests", "output"]


def _state(n: str, step: int) -> str:
    return f"CASE WHEN {n} % 43 > 0 THEN {_STATES}[({n} // {step}) % 11 + 1] END"


def _pick(names: list[str], n: Column) -> Column:
    return F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))


def _job(n: Column, step: int) -> tuple[Column, Column, Column, Column]:
    """Status, blocker, forbidden operations and raised type of job n."""
    status = F.when(n % 43 > 0, _pick(_STATES, F.floor(n / step) % 11))
    return status, F.when(n % 41 == 0, "file:a.py"), F.when(n % 37 == 0, F.array(F.lit("open"))), F.when(n % 5 < 3, _pick(_RAISED, n % 5))


_FAILED = """CASE WHEN n % 37 = 0 THEN 'blocked_syscall' WHEN state IN ('timeout', 'output_limit', 'syntax_error') THEN state WHEN state = 'import_error' THEN 'import_crash' WHEN state IN ('crash', 'exception') THEN 'exception' END"""
_POLICY = """CASE WHEN outcome <> 'fail' THEN outcome WHEN bonus THEN 'bonus' WHEN category = 'heuristic_tests' THEN 'warning' ELSE 'fail' END AS status,
  CASE WHEN outcome IN ('pass', 'skipped') THEN NULL WHEN outcome = 'fail' AND NOT bonus AND category = 'heuristic_tests' THEN CASE level WHEN 'critical' THEN 'major' ELSE 'minor' END ELSE level END AS severity,
  required AND NOT bonus AND category <> 'heuristic_tests' AS mandatory, bonus, CASE WHEN outcome IN ('fail', 'warning') THEN why END AS diagnosis"""


@query(f"""WITH {_CASES}, {_VERDICT}, j AS (SELECT id, k AS n, {_state('k', 5)} AS state, CASE WHEN k % 5 < 3 THEN {_RAISED}[k % 5 + 1] END AS raised, CASE WHEN k % 7 = 0 THEN 'ValueError' END AS wanted, kind AS value, v.slip AS slip, stdout,
  CASE WHEN k % 8 = 3 THEN et END AS expected, {_CATEGORIES}[k % 3 + 1] AS category, k % 10 = 0 AS bonus, k % 4 > 0 AS required, CASE k % 13 WHEN 0 THEN NULL WHEN 1 THEN true ELSE false END AS may_print FROM cases JOIN v USING (id)),
a AS (SELECT *, CASE WHEN wanted IS NOT NULL AND state = 'exception' AND raised IS NOT NULL AND n % 37 > 0 THEN CASE WHEN raised = wanted THEN 'raises' ELSE 'exception' END ELSE coalesce({_FAILED}, CASE WHEN wanted IS NOT NULL THEN 'no_exception' ELSE value END) END AS kind,
  {_FAILED} AS failed FROM j),
b AS (SELECT *, CASE WHEN kind IN ('equal', 'float_close', 'raises') THEN 'pass' WHEN kind = 'int_instead_of_float' THEN 'warning' ELSE 'fail' END AS first FROM a),
c AS (SELECT *, state = 'ok' AND expected IS NOT NULL AND coalesce(stdout, '') <> expected AND first <> 'fail' AS differs, state = 'ok' AND expected IS NULL AND coalesce(stdout, '') <> '' AND may_print = false AND first = 'pass' AS prints FROM b),
d AS (SELECT *, CASE WHEN state IS NULL OR n % 41 = 0 OR state = 'harness_error' THEN 'skipped' WHEN differs THEN 'fail' WHEN prints THEN 'warning' ELSE first END AS outcome,
  CASE WHEN differs THEN CASE WHEN slip THEN 'minor' ELSE 'major' END WHEN prints THEN 'major' WHEN first = 'pass' THEN NULL WHEN kind = 'int_instead_of_float' THEN 'minor' WHEN failed IS NOT NULL AND NOT (wanted IS NOT NULL AND state = 'exception' AND raised IS NOT NULL AND n % 37 > 0) THEN 'critical'
    WHEN kind = 'wrong_string' AND slip THEN 'minor' ELSE 'major' END AS level, CASE WHEN differs THEN 'stdout_mismatch' WHEN prints THEN 'unexpected_stdout' WHEN kind = 'no_exception' THEN 'wrong_value' ELSE kind END AS why FROM c)
SELECT 'test:' || id AS check_id, category, {_POLICY} FROM d""")
def call_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, n = cases(spark, sf_dir), F.col("k")
    status, blocker, blocked, raised = _job(n, 5)
    value = V.value_verdict(F.col("e"), F.col("a"), F.col("compare"), F.col("stdout"), F.col("slip"))
    expected = F.when(n % 8 == 3, F.col("e.text"))
    may_print = F.when(n % 13 == 1, True).when(n % 13 > 1, False)
    outcome = E.call_outcome(status, blocker, blocked, raised, F.when(n % 7 == 0, "ValueError"), value, F.col("stdout"), expected, F.coalesce("stdout", F.lit("")) == expected, F.col("slip"), may_print)
    return E.check_rows(c.select("id", _pick(_CATEGORIES, n % 3).alias("category"), (n % 4 > 0).alias("required"), (n % 10 == 0).alias("bonus"), outcome.alias("outcome")), "test")


@query(f"""WITH j AS (SELECT *, {_state('n', 3)} AS state, CASE WHEN n % 5 < 3 THEN {_RAISED}[n % 5 + 1] END AS raised, {_CATEGORIES}[n % 3 + 1] AS category, n % 10 = 0 AS bonus, n % 4 > 0 AS required,
  CASE WHEN n % 6 > 0 THEN CASE WHEN n % 6 < 3 THEN t ELSE substr(t, 2, 9) END END AS expected, CASE WHEN n % 7 < 3 THEN [] ELSE [['missing'], ['extra'], ['changed'], ['changed', 'missing']][n % 4 + 1] END AS ops FROM (SELECT event_id AS n, CASE WHEN event_id % 23 > 0 THEN props END AS t FROM events)),
a AS (SELECT *, CASE WHEN raised = 'EOFError' AND n % 37 > 0 THEN 'eof_error' WHEN raised = 'SystemExit' AND state IN ('ok', 'exception') AND n % 37 > 0 THEN NULL WHEN state IN ('ok', 'exception') AND raised IS NOT NULL AND n % 37 > 0 THEN 'script_crash' ELSE replace(replace({_FAILED}, 'exception', 'script_crash'), 'import_crash', 'script_crash') END AS crash,
  CASE WHEN expected IS NULL THEN NULL WHEN n % 2 = 0 THEN CASE WHEN NOT contains(coalesce(t, ''), expected) THEN 'missing_output' END WHEN len(ops) = 0 THEN NULL WHEN coalesce(t, '') = '' OR ops = ['missing'] THEN 'missing_output' WHEN ops = ['extra'] THEN 'extra_output' ELSE 'stdout_mismatch' END AS output FROM j),
b AS (SELECT *, coalesce(crash, output, CASE WHEN n % 9 > 5 THEN 'exit_code' END) AS why FROM a),
c AS (SELECT *, CASE WHEN state IS NULL OR n % 41 = 0 OR state = 'harness_error' THEN 'skipped' WHEN why IS NULL THEN 'pass' ELSE 'fail' END AS outcome, CASE WHEN crash IS NOT NULL THEN 'critical' WHEN output IS NOT NULL AND n % 2 > 0 AND n % 11 < 4 THEN 'minor' WHEN why IS NOT NULL THEN 'major' END AS level FROM b)
SELECT 'test:' || n AS check_id, category, {_POLICY} FROM c""")
def script_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, t = F.col("id"), F.col("t")
    rows = A.table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), F.when(F.col("event_id") % 23 > 0, F.col("props")).alias("t"))
    status, blocker, blocked, raised = _job(n, 3)
    expected = F.when(n % 6 > 0, F.when(n % 6 < 3, t).otherwise(F.substring(t, 2, 9)))
    lists = [F.array(*map(F.lit, x)) for x in (["missing"], ["extra"], ["changed"], ["changed", "missing"])]
    ops = F.when(n % 7 < 3, F.expr("cast(array() as array<string>)")).otherwise(F.element_at(F.array(*lists), (n % 4 + 1).cast("int")))
    outcome = E.script_outcome(status, blocker, blocked, raised, t, expected, F.when(n % 2 == 0, "contains").otherwise("exact"), ops, n % 11 < 4, F.when(n % 9 > 5, 1).otherwise(0), F.lit(0))
    return E.check_rows(rows.select("id", _pick(_CATEGORIES, n % 3).alias("category"), (n % 4 > 0).alias("required"), (n % 10 == 0).alias("bonus"), outcome.alias("outcome")), "test")


@query(f"""WITH {A.EVENTS}, g AS (SELECT job_id AS n, count(*) FILTER (WHERE kind = 'input') AS ni, count(*) FILTER (WHERE kind = 'output') AS no FROM io GROUP BY job_id),
j AS (SELECT *, {_state('n', 1)} AS state, CASE WHEN n % 5 < 3 THEN {_RAISED}[n % 5 + 1] END AS raised FROM g),
c AS (SELECT n, 'runtime' AS category, n % 4 > 0 AS required, n % 10 = 0 AS bonus, CASE WHEN (ni > 0 AND n % 3 = 0) OR raised = 'EOFError' THEN 'import_waits_input' WHEN state <> 'ok' OR n % 37 = 0 OR raised <> 'SystemExit' THEN 'import_crash' WHEN (no > 0 AND n % 2 = 0 OR n % 6 = 1) AND n % 4 <> 2 THEN 'import_side_effects' END AS why,
  CASE WHEN why IS NULL THEN 'pass' ELSE 'warning' END AS outcome, CASE WHEN why IS NOT NULL THEN 'major' END AS level FROM j WHERE n % 8 > 0 AND state NOT IN ('harness_error', 'syntax_error') AND n % 41 > 0)
SELECT 'import_effects:' || n AS check_id, category, {_POLICY} FROM c""")
def import_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("id")
    jobs = A.io_events(spark, sf_dir).groupBy(F.col("job_id").alias("id")).agg(F.count_if(F.col("kind") == "input").alias("ni"), F.count_if(F.col("kind") == "output").alias("no"))
    status, blocker, blocked, raised = _job(n, 1)
    inputs, outputs = F.when(n % 3 == 0, F.col("ni")).otherwise(0), F.when(n % 2 == 0, F.col("no")).otherwise(0)
    outcome = E.import_outcome(status, blocker, blocked, raised, inputs, outputs, F.lit(None).cast("string"), F.when(n % 6 == 1, "x"), F.when(n % 8 > 0, "functions").otherwise("script"), n % 4 == 2)
    return E.check_rows(jobs.select("id", F.lit("runtime").alias("category"), (n % 4 > 0).alias("required"), (n % 10 == 0).alias("bonus"), outcome.alias("outcome")), "import_effects")
