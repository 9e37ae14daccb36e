"""Named queries: an operator over the driver's tables, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marksheet import schema
from marksheet.functions import scores as S
from marksheet.functions import text as X
from marksheet.operators import events as EV
from marksheet.operators import history as H
from marksheet.operators import scoring as SC
from marksheet.operators import source_facts as SF
from marksheet.operators import structure as ST
from marksheet.operators import textdiff as TD

from . import adapters as A

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def deduped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.dedupe_checks(A.checks(spark, sf_dir))


PERCENT = "CASE WHEN {t} <= 0 THEN NULL WHEN {p} < {t} AND round_even(100.0::DOUBLE * {p} / {t}, 1) >= 100 THEN 99.9 ELSE round_even(100.0::DOUBLE * {p} / {t}, 1) END"


def pct(p: str, t: str) -> str:
    return PERCENT.format(p=p, t=t)


# ---------------------------------------------------------------- scoring


@query(f"""WITH {A.CHECKS}, g AS (SELECT run_id, category, count(*) FILTER (WHERE counted AND status IN ('pass','warning')) AS passed, count(*) FILTER (WHERE counted) AS total,
  count(*) FILTER (WHERE counted AND status IN ('fail','skipped')) AS failed, count(*) FILTER (WHERE status = 'warning') AS warnings FROM counted GROUP BY ALL)
SELECT *, {pct('passed', 'total')} AS score FROM g WHERE total > 0""")
def flagship_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.category_scores(deduped(spark, sf_dir)).drop("place")


@query(f"WITH {A.CHECKS} SELECT run_id, check_id, status, severity, position.hi AS position_hi, position.lo AS position_lo FROM deduped")
def dedupe_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduped(spark, sf_dir).select("run_id", "check_id", "status", "severity", F.col("position.hi").alias("position_hi"), F.col("position.lo").alias("position_lo"))


@query(f"""WITH {A.CHECKS}, g AS (SELECT run_id, count(*) FILTER (WHERE counted) AS total, count(*) FILTER (WHERE counted AND status IN ('pass','warning')) AS passed, count(*) FILTER (WHERE counted AND status IN ('fail','skipped')) AS failures,
  coalesce(bool_or(counted AND status IN ('fail','skipped') AND severity = 'critical'), false) AS critical,
  {', '.join(f"count(*) FILTER (WHERE status = '{s}') AS n_{s}" for s in schema.STATUS_REPORT)}, {', '.join(f"count(*) FILTER (WHERE status IN ('fail','skipped') AND severity = '{s}') AS failing_{s}" for s in schema.SEVERITY)}
  FROM counted GROUP BY run_id)
SELECT *, coalesce({pct('passed', 'total')}, 0) AS readiness, CASE WHEN total > 0 AND failures = 0 THEN 'ready' ELSE 'not_ready' END AS verdict,
  CASE WHEN total = 0 THEN '{schema.NO_REQUIREMENT}' WHEN failures = 0 THEN '{schema.READY}' ELSE failures || ' mandatory failure(s) remain.' || CASE WHEN critical THEN '{schema.CRITICAL_FIRST}' ELSE '' END END AS message FROM g""")
def run_readiness(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.readiness(deduped(spark, sf_dir))


_SPEC = f"{A.CHECKS}, {A.RUNS}, {A.EXERCISES}, {A.FILES}, {A.LOCATED}"
_PROGRESS = "(status IN ('pass','warning','fail','skipped','bonus') AND category <> 'heuristic_tests' AND (mandatory OR bonus OR ({o})))"
_EXERCISES = f"""{_SPEC}, m AS (
  SELECT l.*, ex.exercise_id AS eid, ex.functions, NOT ex.required AND NOT ex.bonus AS optional FROM located l JOIN ex ON located_exercise = ex.exercise_id
  UNION ALL SELECT l.*, ex.exercise_id, ex.functions, NOT ex.required AND NOT ex.bonus FROM located l JOIN ex ON located_exercise IS NULL AND located_file = ex.file),
n AS (SELECT *, {_PROGRESS.format(o='optional')} AS progress, diagnosis IN ('missing_function','bonus_not_implemented') AND status IN ('fail','skipped','bonus') AS gone FROM m),
g AS (SELECT run_id, eid AS exercise_id, count(*) FILTER (WHERE progress AND status IN ('pass','warning')) AS passed, count(*) FILTER (WHERE progress) AS total, count(*) FILTER (WHERE status IN ('fail','skipped','bonus','warning')) AS issues,
  bool_or(progress AND status IN ('fail','skipped','bonus')) AS failing, bool_or(status = 'warning') AS warned, bool_or(progress AND status IN ('pass','warning') AND category IN ('explicit_tests','derived_tests','output')) AS behaves,
  bool_or(gone AND coalesce("function", '') = '' AND diagnosis = 'bonus_not_implemented') AS not_there, count(DISTINCT "function") FILTER (WHERE gone AND list_contains(functions, "function")) AS n_gone FROM n GROUP BY ALL),
e AS (SELECT r.run_id, ex.*, coalesce(g.passed, 0) AS passed, coalesce(g.total, 0) AS total, coalesce(g.issues, 0) AS issues, lost.file IS NOT NULL AS gone_file, coalesce(failing, false) AS failing, coalesce(warned, false) AS warned,
  coalesce(behaves, false) AS behaves, coalesce(not_there, false) OR (len(functions) > 0 AND coalesce(n_gone, 0) = len(functions)) AS not_there
  FROM runs r JOIN ex USING (subject_id) LEFT JOIN g ON g.run_id = r.run_id AND g.exercise_id = ex.exercise_id LEFT JOIN lost ON lost.run_id = r.run_id AND lost.file = ex.file),
scored AS (SELECT run_id, exercise_id, file, required, bonus, passed, total, {pct('passed', 'total')} AS score, issues, CASE WHEN bonus AND (gone_file OR not_there) THEN 'not_implemented' WHEN gone_file THEN 'missing' WHEN total = 0 THEN 'warning'
  WHEN NOT failing THEN CASE WHEN warned THEN 'warning' ELSE 'pass' END WHEN behaves THEN 'partial' ELSE 'fail' END AS state FROM e)"""


def _scored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Checks with their places, expected files, exercises and runs."""
    rows, ex = deduped(spark, sf_dir), A.exercises(spark)
    files = SC.expected_files(A.structure(spark), ex)
    return SC.locate_checks(rows, files, ex), files, ex, A.runs(A.checks(spark, sf_dir))


@query(f"WITH {_EXERCISES} SELECT * FROM scored")
def exercise_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    located, _, ex, runs = _scored(spark, sf_dir)
    return SC.exercise_scores(located, ex, runs)


@query(f"WITH {_EXERCISES}, b AS (SELECT run_id, count(*) FILTER (WHERE bonus AND total > 0 AND state IN ('pass','warning')) AS bonus_passed, count(*) FILTER (WHERE bonus) AS bonus_total FROM scored GROUP BY run_id) SELECT *, {pct('bonus_passed', 'bonus_total')} AS bonus_completion FROM b")
def bonus_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.bonus_completion(exercise_scores(spark, sf_dir))


@query(f"WITH {A.EXERCISES}, {A.FILES} SELECT subject_id, path, kind, required, bonus FROM wanted")
def expected_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.expected_files(A.structure(spark), A.exercises(spark)).drop("pos")


@query(f"WITH {_SPEC} SELECT run_id, check_id, located_file, located_exercise FROM located")
def check_locations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir)[0].select("run_id", "check_id", "located_file", "located_exercise")


@query(f"WITH {_SPEC} SELECT * FROM lost")
def missing_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.missing_files(_scored(spark, sf_dir)[0])


@query(f"""WITH {_SPEC}, m AS (SELECT l.*, w.path, sr, {_PROGRESS.format(o='NOT w.required AND NOT w.bonus').replace('OR bonus OR', 'OR l.bonus OR')} AS progress FROM located l JOIN wanted w ON l.located_file = w.path AND w.kind = 'file' LEFT JOIN sev USING (severity)),
g AS (SELECT run_id, path, count(*) FILTER (WHERE progress AND status IN ('pass','warning')) AS passed, count(*) FILTER (WHERE progress) AS total, count(*) FILTER (WHERE status IN ('fail','skipped','bonus','warning')) AS issues, min(sr) FILTER (WHERE status IN ('fail','skipped','bonus','warning')) AS w FROM m GROUP BY ALL),
s AS (SELECT file, string_agg(exercise_id, ',' ORDER BY pos) AS ids FROM ex GROUP BY file)
SELECT r.run_id, w.path AS file, coalesce(s.ids, '') AS exercise_ids, lost.file IS NULL AS present, coalesce(g.passed, 0) AS passed, coalesce(g.total, 0) AS total, {pct('coalesce(g.passed, 0)', 'coalesce(g.total, 0)')} AS score, coalesce(g.issues, 0) AS issues, (SELECT severity FROM sev WHERE sr = g.w) AS worst
FROM runs r JOIN wanted w ON w.subject_id = r.subject_id AND w.kind = 'file' LEFT JOIN g ON g.run_id = r.run_id AND g.path = w.path LEFT JOIN s ON s.file = w.path LEFT JOIN lost ON lost.run_id = r.run_id AND lost.file = w.path""")
def file_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    located, files, ex, runs = _scored(spark, sf_dir)
    return SC.file_scores(located, files, ex, runs)


_WEAK = f"""{_SPEC}, fn AS (SELECT subject_id, exercise_id, unnest(functions) AS "function", required, bonus, pos * 100 + generate_subscripts(functions, 1) AS pos FROM ex),
t AS (SELECT run_id, exercise_id, "function", count(*) AS n FROM deduped WHERE category IN ('explicit_tests','derived_tests') AND "function" <> '' GROUP BY ALL),
weak AS (SELECT r.run_id, fn.exercise_id, fn."function", fn.pos, coalesce(t.n, 0) + coalesce(l.n, 0) AS tests FROM runs r JOIN fn USING (subject_id) LEFT JOIN t ON r.run_id = t.run_id AND fn.exercise_id = t.exercise_id AND fn."function" = t."function"
  LEFT JOIN t l ON l.exercise_id IS NULL AND l.run_id = r.run_id AND l."function" = fn."function" WHERE fn.required AND NOT fn.bonus AND coalesce(t.n, 0) + coalesce(l.n, 0) < 2)"""


def _functions(ex: DataFrame) -> DataFrame:
    return ex.select("subject_id", "exercise_id", "required", "bonus", "pos", F.posexplode("functions").alias("k", "function")).withColumn("pos", F.col("pos") * 100 + F.col("k") + 1).drop("k")


@query(f"""WITH {_WEAK}, c AS (SELECT run_id, count(*) FILTER (WHERE mandatory AND NOT bonus AND status IN ('pass','warning','fail','skipped')) AS m, count(*) FILTER (WHERE category IN ('explicit_tests','output') AND starts_with(check_id, 'test:')) AS x,
  count(*) FILTER (WHERE category = 'heuristic_tests' AND status = 'warning') AS h FROM deduped GROUP BY run_id), k AS (SELECT run_id, count(*) AS n, string_agg("function", ', ' ORDER BY pos) AS names FROM weak GROUP BY run_id),
a AS (SELECT r.*, coalesce(m, 0) AS m, coalesce(x, 0) AS x, coalesce(h, 0) AS h, coalesce(n, 0) AS n, names FROM runs r LEFT JOIN c USING (run_id) LEFT JOIN k USING (run_id))
SELECT run_id, CASE WHEN m = 0 OR x = 0 THEN 'low' WHEN (ai_items > 0 AND NOT reviewed) OR n > 0 OR h > 0 OR notes > 0 THEN 'medium' ELSE 'high' END AS level,
  array_to_string(list_filter([CASE WHEN m = 0 THEN '{schema.NOTHING_VERIFIED}' END, CASE WHEN x = 0 THEN '{schema.NO_EXPLICIT_TEST}' END,
  CASE WHEN ai_items > 0 AND NOT reviewed THEN replace('{schema.AI_NOT_REVIEWED}', '{{}}', ai_items::VARCHAR) END,
  CASE WHEN n > 0 THEN n || ' mandatory function(s) have fewer than 2 explicit or derived tests: ' || names || '.' END, CASE WHEN h > 0 THEN replace('{schema.HEURISTIC_WARNINGS}', '{{}}', h::VARCHAR) END,
  CASE WHEN notes > 0 THEN replace('{schema.PARSER_NOTES}', '{{}}', notes::VARCHAR) END, CASE WHEN sandbox_mode = 'local' THEN '{schema.LOCAL_SANDBOX}' END], lambda s: s IS NOT NULL), chr(10)) AS reasons FROM a""")
def run_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ex, runs = _scored(spark, sf_dir)
    return SC.confidence(deduped(spark, sf_dir), _functions(ex), runs)


@query(f"WITH {_WEAK} SELECT run_id, exercise_id, \"function\", tests FROM weak")
def under_tested(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, _, ex, runs = _scored(spark, sf_dir)
    return SC.under_tested(deduped(spark, sf_dir), _functions(ex), runs).drop("pos")


@query(f"""WITH {A.CHECKS}, r AS (SELECT run_id, check_id, status, severity, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN mandatory AND NOT bonus AND status IN ('fail','skipped') THEN 0 ELSE 1 END, coalesce(sr, 9), report_rank, mandatory DESC, emit_seq) AS place
  FROM deduped LEFT JOIN sev USING (severity) JOIN st USING (status) WHERE status IN ('fail','skipped','bonus','warning')) SELECT * FROM r WHERE place <= 5""")
def top_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.top_issues(deduped(spark, sf_dir)).select("run_id", "check_id", "status", "severity", "place")


@query(f"""WITH {A.CHECKS}, h AS (SELECT *, lower(concat_ws(chr(10), nullif(title, ''), nullif(message, ''), nullif(check_id, ''), nullif(file, ''), nullif(location_file, ''), nullif("function", ''), nullif(exercise_id, ''), nullif(diagnosis, ''))) AS hay FROM deduped)
SELECT run_id, check_id, status FROM h WHERE status IN ('fail','skipped','info') AND severity = 'major' AND provenance = 'derived' AND contains(hay, 'ex1') AND contains(hay, 'missing_f')""")
def search_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SC.search_issues(deduped(spark, sf_dir), " EX1  missing_F", ["fail", "info"], "major", "derived").select("run_id", "check_id", "status")


@query(f"""WITH {A.CHECKS} SELECT CASE WHEN status IN ('fail','skipped') THEN 'fail' WHEN status IN ('warning','bonus','info') THEN status END AS bucket,
  CASE WHEN category = 'heuristic_tests' OR provenance = 'heuristic' THEN 'heuristic' WHEN category = 'derived_tests' OR provenance = 'derived' THEN 'derived' ELSE 'explicit' END AS origin, count(*) AS n, count(*) FILTER (WHERE status IN ('pass','info')) AS passing FROM deduped GROUP BY 1, 2""")
def origins_and_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduped(spark, sf_dir)
    return rows.groupBy(S.status_filter(F.col("status")).alias("bucket"), S.test_origin(F.col("category"), F.col("provenance")).alias("origin")).agg(F.count("*").alias("n"), F.count_if(F.col("status").isin("pass", "info")).alias("passing"))


# ---------------------------------------------------------------- comparison and history

# Runs 2k and 2k + 1 of the same checks: what lineitem spreads over suppliers is brought together by order and line.
_COMPARE = """half AS (SELECT run_id % 2 AS side, run_id // 2 AS pair_id, split_part(check_id, ':', -2) || ':' || split_part(check_id, ':', -1) AS check_id, status, emit_seq FROM deduped),
one AS (SELECT side, pair_id % 2 AS pair_id, check_id, arg_max(status, emit_seq) AS status FROM half GROUP BY ALL),
j AS (SELECT pair_id, check_id, b.status AS before, h.status AS after FROM (SELECT * FROM one WHERE side = 0) b FULL JOIN (SELECT * FROM one WHERE side = 1) h USING (pair_id, check_id)),
changes AS (SELECT pair_id, check_id, before, after, unnest(list_filter([CASE WHEN before IN ('fail','skipped','warning') AND after = 'pass' THEN 'fixed' END, CASE WHEN after IN ('fail','skipped') AND coalesce(before, '') NOT IN ('fail','skipped') THEN 'new_failures' END,
  CASE WHEN before IN ('fail','skipped') AND after IN ('fail','skipped') THEN 'still_failing' END, CASE WHEN before IS NULL THEN 'new_checks' END, CASE WHEN after IS NULL THEN 'removed_checks' END], lambda x: x IS NOT NULL)) AS change FROM j)"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = F.concat_ws(":", F.split_part("check_id", F.lit(":"), F.lit(-2)), F.split_part("check_id", F.lit(":"), F.lit(-1)))
    half = deduped(spark, sf_dir).select((F.col("run_id") % 2).alias("side"), (F.floor(F.col("run_id") / 2) % 2).alias("pair_id"), own.alias("check_id"), "status", "emit_seq")
    one = half.groupBy("side", "pair_id", "check_id").agg(F.max_by("status", "emit_seq").alias("status"))
    return H.compare_runs(one.where("side = 0"), one.where("side = 1"))


@query(f"WITH {A.CHECKS}, {_COMPARE} SELECT * FROM changes")
def compare_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir)


@query(f"WITH {A.CHECKS}, {_COMPARE} SELECT pair_id, change, count(*) AS n FROM changes GROUP BY ALL")
def comparison_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _pairs(spark, sf_dir).groupBy("pair_id", "change").agg(F.count("*").alias("n"))


@query(f"WITH {A.ANALYSES}, d AS (SELECT *, lag(readiness) OVER (PARTITION BY subject_id, project_id ORDER BY created_at, number, id) AS previous FROM analyses) SELECT id, readiness, previous, floor((readiness - previous) * 10 + 0.5) / 10 AS delta FROM d")
def readiness_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.readiness_deltas(A.analyses(spark, sf_dir)).select("id", "readiness", "previous", "delta")


@query(f"WITH {A.ANALYSES} SELECT subject_id, project_id, id, number FROM analyses QUALIFY row_number() OVER (PARTITION BY subject_id, project_id ORDER BY created_at DESC, number DESC, id DESC) = 1")
def latest_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.latest_runs(A.analyses(spark, sf_dir)).select("subject_id", "project_id", "id", "number")


@query("WITH " + A.ANALYSES + " SELECT a.id, (SELECT arg_max(b.id, {'n': b.number, 'c': b.created_at, 'i': b.id}) FROM analyses b WHERE b.subject_id = a.subject_id AND b.project_id = a.project_id AND b.number < a.number) AS previous_id FROM analyses a")
def previous_analysis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.previous_analysis(A.analyses(spark, sf_dir)).select("id", "previous_id")


@query(f"WITH {A.ANALYSES} SELECT subject_id, project_id, greatest(count(*), coalesce(max(number), 0)) + 1 AS next_number FROM analyses GROUP BY ALL")
def next_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.next_numbers(A.analyses(spark, sf_dir))


@query(f"WITH {A.ANALYSES} SELECT * FROM analyses ORDER BY created_at DESC, number DESC, id DESC LIMIT 50")
def history_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.list_analyses(A.analyses(spark, sf_dir))


@query(f"WITH {A.ANALYSES} SELECT id FROM analyses QUALIFY row_number() OVER (PARTITION BY subject_id, project_id ORDER BY number DESC, id DESC) > 3")
def retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.keep_newest(A.analyses(spark, sf_dir), ["subject_id", "project_id"], "number", 3).select("id")


@query(f"WITH {A.ANALYSES} SELECT subject_id, id, number, created_at FROM analyses QUALIFY row_number() OVER (PARTITION BY subject_id ORDER BY created_at DESC, number DESC, id DESC) <= 50")
def history_of_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return H.list_by_subject(A.analyses(spark, sf_dir)).select("subject_id", "id", "number", "created_at")


@query(f"WITH {A.ANALYSES}, r AS (SELECT id, row_number() OVER (PARTITION BY subject_id, project_id ORDER BY number DESC, id DESC) AS k FROM analyses) SELECT id FROM r WHERE k > 3 AND id % 10 <> 0")
def retention_protected(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All analyses are ranked; those that are protected are only spared."""
    rows = A.analyses(spark, sf_dir)
    return H.keep_newest(rows, ["subject_id", "project_id"], "number", 3, protected=rows.where("id % 10 = 0")).select("id")


@query(f"""WITH {A.ANALYSES}, u AS (SELECT id, readiness, 0 AS v FROM analyses UNION ALL SELECT id, readiness + 1, 1 FROM analyses WHERE id % 3 = 0) SELECT id, readiness FROM u QUALIFY row_number() OVER (PARTITION BY id ORDER BY v DESC) = 1""")
def upsert_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = A.analyses(spark, sf_dir).select("id", "readiness", F.lit(0).alias("v"))
    return H.upsert(rows, rows.where("id % 3 = 0").select("id", (F.col("readiness") + 1).alias("readiness"), F.lit(1).alias("v")), "id", "v").select("id", "readiness")


# ---------------------------------------------------------------- events

_OFFSETS = "offs AS (SELECT job_id, seq, text, sum(length(text)) OVER (PARTITION BY job_id ORDER BY seq) AS end_off FROM io WHERE kind = 'output')"


@query(f"WITH {A.EVENTS}, {_OFFSETS} SELECT job_id, seq, end_off::BIGINT AS end_off, (end_off - length(text))::BIGINT AS start_off FROM offs")
def output_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.output_offsets(A.io_events(spark, sf_dir)).select("job_id", "seq", "end_off", "start_off")


@query(f"""WITH {A.EVENTS}, {_OFFSETS}, p AS (SELECT DISTINCT job_id, o::BIGINT AS off FROM io, (VALUES (0), (15), (40), (100000)) v(o))
SELECT p.job_id, p.off, (SELECT max(seq) FROM offs WHERE offs.job_id = p.job_id AND end_off - length(text) <= p.off AND end_off > p.off) AS event_seq FROM p""")
def event_at_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    io = A.io_events(spark, sf_dir)
    probes = io.select("job_id").distinct().select("job_id", F.explode(F.array(*map(F.lit, (0, 15, 40, 100000)))).alias("off"))
    return EV.event_at(EV.output_offsets(io), probes)


@query(f"""WITH {A.EVENTS}, g AS (SELECT *, coalesce(sum((kind = 'input')::INT) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS grp FROM io WHERE kind IN ('output','input'))
SELECT job_id, grp, coalesce(string_agg(text, '' ORDER BY seq) FILTER (WHERE kind = 'output'), '') AS prompt, max(text) FILTER (WHERE kind = 'input') AS answer FROM g GROUP BY job_id, grp""")
def prompt_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.prompt_groups(A.io_events(spark, sf_dir))


@query(f"""WITH {A.EVENTS}, p AS (SELECT *, coalesce(sum(CASE WHEN kind = 'output' THEN length(text) ELSE 0 END) OVER (PARTITION BY job_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS printed FROM io)
SELECT job_id, seq, kind FROM p WHERE printed >= CASE WHEN job_id % 4 = 0 THEN 0 ELSE (job_id % 7) * 10 END""")
def after_consuming(spark: SparkSession, sf_dir: str) -> DataFrame:
    io = A.io_events(spark, sf_dir)
    consumed = io.select("job_id").distinct().where("job_id % 4 <> 0").withColumn("chars", F.col("job_id") % 7 * 10)
    return EV.after_consuming(io, consumed).select("job_id", "seq", "kind")


_STEPS = "steps AS (SELECT conv_id AS session_id, turn AS step_no, CASE WHEN role = 'user' THEN 'input' ELSE 'output' END AS kind, text FROM conversations)"


def _steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), F.col("turn").alias("step_no"), F.when(F.col("role") == "user", "input").otherwise("output").alias("kind"), "text")


@query(f"WITH {_STEPS} SELECT session_id, coalesce(string_agg(text || chr(10), '' ORDER BY step_no, text) FILTER (WHERE kind = 'input'), '') AS stdin, coalesce(string_agg(text, '' ORDER BY step_no, text) FILTER (WHERE kind = 'output'), '') AS stdout FROM steps GROUP BY session_id")
def steps_io(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.steps_io(_steps(spark, sf_dir))


@query(f"""WITH {_STEPS}, k AS (SELECT * FROM steps WHERE kind <> 'output' OR text <> ''), a AS (SELECT *, CASE WHEN kind = 'output' AND coalesce(lag(kind) OVER w = 'output', false) THEN 0 ELSE 1 END AS new FROM k WINDOW w AS (PARTITION BY session_id ORDER BY step_no)),
b AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY step_no ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM a), g AS (SELECT session_id, island, kind, string_agg(text, '' ORDER BY step_no) AS text, count(*) AS steps FROM b GROUP BY ALL),
l AS (SELECT *, kind = 'output' AND island = max(island) OVER (PARTITION BY session_id) AS last FROM g)
SELECT session_id, island, kind, steps, CASE WHEN last THEN rtrim(regexp_replace(text, '(\n[ \t]*)+$', ''), chr(10)) || chr(10) ELSE text END AS text FROM l WHERE NOT last OR trim(text, ' ' || chr(9) || chr(10)) <> ''""")
def merge_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.merge_steps(_steps(spark, sf_dir))


@query("""WITH s AS (SELECT l_orderkey % 500 AS doc_id, l_partkey AS start, l_partkey + l_quantity::BIGINT AS stop FROM lineitem),
a AS (SELECT *, coalesce((start > max(stop) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))::INT, 1) AS new FROM s),
b AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY start, stop ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM a) SELECT doc_id, island, min(start) AS start, max(stop) AS stop FROM b GROUP BY doc_id, island""")
def merge_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem")
    return EV.merge_intervals(li.select((F.col("l_orderkey") % 500).alias("doc_id"), F.col("l_partkey").alias("start"), (F.col("l_partkey") + F.rint("l_quantity").cast("long")).alias("stop")))


@query(f"WITH {A.EVENTS}, s AS (SELECT job_id % 50 AS script_id, job_id AS session_id, count(*) FILTER (WHERE kind = 'input') AS prompts FROM io GROUP BY ALL) SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY script_id ORDER BY prompts DESC, session_id) = 1")
def best_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = A.io_events(spark, sf_dir).groupBy((F.col("job_id") % 50).alias("script_id"), F.col("job_id").alias("session_id")).agg(F.count_if(F.col("kind") == "input").alias("prompts"))
    return EV.best_session(s)


@query("SELECT user_id AS job_id, max(greatest(0.0, least(1.0, value / 100))) AS progress, max_by(event_type, event_id) AS stage FROM events GROUP BY user_id")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.job_states(A.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), (F.col("value") / 100).alias("progress"), F.col("event_type").alias("stage"), F.col("event_id").alias("seq")))


# ---------------------------------------------------------------- structure and constraints


@query()
def match_requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claiming files in turn has no short SQL; tests hold it against a plain loop."""
    tree = A.tree(spark, sf_dir)
    paths = ("src/m5.py", "src/m10.py", "src/main11.py", "Docs/m4.py", "src/none.py", "m7.py", "lib/m7.py")
    wanted = tree.select("project_id").distinct().select("project_id", F.posexplode(F.array(*map(F.lit, paths))).alias("pos", "path")).withColumn("kind", F.lit("file"))
    wanted = wanted.withColumn("required", ~F.contains("path", F.lit("none"))).withColumn("bonus", F.contains("path", F.lit("main")))
    return ST.match_requirements(wanted, tree, "src", ["build/"]).select("project_id", "path", "found", "how", "status")


@query(f"""WITH {A.TREE}, h AS (SELECT project_id, path, kind, CASE WHEN regexp_matches(path, '(^|/)[^/]*\\.PY$') THEN '*.PY' WHEN kind = 'directory' AND regexp_matches(path, '(^|/)build$') THEN 'build/' WHEN regexp_matches(path, '^src/.*m[12][^/]$') THEN '/src/*m[12]?' WHEN kind = 'directory' AND regexp_matches(path, '(^|/)__pycache__$') THEN '**/__pycache__/' END AS pattern FROM tree)
SELECT project_id, path, pattern FROM h WHERE pattern IS NOT NULL AND NOT EXISTS (SELECT 1 FROM h o WHERE o.project_id = h.project_id AND o.kind = 'directory' AND o.pattern IS NOT NULL AND starts_with(h.path, o.path || '/'))""")
def unwanted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.unwanted(A.tree(spark, sf_dir), ["# no pattern", "*.PY", "build/", "/src/*m[12]?", "!x", "**/__pycache__/"]).select("project_id", "path", "pattern")


@query(f"""WITH {A.TREE}, p AS (SELECT project_id, path, string_split(path, '/') AS s FROM tree WHERE kind = 'file'), f AS (SELECT project_id, unnest(list_transform(range(1, len(s)), lambda n: array_to_string(s[1:n], '/'))) AS folder FROM p)
SELECT project_id, folder, count(*) AS files FROM f GROUP BY ALL""")
def files_below(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.files_below(A.tree(spark, sf_dir))


@query(f"WITH {A.TREE} SELECT project_id, path FROM tree QUALIFY row_number() OVER (PARTITION BY project_id, lower(path) ORDER BY path) > 1")
def case_collisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.case_collisions(A.tree(spark, sf_dir)).select("project_id", "path")


@query("""WITH c AS (SELECT l_suppkey AS project_id, 'fn' || (l_partkey % 30) AS name, l_linenumber AS line, 'g' || (l_orderkey % 6) AS "function", l_quantity::BIGINT AS col, l_orderkey * 10 + l_linenumber AS seq FROM lineitem)
SELECT project_id, name, count(*) AS calls, string_agg(line, ',' ORDER BY line) AS lines, count(DISTINCT "function") AS functions, min(col) AS first_col FROM c WHERE name IN ('fn3', 'fn7') GROUP BY ALL""")
def call_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem")
    calls = li.select(F.col("l_suppkey").alias("project_id"), F.concat(F.lit("fn"), (F.col("l_partkey") % 30).cast("string")).alias("name"), F.col("l_linenumber").alias("line"), F.concat(F.lit("g"), (F.col("l_orderkey") % 6).cast("string")).alias("function"), F.round("l_quantity").cast("long").alias("col"), F.round("l_quantity").alias("seq"))
    return ST.call_violations(calls, spark.createDataFrame([("fn3",), ("fn7",)], "name string"))


@query("""WITH n AS (SELECT 'mod.' || lower(n_name) AS module FROM nation UNION ALL SELECT 'mod.' || lower(n_name) || '.x' FROM nation), p(pattern) AS (VALUES ('mod.nation_0'), ('mod.i'))
SELECT module, pattern FROM n JOIN p ON module = pattern OR starts_with(module, pattern || '.')""")
def module_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = A.table(spark, sf_dir, "nation").select(F.concat(F.lit("mod."), F.lower("n_name")).alias("module"))
    n = n.unionByName(n.select(F.concat("module", F.lit(".x")).alias("module")))
    p = spark.createDataFrame([("mod.nation_0",), ("mod.i",)], "pattern string")
    return ST.modules_matching(n, p)


# ---------------------------------------------------------------- text and values


@query("""WITH d AS (SELECT doc_id, text AS a, lower(text) AS b FROM documents) SELECT doc_id, length(trim(regexp_replace(a, '[\\s\\x0b\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]+', ' ', 'g'))) AS collapsed,
length(a) - length(replace(a, chr(10), '')) + CASE WHEN a = '' OR right(a, 1) = chr(10) THEN 0 ELSE 1 END AS n_lines FROM d""")
def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = A.table(spark, sf_dir, "documents")
    return d.select("doc_id", F.length(X.collapse_ws(F.col("text"))).alias("collapsed"), F.size(X.lines_kept(F.col("text"))).alias("n_lines"))


@query("""WITH v AS (SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN 'int' ELSE 'float' END AS ka, CASE WHEN o_orderkey % 2 = 0 THEN 'int' ELSE 'float' END AS kb, floor(o_totalprice) AS a,
  floor(o_totalprice) + CASE o_orderkey % 4 WHEN 0 THEN 0 WHEN 1 THEN 1e-7 WHEN 2 THEN 1 ELSE 0 END AS b FROM orders)
SELECT id, CASE WHEN ka = kb AND a = b THEN 'equal' WHEN ka = 'float' AND kb = 'int' AND abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-9) THEN 'int_for_float' WHEN ka = kb AND ka = 'float' AND abs(a - b) <= greatest(1e-9 * greatest(abs(a), abs(b)), 1e-9) THEN 'close' ELSE 'different' END AS verdict FROM v""")
def typed_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    a = F.floor("o_totalprice").cast("double")
    k = F.col("o_orderkey")
    b = a + F.when(k % 4 == 1, 1e-7).when(k % 4 == 2, 1.0).otherwise(0.0)
    return o.select(k.alias("id"), X.values_match(F.when(k % 3 == 0, "int").otherwise("float"), a, F.when(k % 2 == 0, "int").otherwise("float"), b).alias("verdict"))


# ---------------------------------------------------------------- text diffs and source facts


def _answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation against the next one."""
    turns = A.table(spark, sf_dir, "conversations").groupBy("conv_id", "turn").agg(F.min("text").alias("expected"))
    after = Window.partitionBy("conv_id").orderBy("turn")
    return turns.select(F.concat_ws(":", "conv_id", "turn").alias("case_id"), "expected", F.lead("expected").over(after).alias("actual"))


@query()
def diff_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment has no short SQL; tests hold it against a plain reconstruction."""
    return TD.diff_lines(_answers(spark, sf_dir))


@query()
def diff_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return TD.diff_summary(TD.diff_lines(_answers(spark, sf_dir)))


def _sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A small program for each part."""
    called = F.element_at(F.array(F.lit("abs"), F.lit("len"), F.lit("print")), (F.col("p_size") % 3 + 1).cast("int"))
    code = F.concat(F.lit("import math\n\ndef f"), F.col("p_partkey").cast("string"), F.lit("(x):\n    for i in x:\n        "), called, F.lit("(i)\n    return "), called, F.lit("(x)\n"))
    return A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("file_id"), code.alias("source"))


@query("""WITH s AS (SELECT p_partkey AS file_id, (['abs','len','print'])[p_size % 3 + 1] AS c, 'f' || p_partkey AS f FROM part)
SELECT file_id, 'import' AS fact, 'math' AS name, 1 AS line, NULL AS in_function FROM s UNION ALL SELECT file_id, 'function', f, 3, NULL FROM s
UNION ALL SELECT file_id, 'construct', 'for', 4, f FROM s UNION ALL SELECT file_id, 'call', c, 5, f FROM s UNION ALL SELECT file_id, 'call', c, 6, f FROM s""")
def source_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SF.source_facts(_sources(spark, sf_dir))


@query("SELECT p_partkey AS file_id, (['abs','len','print'])[p_size % 3 + 1] AS name, 2::BIGINT AS n_calls, '5,6' AS lines, 'f' || p_partkey AS functions FROM part")
def call_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    sites = SF.call_sites(SF.source_facts(_sources(spark, sf_dir), only=["call"]))
    return sites.withColumn("lines", F.array_join(F.col("lines").cast("array<string>"), ",")).withColumn("functions", F.array_join("functions", ","))


from . import evaluation_queries, form_queries, rule_queries, source_queries, spec_queries, subject_queries, verdict_queries  # noqa: E402, F401  (they add their queries to the same registry)
