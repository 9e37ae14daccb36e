"""The driver's tables in the shape of the domain's, so that the same operators run on them; each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet import schema
from marksheet.operators.structure import with_folders


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as checks: the six flag pairs are the statuses; (run_id, check_id) isn't unique."""
    li = table(spark, sf_dir, "lineitem")
    pair = F.concat("l_returnflag", "l_linestatus")
    status = F.when(pair == "AF", "fail").when(pair == "AO", "skipped").when(pair == "NF", "warning").when(pair == "NO", "pass").when(pair == "RF", "bonus").otherwise("info")
    # A total order of emission in two numbers.
    high = F.col("l_partkey") * 10_000_000 + F.col("l_suppkey")
    low = (F.floor(F.col("l_extendedprice") * 100) * 100 + F.floor(F.col("l_quantity"))) * 100_000 + F.datediff(F.to_date("l_shipdate"), F.lit("1970-01-01").cast("date"))
    seq = F.struct(high.cast("long").alias("hi"), low.cast("long").alias("lo"))
    mix = (F.col("l_orderkey") * 7 + F.col("l_partkey")) % 400
    diagnosis = F.when(mix < 2, "missing_file").when(mix == 2, "missing_bonus_file").when(mix < 180, "missing_function").when(mix < 220, "bonus_not_implemented").otherwise("wrong_value")
    return li.select(
        (F.col("l_suppkey") % 20).alias("run_id"), F.concat(F.when(F.col("l_orderkey") % 3 > 0, "test:").otherwise(""), F.col("l_orderkey").cast("string"), F.lit(":"), F.col("l_linenumber").cast("string")).alias("check_id"), status.alias("status"),
        F.element_at(F.array(*map(F.lit, [*schema.SEVERITY, "none"])), (F.col("l_partkey") % 5 + 1).cast("int")).alias("severity"), F.element_at(F.array(*map(F.lit, schema.SCORED_CATEGORIES)), (F.col("l_partkey") % 9 + 1).cast("int")).alias("category"), diagnosis.alias("diagnosis"), F.concat(F.lit("Check of "), diagnosis).alias("title"), F.concat(F.lit("Order "), F.col("l_orderkey").cast("string")).alias("message"),
        F.lit(None).cast("string").alias("test_id"), F.when(F.col("l_linenumber") > 3, F.concat(F.lit("lib/l"), (F.col("l_partkey") % 4).cast("string"), F.lit(".py"))).alias("location_file"),
        (F.col("l_tax") < 0.06).alias("mandatory"), (status == "bonus").alias("bonus"), F.when(F.col("l_orderkey") % 8 < 7, F.concat(F.lit("ex"), (F.col("l_orderkey") % 8).cast("string"))).alias("exercise_id"),
        F.concat(F.lit("f"), (F.col("l_partkey") % 90).cast("string")).alias("function"), F.concat(F.lit("src/m"), (F.col("l_orderkey") % 6).cast("string"), F.lit(".py")).alias("file"),
        F.element_at(F.array(*map(F.lit, ["explicit", "derived", "heuristic"])), (F.col("l_suppkey") % 3 + 1).cast("int")).alias("provenance"), seq.alias("emit_seq"),
    )


CHECKS = """checks AS (
  SELECT *, status = 'bonus' AS bonus FROM (
  SELECT l_suppkey % 20 AS run_id, CASE WHEN l_orderkey % 3 > 0 THEN 'test:' ELSE '' END || l_orderkey || ':' || l_linenumber AS check_id,
    CASE l_returnflag || l_linestatus WHEN 'AF' THEN 'fail' WHEN 'AO' THEN 'skipped' WHEN 'NF' THEN 'warning' WHEN 'NO' THEN 'pass' WHEN 'RF' THEN 'bonus' ELSE 'info' END AS status,
    (['critical','major','minor','style','none'])[l_partkey % 5 + 1] AS severity,
    (['structure','syntax','functions','explicit_tests','derived_tests','output','constraints','runtime','git'])[l_partkey % 9 + 1] AS category,
    l_tax < 0.06 AS mandatory, CASE WHEN l_orderkey % 8 < 7 THEN 'ex' || (l_orderkey % 8) END AS exercise_id,
    'f' || (l_partkey % 90) AS "function", 'src/m' || (l_orderkey % 6) || '.py' AS file, (['explicit','derived','heuristic'])[l_suppkey % 3 + 1] AS provenance,
    struct_pack(hi := (l_partkey * 10000000 + l_suppkey)::BIGINT, lo := ((floor(l_extendedprice * 100)::BIGINT * 100 + floor(l_quantity)::BIGINT) * 100000 + date_diff('day', DATE '1970-01-01', l_shipdate::DATE))::BIGINT) AS emit_seq,
    NULL::VARCHAR AS test_id, CASE WHEN l_linenumber > 3 THEN 'lib/l' || (l_partkey % 4) || '.py' END AS location_file, 'Order ' || l_orderkey AS message,
    CASE WHEN (l_orderkey * 7 + l_partkey) % 400 < 2 THEN 'missing_file' WHEN (l_orderkey * 7 + l_partkey) % 400 = 2 THEN 'missing_bonus_file' WHEN (l_orderkey * 7 + l_partkey) % 400 < 180 THEN 'missing_function'
      WHEN (l_orderkey * 7 + l_partkey) % 400 < 220 THEN 'bonus_not_implemented' ELSE 'wrong_value' END AS diagnosis, 'Check of ' || diagnosis AS title
  FROM lineitem)
), sev(severity, sr) AS (VALUES ('critical',0),('major',1),('minor',2),('style',3)),
st(status, dedupe_rank, report_rank) AS (VALUES ('pass',0,5),('info',1,4),('bonus',2,3),('warning',3,2),('skipped',4,1),('fail',5,0)),
deduped AS (
  SELECT * EXCLUDE (pick, dedupe_rank, report_rank) FROM (
    SELECT c.*, st.dedupe_rank, st.report_rank, row_number() OVER (PARTITION BY run_id, check_id ORDER BY dedupe_rank DESC, emit_seq DESC) AS pick, min(emit_seq) OVER (PARTITION BY run_id, check_id) AS position
    FROM checks c JOIN st USING (status)) WHERE pick = 1
), counted AS (SELECT *, mandatory AND NOT bonus AND status IN ('pass','warning','fail','skipped') AS counted FROM deduped)"""


def runs(checks: DataFrame) -> DataFrame:
    """The runs of checks(), all of one subject, with what is known of each."""
    r = F.col("run_id")
    return checks.select("run_id").distinct().select("run_id", F.lit("s0").alias("subject_id"), (r % 3 == 0).alias("reviewed"), (r % 4).cast("int").alias("ai_items"), (r % 5 == 0).cast("int").alias("notes"), F.when(r % 2 == 0, "local").otherwise("docker").alias("sandbox_mode"))


RUNS = "runs AS (SELECT DISTINCT run_id, 's0' AS subject_id, run_id % 3 = 0 AS reviewed, (run_id % 4)::INT AS ai_items, (run_id % 5 = 0)::INT AS notes, CASE WHEN run_id % 2 = 0 THEN 'local' ELSE 'docker' END AS sandbox_mode FROM checks)"


def exercises(spark: SparkSession) -> DataFrame:
    """Which exercises each file serves; two of bonus, one optional, one file without checks, functions without tests."""
    i = F.col("id")
    functions = F.array(*[F.concat(F.lit("f"), (i + k).cast("string")) for k in (0, 7)], F.concat(F.lit("g"), i.cast("string")))
    return spark.range(8).select(
        F.lit("s0").alias("subject_id"), i.cast("int").alias("pos"), F.concat(F.lit("ex"), i.cast("string")).alias("exercise_id"), F.concat(F.lit("src/m"), F.when(i == 7, 9).otherwise(i % 5).cast("string"), F.lit(".py")).alias("file"),
        i.isin(4, 5).alias("bonus"), (~i.isin(4, 5, 6)).alias("required"), F.when(i < 6, F.slice(functions, 1, F.when(i.isin(4, 5), 2).otherwise(3))).otherwise(F.expr("cast(array() as array<string>)")).alias("functions"),
    )


EXERCISES = """ex AS (SELECT 's0' AS subject_id, i::INT AS pos, 'ex' || i AS exercise_id, 'src/m' || CASE WHEN i = 7 THEN 9 ELSE i % 5 END || '.py' AS file, i IN (4, 5) AS bonus, i NOT IN (4, 5, 6) AS required,
  CASE WHEN i >= 6 THEN []::VARCHAR[] WHEN i IN (4, 5) THEN ['f' || i, 'f' || (i + 7)] ELSE ['f' || i, 'f' || (i + 7), 'g' || i] END AS functions FROM range(8) t(i))"""


def structure(spark: SparkSession) -> DataFrame:
    """Entries that the subject lists by itself; one of them an exercise's file."""
    rows = [("s0", 0, "README.md", "file", True, False), ("s0", 1, "src/m1.py", "file", False, False), ("s0", 2, "docs", "directory", False, False), ("s0", 3, "README.md", "file", False, True)]
    return spark.createDataFrame(rows, "subject_id string, pos int, path string, kind string, required boolean, bonus boolean")


FILES = """wanted AS (SELECT * EXCLUDE (k, origin) FROM (SELECT *, row_number() OVER (PARTITION BY subject_id, path ORDER BY origin, pos) AS k FROM (
  SELECT * FROM (VALUES ('s0', 'README.md', 'file', true, false, 0, 0), ('s0', 'src/m1.py', 'file', false, false, 1, 0), ('s0', 'docs', 'directory', false, false, 2, 0), ('s0', 'README.md', 'file', false, true, 3, 0)) v(subject_id, path, kind, required, bonus, pos, origin)
  UNION ALL SELECT subject_id, file, 'file', required, bonus, pos, 1 FROM ex)) WHERE k = 1)"""

LOCATED = """located AS (SELECT c.*, ex.exercise_id AS located_exercise, coalesce(w.path, ex.file, c.file) AS located_file FROM deduped c LEFT JOIN ex ON c.exercise_id = ex.exercise_id LEFT JOIN wanted w ON c.file = w.path),
lost AS (SELECT DISTINCT run_id, located_file AS file FROM located WHERE category = 'structure' AND diagnosis IN ('missing_file', 'missing_bonus_file') AND status <> 'pass' AND located_file <> '')"""


def analyses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as the history of runs."""
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").alias("id"), (F.col("o_orderkey") % 97).cast("int").alias("number"), F.col("o_orderdate").alias("created_at"), F.concat(F.lit("s"), (F.col("o_custkey") % 50).cast("string")).alias("subject_id"),
        F.col("o_orderpriority").alias("project_id"), F.bround(F.col("o_totalprice") % 100, 1).alias("readiness"),
    )


ANALYSES = "analyses AS (SELECT o_orderkey AS id, (o_orderkey % 97)::INT AS number, o_orderdate AS created_at, 's' || (o_custkey % 50) AS subject_id, o_orderpriority AS project_id, round_even(o_totalprice % 100, 1) AS readiness FROM orders)"


def io_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as what jobs print and read."""
    e = table(spark, sf_dir, "events")
    kind = F.when(F.col("event_type").isin("view", "click", "signup"), "output").when(F.col("event_type") == "purchase", "input").otherwise("error")
    return e.select(F.col("user_id").alias("job_id"), F.col("event_id").alias("seq"), kind.alias("kind"), F.col("props").alias("text"))


EVENTS = "io AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_type IN ('view','click','signup') THEN 'output' WHEN event_type = 'purchase' THEN 'input' ELSE 'error' END AS kind, props AS text FROM events)"


def tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part names as project files."""
    p = table(spark, sf_dir, "part")
    n = F.col("p_partkey")
    folder = F.element_at(F.array(*map(F.lit, ["src", "src/util", "build/tmp", "__pycache__", "Docs"])), (n % 5 + 1).cast("int"))
    path = F.concat(folder, F.lit("/"), F.when(n % 11 == 0, "Main").otherwise("m"), (n % 60).cast("string"), F.when(n % 7 == 0, ".PY").otherwise(".py"))
    return p.select((n % 40).alias("project_id"), path.alias("path"), F.lit("file").alias("kind")).distinct().transform(with_folders)


TREE = """files AS (SELECT DISTINCT p_partkey % 40 AS project_id, (['src','src/util','build/tmp','__pycache__','Docs'])[p_partkey % 5 + 1] || '/' || CASE WHEN p_partkey % 11 = 0 THEN 'Main' ELSE 'm' END || (p_partkey % 60) || CASE WHEN p_partkey % 7 = 0 THEN '.PY' ELSE '.py' END AS path FROM part),
folders AS (SELECT DISTINCT project_id, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))) AS path FROM files),
tree AS (SELECT project_id, path, 'file' AS kind FROM files UNION ALL SELECT project_id, path, 'directory' FROM folders)"""
