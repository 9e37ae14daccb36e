"""Queries of verdicts, plans and orders over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marksheet.operators import ordering as OR
from marksheet.operators import planning as PL
from marksheet.operators import summaries as SU
from marksheet.operators import verdicts as V

from . import adapters as A
from .queries import deduped, query

# ---------------------------------------------------------------- verdicts

_KINDS = ["int", "float", "bool", "str", "NoneType", "list"]
_CASES = """cases AS (SELECT id, ['int','float','bool','str','NoneType','list'][k % 6 + 1] AS ek, ['int','float','bool','str','NoneType','list'][k // 6 % 6 + 1] AS ak, num AS en, num + CASE k % 5 WHEN 0 THEN 1 WHEN 1 THEN 1e-12 ELSE 0 END AS an,
  ['auto','exact','float_tolerance'][k % 3 + 1] AS compare, k % 17 > 0 AS literal, CASE k % 4 WHEN 0 THEN word WHEN 1 THEN 'seen ' || word || ' there' WHEN 2 THEN '' END AS stdout, word AS et, CASE k % 7 WHEN 0 THEN ' True ' WHEN 1 THEN '1_0.5e3' WHEN 2 THEN word || '!' WHEN 3 THEN '12 a' ELSE word END AS aw, k % 2 = 0 AS slip, k
  FROM (SELECT o_orderkey AS id, o_custkey + o_orderkey * 3 AS k, floor(o_totalprice) AS num, o_orderpriority AS word FROM orders))"""


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as expected and returned values."""
    o, k = A.table(spark, sf_dir, "orders"), F.col("o_custkey") + F.col("o_orderkey") * 3
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    num, word = F.floor("o_totalprice").cast("double"), F.col("o_orderpriority")
    shown = F.when(k % 7 == 0, " True ").when(k % 7 == 1, "1_0.5e3").when(k % 7 == 2, F.concat(word, F.lit("!"))).when(k % 7 == 3, "12 a").otherwise(word)
    return o.select(
        F.col("o_orderkey").alias("id"), k.alias("k"), F.struct(pick(_KINDS, k % 6).alias("kind"), num.alias("num"), word.alias("text")).alias("e"),
        F.struct(pick(_KINDS, F.floor(k / 6) % 6).alias("kind"), (num + F.when(k % 5 == 0, 1.0).when(k % 5 == 1, 1e-12).otherwise(0.0)).alias("num"), shown.alias("text"), (k % 17 > 0).alias("literal")).alias("a"),
        pick(["auto", "exact", "float_tolerance"], k % 3).alias("compare"), F.when(k % 4 == 0, word).when(k % 4 == 1, F.concat(F.lit("seen "), word, F.lit(" there"))).when(k % 4 == 2, "").alias("stdout"), (k % 2 == 0).alias("slip"),
    )


_CLOSE = "(en = an OR abs(en - an) <= greatest(1e-9 * greatest(abs(en), abs(an)), 1e-9))"
_PRINTED = "(coalesce(stdout, '') <> '' AND (trim(stdout) = et OR (length(et) >= 3 AND contains(stdout, et))))"
_VERDICT = f"""m AS (SELECT *, ek IN ('int','float') AND ak IN ('int','float') AS nums, (compare = 'float_tolerance' OR (compare = 'auto' AND (ek = 'float' OR ak = 'float'))) AND {_CLOSE} AS near FROM cases),
w AS (SELECT *, CASE WHEN nums AND ek = ak THEN CASE WHEN en = an THEN 'equal' WHEN ek = 'float' AND near THEN 'close' ELSE 'different' END WHEN nums AND ek = 'float' THEN CASE WHEN en = an OR near THEN 'int_for_float' ELSE 'different' END
  WHEN ek <> ak OR nums THEN 'different' WHEN et = aw THEN 'equal' ELSE 'different' END AS m FROM m),
v AS (SELECT id, slip, CASE WHEN NOT literal THEN CASE WHEN et = aw AND ek = ak THEN 'equal' WHEN ek <> ak THEN 'wrong_type' ELSE 'wrong_value' END WHEN m = 'equal' THEN 'equal' WHEN m = 'close' THEN 'float_close'
  WHEN m = 'int_for_float' THEN CASE WHEN compare = 'exact' THEN 'wrong_type' ELSE 'int_instead_of_float' END WHEN ek = 'bool' AND ak = 'str' AND trim(aw) IN ('True','False','true','false') THEN 'str_instead_of_bool'
  WHEN ek IN ('int','float') AND ak = 'str' AND aw = '1_0.5e3' THEN 'number_as_str' WHEN ak = 'NoneType' AND ek <> 'NoneType' THEN CASE WHEN {_PRINTED} THEN 'prints_instead_of_returns' ELSE 'returns_none' END
  WHEN ek = 'str' AND ak = 'str' THEN 'wrong_string' WHEN ek <> ak AND NOT (nums AND ek = 'float') THEN 'wrong_type' ELSE 'wrong_value' END AS kind FROM w)"""


@query(f"""WITH {_CASES}, {_VERDICT} SELECT id, CASE WHEN kind IN ('equal','float_close') THEN 'pass' WHEN kind = 'int_instead_of_float' THEN 'warning' ELSE 'fail' END AS status, kind,
  CASE WHEN kind IN ('equal','float_close') THEN NULL WHEN kind = 'int_instead_of_float' OR (kind = 'wrong_string' AND slip) THEN 'minor' ELSE 'major' END AS severity, CASE WHEN kind NOT IN ('equal','float_close') THEN kind END AS diagnosis FROM v""")
def value_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = cases(spark, sf_dir)
    return c.select("id", V.value_verdict(F.col("e"), F.col("a"), F.col("compare"), F.col("stdout"), F.col("slip")).alias("v")).select("id", "v.*")


_PARTS = """p AS (SELECT l_orderkey AS case_id, '/' || row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS path, l_quantity AS num, l_partkey AS k FROM lineitem),
e AS (SELECT case_id, path, CASE WHEN k % 6 > 0 THEN 'float' ELSE 'int' END AS kind, num FROM p UNION ALL SELECT case_id, '' AS path, 'list', count(*) FROM p GROUP BY ALL),
a AS (SELECT case_id, path, CASE WHEN k % 5 > 0 AND k % 6 > 0 THEN 'float' ELSE 'int' END AS kind, num + CASE WHEN k % 4 = 1 THEN 1e-12 WHEN k % 31 = 2 THEN 1 ELSE 0 END AS num FROM p WHERE k % 41 > 0 UNION ALL SELECT case_id, '', CASE WHEN case_id % 9 = 0 THEN 'tuple' ELSE 'list' END, count(*) FROM p WHERE k % 41 > 0 GROUP BY ALL)"""


@query(f"""WITH {_PARTS}, c AS (SELECT DISTINCT case_id, (['auto','exact','float_tolerance'])[case_id % 3 + 1] AS compare FROM p), f AS (SELECT case_id, bool_or(kind = 'float') AS fl FROM (SELECT * FROM e UNION ALL SELECT * FROM a) GROUP BY ALL),
t AS (SELECT case_id, compare = 'float_tolerance' OR (compare = 'auto' AND fl) AS tolerant FROM c JOIN f USING (case_id)), j AS (SELECT case_id, path, e.kind AS ek, a.kind AS ak, e.num AS en, a.num AS an FROM e FULL JOIN a USING (case_id, path)),
m AS (SELECT case_id, tolerant, CASE WHEN ek IS NULL OR ak IS NULL THEN 3 WHEN path = '' THEN CASE WHEN ek = ak AND en = an THEN 0 ELSE 3 END WHEN ek = ak THEN CASE WHEN en = an THEN 0 WHEN ek = 'float' AND tolerant AND {_CLOSE} THEN 1 ELSE 3 END
  WHEN ek = 'float' THEN CASE WHEN en = an OR (tolerant AND {_CLOSE}) THEN 2 ELSE 3 END ELSE 3 END AS r FROM t JOIN j USING (case_id))
SELECT case_id, tolerant, (['equal','close','int_for_float','different'])[max(r) + 1] AS match FROM m GROUP BY ALL""")
def container_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as lists of their quantities."""
    order, k, none = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"), F.col("k"), F.lit(None)
    p = A.table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("case_id"), F.concat(F.lit("/"), F.row_number().over(order).cast("string")).alias("path"), F.col("l_quantity").cast("double").alias("num"), F.col("l_partkey").alias("k"))

    def parts(rows: DataFrame, kind, num, top) -> DataFrame:
        items = rows.select("case_id", "path", kind.alias("kind"), num.alias("num"), none.cast("string").alias("text"), none.cast("long").alias("size"))
        return items.unionByName(rows.groupBy("case_id").agg(F.count("*").alias("size")).select("case_id", F.lit("").alias("path"), top.alias("kind"), none.cast("double").alias("num"), none.cast("string").alias("text"), "size"))

    e = parts(p, F.when(k % 6 > 0, "float").otherwise("int"), F.col("num"), F.lit("list"))
    a = parts(p.where(k % 41 > 0), F.when((k % 5 > 0) & (k % 6 > 0), "float").otherwise("int"), F.col("num") + F.when(k % 4 == 1, 1e-12).when(k % 31 == 2, 1.0).otherwise(0.0), F.when(F.col("case_id") % 9 == 0, "tuple").otherwise("list"))
    compare = p.select("case_id").distinct().withColumn("compare", F.element_at(F.array(*map(F.lit, ("auto", "exact", "float_tolerance"))), (F.col("case_id") % 3 + 1).cast("int")))
    return V.match_containers(e, a, compare)


@query(f"""WITH {_CASES}, t AS (SELECT *, CASE k % 5 WHEN 0 THEN NULL WHEN 1 THEN ['float','NoneType'] WHEN 2 THEN ['bool'] WHEN 3 THEN ['int'] ELSE ['list','str'] END AS allowed FROM cases),
v AS (SELECT id, CASE WHEN k % 11 = 0 THEN 'no_crash' WHEN allowed IS NULL THEN 'type_unchecked' WHEN list_contains(allowed, ak) THEN 'type_ok' WHEN ak = 'int' AND list_contains(allowed, 'float') THEN 'int_instead_of_float'
  WHEN list_contains(allowed, 'bool') AND ak = 'str' AND trim(aw) IN ('True','False','true','false') THEN 'str_instead_of_bool' WHEN list_has_any(allowed, ['int','float']) AND ak = 'str' AND aw = '1_0.5e3' THEN 'number_as_str'
  WHEN ak = 'NoneType' THEN CASE WHEN trim(coalesce(stdout, '')) <> '' THEN 'prints_instead_of_returns' ELSE 'returns_none' END ELSE 'wrong_type' END AS kind FROM t)
SELECT id, kind, CASE WHEN kind IN ('no_crash','type_unchecked','type_ok') THEN 'pass' WHEN kind = 'int_instead_of_float' THEN 'warning' ELSE 'fail' END AS status FROM v""")
def type_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c, k = cases(spark, sf_dir), F.col("k") % 5
    names = lambda *x: F.array(*map(F.lit, x))
    allowed = F.when(k == 1, names("float", "NoneType")).when(k == 2, names("bool")).when(k == 3, names("int")).when(k == 4, names("list", "str"))
    v = V.type_verdict(F.col("a"), allowed, F.col("k") % 11 != 0, F.col("stdout"))
    return c.select("id", v.alias("v")).select("id", "v.kind", "v.status")


_JOBS = "jobs AS (SELECT event_id AS job_id, user_id % 100 AS run_id, ['ok','timeout','output_limit','import_error','syntax_error','crash','harness_error','exception'][event_id % 8 + 1] AS status, event_id % 9 = 0 AS blocked, value AS timeout FROM events)"


def _jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    states = ["ok", *V.FAILURES]
    return A.table(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), (F.col("user_id") % 100).alias("run_id"), F.element_at(F.array(*map(F.lit, states)), (F.col("event_id") % 8 + 1).cast("int")).alias("status"), (F.col("event_id") % 9 == 0).alias("blocked"), F.col("value").alias("timeout"))


@query(f"""WITH {_JOBS} SELECT job_id, CASE WHEN blocked THEN 'blocked_syscall' WHEN status <> 'ok' THEN status END AS kind, CASE WHEN blocked THEN 'blocked_syscall' WHEN status = 'import_error' THEN 'import_crash' WHEN status IN ('crash','exception') THEN 'exception'
  WHEN status IN ('timeout','output_limit','syntax_error') THEN status END AS diagnosis FROM jobs""")
def runtime_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    ops = F.when(F.col("blocked"), F.array(F.lit("open")))
    return _jobs(spark, sf_dir).select("job_id", V.runtime_failure(F.col("status"), ops).alias("v")).select("job_id", "v.kind", "v.diagnosis")


@query(f"""WITH {A.CHECKS}, p AS (SELECT run_id, check_id, CASE WHEN status IN ('bonus','info') THEN 'warning' ELSE status END AS outcome, nullif(severity, 'none') AS severity, mandatory AS required, bonus, CASE WHEN category = 'git' THEN 'heuristic_tests' ELSE category END AS category FROM deduped)
SELECT run_id, check_id, CASE WHEN outcome <> 'fail' THEN outcome WHEN bonus THEN 'bonus' WHEN category = 'heuristic_tests' THEN 'warning' ELSE 'fail' END AS status,
  CASE WHEN outcome IN ('pass','skipped') THEN NULL WHEN outcome = 'fail' AND NOT bonus AND category = 'heuristic_tests' THEN CASE severity WHEN 'critical' THEN 'major' WHEN 'style' THEN 'style' ELSE 'minor' END ELSE severity END AS severity, required AND NOT bonus AND category <> 'heuristic_tests' AS mandatory, bonus FROM p""")
def check_policies(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = deduped(spark, sf_dir)
    outcome = F.when(F.col("status").isin("bonus", "info"), "warning").otherwise(F.col("status"))
    category = F.when(F.col("category") == "git", "heuristic_tests").otherwise(F.col("category"))
    p = V.check_policy(outcome, F.nullif("severity", F.lit("none")), F.col("mandatory"), F.col("bonus"), category)
    return rows.select("run_id", "check_id", p.alias("p")).select("run_id", "check_id", "p.*")


# ---------------------------------------------------------------- plans


@query(f"WITH {_JOBS} SELECT run_id, sum(timeout + 2.0) / greatest(1, least(4, 8, count(*))) + max(timeout + 2.0) + 5.0 AS seconds, greatest(1, least(4, 8, count(*)))::INT AS workers FROM jobs GROUP BY run_id")
def time_budgets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.time_budgets(_jobs(spark, sf_dir))


@query(f"WITH {_JOBS} SELECT run_id, job_id, CASE WHEN job_id % 10 = 3 THEN 'harness_error' ELSE status END AS status, CASE WHEN job_id % 10 = 3 THEN 0.0 ELSE timeout END AS duration_ms FROM jobs")
def job_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = _jobs(spark, sf_dir)
    results = jobs.where("job_id % 10 <> 3").select("run_id", "job_id", "status", F.col("timeout").alias("duration_ms"))
    return PL.with_results(jobs.select("run_id", "job_id"), results)


_MAP = """fm AS (SELECT DISTINCT p_partkey % 40 AS project_id, 's0' AS subject_id, 'src/m' || (p_partkey // 40 % 6) || '.py' AS file, CASE WHEN (p_partkey % 40 + p_partkey // 40 % 6) % 4 > 0 THEN 'app/m' || (p_partkey // 40 % 6) || '.py' END AS found FROM part),
mods AS (SELECT DISTINCT project_id, found AS path, (project_id + length(found) + ascii(found[6])) % 7 > 0 AS ok FROM fm WHERE found IS NOT NULL),
fn AS (SELECT DISTINCT p_partkey % 40 AS project_id, 'app/m' || (p_partkey // 40 % 6) || '.py' AS path, 'f' || (p_partkey // 3 % 7) AS "function" FROM part),
blk AS (SELECT * FROM (SELECT p.project_id, f.file, CASE WHEN fm.found IS NULL THEN 'structure:file:' || f.file WHEN NOT coalesce(mods.ok, false) THEN 'syntax:' || f.file END AS blocker FROM (SELECT DISTINCT project_id, subject_id FROM fm) p JOIN (SELECT DISTINCT subject_id, file FROM ex) f USING (subject_id)
  LEFT JOIN fm ON fm.project_id = p.project_id AND fm.file = f.file LEFT JOIN mods ON mods.project_id = p.project_id AND mods.path = fm.found) WHERE blocker IS NOT NULL),
prim AS (SELECT fm.project_id, fm.subject_id, fm.file, e.exercise_id, fm.found AS module_path FROM fm JOIN (SELECT * FROM ex WHERE pos <> 2 QUALIFY row_number() OVER (PARTITION BY subject_id, file ORDER BY bonus, pos) = 1) e ON e.subject_id = fm.subject_id AND e.file = fm.file
  WHERE fm.found IS NOT NULL AND NOT EXISTS (SELECT 1 FROM blk WHERE blk.project_id = fm.project_id AND blk.file = fm.file))"""


def _file_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    """part as the files that projects were found to have; two thirds of them where the subject wants them."""
    n, k = F.col("p_partkey"), F.floor(F.col("p_partkey") / 40) % 6
    name = lambda folder: F.concat(F.lit(folder), k.cast("string"), F.lit(".py"))
    return A.table(spark, sf_dir, "part").select((n % 40).alias("project_id"), F.lit("s0").alias("subject_id"), name("src/m").alias("file"), F.when((n % 40 + k) % 4 > 0, name("app/m")).alias("found")).distinct()


def _blockers(spark: SparkSession, sf_dir: str, fm: DataFrame) -> DataFrame:
    ok = (F.col("project_id") + F.length("found") + F.ascii(F.substring("found", 6, 1))) % 7 > 0
    mods = fm.where("found is not null").select("project_id", F.col("found").alias("path"), ok.alias("ok"))
    return PL.file_blockers(A.exercises(spark), fm, mods)


def _kinds(spark: SparkSession) -> DataFrame:
    return A.exercises(spark).withColumn("kind", F.when(F.col("pos") == 2, "script").otherwise("functions"))


@query(f"WITH {A.EXERCISES}, {_MAP} SELECT * FROM blk")
def file_blockers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _blockers(spark, sf_dir, _file_map(spark, sf_dir))


_TESTS = """tests AS (SELECT l_suppkey % 40 AS project_id, 's0' AS subject_id, CASE WHEN l_partkey % 97 = 0 THEN 'import:ex' || (l_partkey % 3) ELSE 't' || (l_partkey % 500) END AS test_id, 'ex' || (l_orderkey % 9) AS exercise_id, CASE WHEN l_linenumber <> 3 THEN 'f' || (l_partkey % 9) END AS "function",
  struct_pack(a := l_orderkey, b := l_linenumber, c := l_partkey, d := l_suppkey, e := l_extendedprice) AS pos FROM lineitem)"""


def _tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    pos = F.struct(F.col("l_orderkey").alias("a"), F.col("l_linenumber").alias("b"), F.col("l_partkey").alias("c"), F.col("l_suppkey").alias("d"), F.col("l_extendedprice").alias("e"))
    name = lambda p, c, n: F.concat(F.lit(p), (F.col(c) % n).cast("string"))
    test_id = F.when(F.col("l_partkey") % 97 == 0, name("import:ex", "l_partkey", 3)).otherwise(name("t", "l_partkey", 500))
    return A.table(spark, sf_dir, "lineitem").select(
        (F.col("l_suppkey") % 40).alias("project_id"), F.lit("s0").alias("subject_id"), test_id.alias("test_id"), name("ex", "l_orderkey", 9).alias("exercise_id"), F.when(F.col("l_linenumber") != 3, name("f", "l_partkey", 9)).alias("function"), pos.alias("pos")
    )


@query(f"""WITH {A.EXERCISES}, {_MAP}, {_TESTS}, told AS (
  SELECT t.project_id, t.test_id, t.exercise_id, CASE WHEN t."function" IS NULL THEN 'script' ELSE 'function' END AS kind, CASE WHEN t."function" IS NULL THEN 2 ELSE 1 END AS stage, t.pos, fm.found AS module_path, ex.exercise_id IS NOT NULL AS known,
    CASE WHEN ex.exercise_id IS NULL THEN NULL WHEN blk.blocker IS NOT NULL THEN blk.blocker WHEN fm.found IS NULL THEN 'structure:file:' || ex.file WHEN t."function" IS NOT NULL AND fn."function" IS NULL THEN 'function:' || t.exercise_id || ':' || t."function" END AS blocked_by
  FROM tests t LEFT JOIN ex ON ex.exercise_id = t.exercise_id LEFT JOIN fm ON fm.project_id = t.project_id AND fm.file = ex.file LEFT JOIN blk ON blk.project_id = t.project_id AND blk.file = ex.file
    LEFT JOIN fn ON fn.project_id = t.project_id AND fn.path = fm.found AND fn."function" = t."function"
  UNION ALL SELECT project_id, 'import:' || exercise_id, exercise_id, 'import', 0, NULL, module_path, true, NULL FROM prim)
SELECT project_id, test_id, exercise_id, kind, CASE WHEN NOT known THEN 'unknown_exercise' WHEN blocked_by IS NOT NULL THEN 'blocked'
    WHEN row_number() OVER (PARTITION BY project_id, test_id, known AND blocked_by IS NULL ORDER BY stage, pos, exercise_id) = 1 THEN 'run' ELSE 'repeated' END AS outcome, blocked_by,
  CASE WHEN known AND blocked_by IS NULL THEN module_path END AS module_path FROM told""")
def plan_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = _file_map(spark, sf_dir)
    n = F.col("p_partkey")
    path = F.concat(F.lit("app/m"), (F.floor(n / 40) % 6).cast("string"), F.lit(".py"))
    functions = A.table(spark, sf_dir, "part").select((n % 40).alias("project_id"), path.alias("path"), F.concat(F.lit("f"), (F.floor(n / 3) % 7).cast("string")).alias("function"))
    return PL.plan_tests(_tests(spark, sf_dir), _kinds(spark), fm, _blockers(spark, sf_dir, fm), functions)


@query(f"WITH {_TESTS} SELECT project_id, test_id, count(*) AS times FROM tests GROUP BY ALL HAVING count(*) > 1")
def repeated_test_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return PL.repeated_ids(_tests(spark, sf_dir), "project_id", "test_id")


@query(f"WITH {A.EXERCISES}, {_MAP} SELECT project_id, file, exercise_id FROM prim")
def primary_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    fm = _file_map(spark, sf_dir)
    return PL.runnable_exercises(_kinds(spark), fm, _blockers(spark, sf_dir, fm)).select("project_id", "file", "exercise_id")


# ---------------------------------------------------------------- orders

_RANKED = f"{A.CHECKS}, k AS (SELECT d.*, coalesce(sr, 9) AS s, report_rank AS r, coalesce(nullif(file, ''), nullif(location_file, '')) AS key FROM deduped d LEFT JOIN sev USING (severity) JOIN st USING (status)), i AS (SELECT * FROM k WHERE status IN ('fail','skipped','bonus','warning'))"


@query(f"WITH {_RANKED} SELECT run_id, check_id, row_number() OVER (PARTITION BY run_id ORDER BY r, s, check_id) AS place FROM i")
def ordered_issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OR.ordered_issues(deduped(spark, sf_dir)).select("run_id", "check_id", "place")


@query(f"""WITH {_RANKED} SELECT run_id, category, check_id, list_position(['structure','syntax','functions','explicit_tests','derived_tests','output','constraints','runtime','git','heuristic_tests'], category)::INT AS category_place,
  row_number() OVER (PARTITION BY run_id, category ORDER BY r, s, mandatory DESC, emit_seq) AS place FROM k""")
def checks_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OR.by_category(deduped(spark, sf_dir)).select("run_id", "category", "check_id", "category_place", "place")


@query(f"""WITH {_RANKED}, f(path, pos) AS (VALUES ('src/m3.py', 0), ('src/m1.py', 1), ('src/m7.py', 2)), g AS (SELECT DISTINCT run_id, coalesce(key, 'General') AS key FROM i),
o AS (SELECT g.*, row_number() OVER (PARTITION BY run_id ORDER BY CASE WHEN pos IS NOT NULL THEN 0 WHEN key <> 'General' THEN 1 ELSE 2 END, pos, key) AS group_place FROM g LEFT JOIN f ON key = path)
SELECT o.run_id, o.key, check_id, group_place, row_number() OVER (PARTITION BY o.run_id, o.key ORDER BY r, s, check_id) AS place FROM i JOIN o ON o.run_id = i.run_id AND o.key = coalesce(i.key, 'General')""")
def issues_by_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = spark.createDataFrame([("src/m3.py", 0), ("src/m1.py", 1), ("src/m7.py", 2)], "path string, pos int")
    return OR.by_file_of_subject(deduped(spark, sf_dir), files).select("run_id", "key", "check_id", "group_place", "place")


@query(f"""WITH {_RANKED}, g AS (SELECT run_id, coalesce(key, '') AS key, count(*) AS issues, min(r * 100 + s * 10 + CASE WHEN mandatory THEN 0 ELSE 1 END) AS w FROM i GROUP BY ALL)
SELECT run_id, key, issues, row_number() OVER (PARTITION BY run_id ORDER BY w, issues DESC, key = '', key) AS place FROM g""")
def file_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OR.file_groups(deduped(spark, sf_dir))


@query(f"""WITH {A.CHECKS} SELECT run_id, count(*) FILTER (WHERE status IN ('fail','skipped')) AS n_issues, count(*) FILTER (WHERE status IN ('warning','info')) AS n_warnings, count(*) FILTER (WHERE bonus OR status = 'bonus') AS n_bonus,
  count(*) FILTER (WHERE status = 'pass') AS n_passed, count(*) AS n_all FROM deduped GROUP BY run_id""")
def filter_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return OR.filter_counts(deduped(spark, sf_dir))


@query("""WITH j AS (SELECT o_custkey % 20 AS owner, o_orderkey AS job_id, o_orderdate AS created, o_orderstatus <> 'O' AS finished FROM orders), x AS (SELECT owner, count(*) - 40 AS extra FROM j GROUP BY owner),
o AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY created, job_id) AS nth FROM j WHERE finished) SELECT owner, job_id FROM o JOIN x USING (owner) WHERE nth <= extra""")
def evicted_jobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    jobs = A.table(spark, sf_dir, "orders").select((F.col("o_custkey") % 20).alias("owner"), F.col("o_orderkey").alias("job_id"), F.col("o_orderdate").alias("created"), (F.col("o_orderstatus") != "O").alias("finished"))
    return OR.evicted_jobs(jobs, 40)


# ---------------------------------------------------------------- summaries


@query(f"""WITH {A.CHECKS}, g AS (SELECT run_id, category, count(*) AS n, count(*) FILTER (WHERE status = 'pass') AS p, count(*) FILTER (WHERE status IN ('fail','skipped')) AS f, count(*) FILTER (WHERE status = 'warning') AS w,
  count(*) FILTER (WHERE status = 'bonus') AS b, count(*) FILTER (WHERE status IN ('fail','skipped') AND mandatory AND NOT bonus) AS blocking FROM deduped GROUP BY ALL)
SELECT run_id, category, p || ' / ' || n || ' passed' || CASE WHEN f > 0 THEN ' · ' || f || ' failing' ELSE '' END || CASE WHEN w = 1 THEN ' · 1 warning' WHEN w > 1 THEN ' · ' || w || ' warnings' ELSE '' END
  || CASE WHEN b > 0 THEN ' · ' || b || ' bonus not done' ELSE '' END AS summary, CASE WHEN blocking > 0 THEN 'fail' WHEN f + w > 0 THEN 'warning' WHEN b > 0 THEN 'bonus' ELSE 'pass' END AS tone FROM g""")
def section_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SU.section_summaries(deduped(spark, sf_dir), ["run_id", "category"])


@query("""WITH c AS (SELECT p_size AS project_id, split_part(p_type, ' ', 1) AS name, count(*) AS files FROM part GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY files DESC, name) AS place FROM c)
SELECT * FROM r WHERE place <= 3""")
def heaviest_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = F.concat_ws("/", F.replace("p_type", F.lit(" "), F.lit("/")), F.col("p_partkey").cast("string"))
    return SU.heaviest_entries(A.table(spark, sf_dir, "part").select(F.col("p_size").alias("project_id"), path.alias("path"), F.lit("file").alias("kind")))


@query("""WITH f AS (SELECT l_suppkey AS project_id, 'm' || (l_partkey % 7) || '.py' AS path, 'fn' || (l_orderkey % 40) AS name, l_linenumber AS line FROM lineitem), e AS (SELECT DISTINCT project_id, 'm' || (k % 7) || '.py' AS path, 'fn' || k AS name FROM f, range(40) t(k)),
m AS (SELECT * FROM e ANTI JOIN f USING (project_id, path, name)), d AS (SELECT DISTINCT ON (project_id, name, path) * FROM f ORDER BY project_id, name, path, line),
h AS (SELECT m.project_id, m.path, m.name, d.path AS found_path, d.line, row_number() OVER (PARTITION BY m.project_id, m.path, m.name ORDER BY d.path) AS nth, count(*) OVER (PARTITION BY m.project_id, m.path, m.name) - 1 AS more FROM m JOIN d ON d.project_id = m.project_id AND d.name = m.name)
SELECT project_id, path, name, found_path, line, more FROM h WHERE nth = 1""")
def defined_elsewhere(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = A.table(spark, sf_dir, "lineitem")
    name = lambda k: F.concat(F.lit("fn"), k.cast("string"))
    path = lambda k: F.concat(F.lit("m"), (k % 7).cast("string"), F.lit(".py"))
    functions = li.select(F.col("l_suppkey").alias("project_id"), path(F.col("l_partkey")).alias("path"), name(F.col("l_orderkey") % 40).alias("name"), F.col("l_linenumber").alias("line"))
    wanted = functions.select("project_id").distinct().withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(39)))).select("project_id", path(F.col("k")).alias("path"), name(F.col("k")).alias("name"))
    return SU.defined_elsewhere(wanted, functions)
