"""Queries of merged specs over the driver's tables, with their SQL: even parts are one parser's exercises, odd ones the other's."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.operators import spec_merge as M

from . import adapters as A
from .queries import query

_ODD = """ex AS (SELECT p_partkey // 50 AS spec_id, p_partkey AS pos, 'e' || (p_partkey % 20) AS exercise_id, 'src/m' || ((p_partkey // 2) % 6) || '.py' AS file, p_partkey % 2 AS side FROM part),
t AS (SELECT l_partkey // 50 AS spec_id, l_partkey AS exercise_pos, l_partkey % 2 AS side, 'f' || ((l_partkey // 2 + CASE WHEN l_partkey % 7 = 0 THEN 3 ELSE 0 END) % 25) || '_' || (l_linenumber % 3) AS name, l_quantity::INT AS pos FROM lineitem GROUP BY ALL),
had AS (SELECT *, CASE WHEN pos % 3 = 0 THEN name || '#old' || pos ELSE name || '#ex' || (pos % 40) END AS test_id FROM t WHERE side = 0)"""


def _specs(spark: SparkSession, sf_dir: str) -> tuple[M.Spec, M.Spec]:
    """Exercises from part; each line of one is a test of a function, whose argument is the quantity. A part of the ids look allotted."""
    n, k = F.col("p_partkey"), F.col("l_partkey")
    script = F.when(n % 3 == 0, F.struct(F.array(F.when(n % 4 > 1, F.col("p_type"))).alias("prompts"), F.array("p_brand").alias("required_outputs")))
    script = F.when(script.isNotNull(), F.struct(F.filter(script["prompts"], lambda p: p.isNotNull()).alias("prompts"), script["required_outputs"].alias("required_outputs")))
    ex = A.table(spark, sf_dir, "part").select(
        F.expr("p_partkey div 50").alias("spec_id"), n.alias("pos"), F.concat(F.lit("e"), (n % 20).cast("string")).alias("exercise_id"), F.concat(F.lit("src/m"), F.expr("p_partkey div 2 % 6").cast("string"), F.lit(".py")).alias("file_path"),
        F.when(n % 5 == 0, "file").when(script.isNotNull(), "script").otherwise("functions").alias("kind"), script.isNotNull().alias("side_effects"), script.alias("script"), F.lit(None).cast("string").alias("constraints"), (n % 2).alias("side"),
    )
    name = F.concat(F.lit("f"), ((F.expr("l_partkey div 2") + F.when(k % 7 == 0, 3).otherwise(0)) % 25).cast("string"), F.lit("_"), (F.col("l_linenumber") % 3).cast("string"))
    tests = A.table(spark, sf_dir, "lineitem").select(F.expr("l_partkey div 50").alias("spec_id"), k.alias("exercise_pos"), (k % 2).alias("side"), name.alias("function"), F.col("l_quantity").cast("int").alias("pos")).distinct()
    tests = tests.withColumn("test_id", F.when(F.col("pos") % 3 == 0, F.concat("function", F.lit("#old"), F.col("pos").cast("string"))).otherwise(F.concat("function", F.lit("#ex"), (F.col("pos") % 40).cast("string")))).withColumn("call", F.col("pos").cast("string"))
    functions = tests.groupBy("spec_id", "exercise_pos", "side", F.col("function").alias("name")).agg(F.min("pos").alias("pos")).withColumn("rules", F.when(F.col("pos") < 3, F.array(F.lit("low")))).withColumn("reference", F.lit(None).cast("string"))
    functions = functions.withColumn("pos", F.col("pos") * 10 + F.substring("name", -1, 1).cast("int"))
    return tuple(M.Spec(*(t.where(F.col("side") == side).drop("side") for t in (ex, functions, tests))) for side in (0, 1))


@query(f"""WITH {_ODD}, room AS (SELECT spec_id, name, count(*) AS c FROM t GROUP BY ALL),
free AS (SELECT spec_id, name, n, row_number() OVER (PARTITION BY spec_id, name ORDER BY n) AS k FROM (SELECT spec_id, name, unnest(range(1, c + 41)) AS n FROM room) r WHERE NOT EXISTS (SELECT 1 FROM had h WHERE h.spec_id = r.spec_id AND h.test_id = r.name || '#ex' || r.n)),
asked AS (SELECT *, row_number() OVER (PARTITION BY spec_id, name ORDER BY exercise_pos, pos) AS k FROM t WHERE side = 1)
SELECT spec_id, exercise_pos, name AS function, pos, name || '#ex' || n AS test_id FROM asked JOIN free USING (spec_id, name, k)""")
def free_test_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """New ids for the tests of all odd parts beside those of the even ones."""
    base, other = _specs(spark, sf_dir)
    wanted = other.tests.select("spec_id", F.concat("function", F.lit("#ex")).alias("prefix"), F.struct("exercise_pos", "pos").alias("pos"), "function")
    return M.free_numbers(wanted, base.tests).select("spec_id", "pos.exercise_pos", "function", "pos.pos", "test_id")


@query(f"""WITH RECURSIVE {_ODD}, fn AS (SELECT DISTINCT spec_id, exercise_pos, side, name FROM t),
names AS (SELECT spec_id, name, min(exercise_pos) FILTER (side = 1) AS first, coalesce(bool_or(side = 0), false) AS in_base FROM fn GROUP BY ALL),
holds AS (SELECT f.spec_id, f.name, e.file, f.exercise_pos AS place FROM fn f JOIN ex e ON e.pos = f.exercise_pos JOIN names n ON n.spec_id = f.spec_id AND n.name = f.name WHERE f.side = 0 OR (NOT n.in_base AND n.first = f.exercise_pos)),
turns AS (SELECT e.spec_id, e.file, e.pos, row_number() OVER (PARTITION BY e.spec_id, e.file ORDER BY e.pos) AS turn,
  coalesce((SELECT bool_or(n.in_base OR n.first < e.pos) FROM fn f JOIN names n USING (spec_id, name) WHERE f.exercise_pos = e.pos), false) AS known,
  coalesce((SELECT list(DISTINCT h.place) FROM fn f JOIN holds h USING (spec_id, name) WHERE f.exercise_pos = e.pos AND h.file = e.file), []) AS shared FROM ex e WHERE side = 1),
fold(spec_id, file, turn, untaken, pos, place) AS (
  SELECT spec_id, file, 0::BIGINT, list(pos ORDER BY pos) FILTER (side = 0), NULL::BIGINT, NULL::BIGINT FROM ex GROUP BY spec_id, file
  UNION ALL SELECT spec_id, file, turn, CASE WHEN place IS NULL THEN left_over || [pos] ELSE list_filter(left_over, lambda x: x <> place) END, pos, coalesce(place, pos) FROM (
    SELECT f.spec_id, f.file, u.turn, u.pos, coalesce(f.untaken, []) AS left_over,
      CASE WHEN len(list_filter(coalesce(f.untaken, []), lambda x: list_contains(u.shared, x))) > 0 THEN list_filter(coalesce(f.untaken, []), lambda x: list_contains(u.shared, x))[1] WHEN len(coalesce(f.untaken, [])) = 1 AND NOT u.known THEN f.untaken[1] END AS place
    FROM fold f JOIN turns u ON u.spec_id = f.spec_id AND u.file = f.file AND u.turn = f.turn + 1))
SELECT spec_id, pos AS exercise_pos, (place % 2)::INT AS side, place AS pos FROM fold WHERE turn > 0""")
def matched_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.match_exercises(*_specs(spark, sf_dir))


@query()
def merged_exercises(spark: SparkSession, sf_dir: str) -> DataFrame:
    exercises = M.merge_specs(*_specs(spark, sf_dir)).exercises
    return exercises.select("spec_id", "side", "pos", "exercise_id", "file_path", "kind", "side_effects", F.array_join("script.prompts", "|").alias("prompts"), F.array_join("script.required_outputs", "|").alias("required_outputs"), "added")


@query()
def merged_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    return M.merge_specs(*_specs(spark, sf_dir)).tests
