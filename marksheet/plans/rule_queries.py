"""Queries of test cases from rules, with their SQL: parts are functions f(x, lim) with thresholds, their lines calls of these."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.operators import boundaries as B

from . import adapters as A
from .queries import query

_CALLS = """p AS (SELECT p_partkey AS n, p_size AS s, p_retailprice / 50 AS r, CASE WHEN p_partkey % 5 = 0 THEN 3 END AS d FROM part),
c AS (SELECT DISTINCT l_partkey AS n, l_quantity::INT AS x, l_linenumber::INT AS given FROM lineitem),
b AS (SELECT p.*, c.x::DOUBLE AS x, CASE WHEN given = 7 THEN d ELSE given END::DOUBLE AS lim, x * 10 + given AS pos, given % 2 AS late FROM p JOIN c USING (n) WHERE given < 7 OR d IS NOT NULL)"""
_FIRST = "CASE WHEN {x} < s THEN 0 WHEN s <= {x} AND {x} <= r THEN 1 WHEN {x} = {lim} AND n % 6 > 0 THEN 2 WHEN n % 2 = 0 THEN 3 END"
_GIVES = """CASE k WHEN 0 THEN 'low' WHEN 1 THEN ({x})::DOUBLE::VARCHAR WHEN 3 THEN CASE WHEN n % 10 > 0 THEN '0.0' END ELSE CASE WHEN k IS NULL AND n % 7 = 0 THEN 'ref' END END"""


def _functions(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, ...]:
    n, s, r = F.col("function_id"), F.col("p_size"), F.col("p_retailprice") / 50
    part = A.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("function_id"), "p_size", "p_retailprice")
    no = F.lit(None).cast(B.VALUE)
    functions = part.select("function_id", F.expr("function_id div 50").alias("spec_id"), F.concat(F.lit("f"), n.cast("string")).alias("name"), F.lit("explicit").alias("provenance"), (n % 9 > 0).alias("must_return"), F.when(n % 7 == 0, B.value("str", None, F.lit("ref"))).alias("reference"))
    simple = F.element_at(F.array(F.lit("int"), F.lit("float"), F.lit(None), F.lit("str")), (n % 4 + 1).cast("int"))
    x = F.struct(F.lit(0).alias("pos"), F.lit("x").alias("name"), simple.alias("annotation"), no.alias("default"))
    lim = F.struct(F.lit(1).alias("pos"), F.lit("lim").alias("name"), F.lit(None).cast("string").alias("annotation"), F.when(n % 5 == 0, B.value("int", F.lit(3))).alias("default"))
    params = part.select("function_id", F.inline(F.array(x, lim)))
    rule = lambda k, provenance, raises=None, returns=None, param=None: F.struct(F.lit(k).alias("rule_pos"), provenance.alias("provenance"), F.lit(raises).cast("string").alias("raises"), (no if returns is None else returns).alias("returns"), F.lit(param).cast("string").alias("returns_param"))
    first = rule(0, F.lit("explicit"), returns=B.value("str", None, F.lit("low")))
    second, third = rule(1, F.when(n % 3 == 0, "ai_extracted").otherwise("explicit"), param="x"), rule(2, F.when(n % 6 == 0, "derived").otherwise("user"), raises="ValueError")
    last = rule(3, F.lit("explicit"), returns=F.when(n % 10 > 0, B.value("int", F.lit(0))))
    rules = part.select("function_id", F.inline(F.when(n % 2 == 0, F.array(first, second, third, last)).otherwise(F.array(first, second, third))))
    name = lambda v: F.lit(v).cast("string")
    comparison = lambda k, pos, op, lp, lv, rp, rv: F.struct(F.lit(k).alias("rule_pos"), F.lit(pos).alias("pos"), name(lp).alias("left_param"), lv.alias("left_value"), F.lit(op).alias("op"), name(rp).alias("right_param"), rv.alias("right_value"))
    size, price = B.value("int", s), B.value("float", r)
    four = [comparison(0, 0, "<", "x", no, None, size), comparison(1, 0, "<=", None, size, "x", no), comparison(1, 1, "<=", "x", no, None, price), comparison(2, 0, "==", "x", no, "lim", no)]
    comparisons = part.select("function_id", F.inline(F.array(*four)))
    lines = A.table(spark, sf_dir, "lineitem").select(F.col("l_partkey").alias("function_id"), F.col("l_quantity").cast("int").alias("x"), F.col("l_linenumber").cast("int").alias("given")).distinct().withColumn("pos", F.col("x") * 10 + F.col("given"))
    calls = lines.select("function_id", "pos", F.when(F.col("given") % 2 == 0, "explicit").otherwise("derived").alias("provenance"))
    both = F.array(F.struct(F.lit("x").alias("name"), B.value("int", F.col("x")).alias("value")), F.struct(F.lit("lim").alias("name"), B.value("int", F.col("given")).alias("value")))
    args = lines.select("function_id", F.col("pos").alias("call_pos"), F.inline(F.slice(both, 1, F.when(F.col("given") == 7, 1).otherwise(2))))
    used = lines.where("given = 1").select(F.expr("function_id div 50").alias("spec_id"), F.concat(F.lit("f"), n.cast("string"), F.lit("#derived"), (F.col("x") % 6).cast("string")).alias("test_id"))
    return functions, params, calls, args, rules, comparisons, used


def _shown(v: str) -> Column:
    return F.coalesce(F.col(f"{v}.text"), F.col(f"{v}.num").cast("string"))


@query(f"""WITH {_CALLS}, f AS (SELECT *, {_FIRST.format(x='x', lim='lim')} AS k FROM b), g AS (SELECT *, {_GIVES.format(x='x')} AS expected FROM f WHERE n % 9 > 0)
SELECT n AS function_id, pos, expected, CASE WHEN k = 2 THEN 'ValueError' END AS exception FROM g WHERE expected IS NOT NULL OR k = 2""")
def filled_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = B.filled_calls(*_functions(spark, sf_dir)[:6])
    return got.select("function_id", "pos", _shown("expected").alias("expected"), "exception")


@query(f"""WITH {_CALLS}, base AS (SELECT n, arg_min(x, (late, pos)) AS bx, arg_min(lim, (late, pos)) AS bl FROM b GROUP BY n),
q AS (SELECT p.*, coalesce(bx, 1) AS bx, coalesce(bl, d, 1) AS bl FROM p LEFT JOIN base USING (n) WHERE n % 4 < 3 AND n % 9 > 0),
z AS (SELECT *, CASE WHEN n % 4 = 1 THEN [s, s + 0.5, s - 0.5]::DOUBLE[] ELSE [s - 1, s, s + 1]::DOUBLE[] END AS around_s,
  CASE WHEN n % 4 = 1 THEN [r, r + 0.5, r - 0.5] WHEN floor(r) <> r THEN [floor(r), ceil(r)] ELSE [r - 1, r, r + 1] END AS around_r,
  CASE WHEN n % 4 = 1 THEN [bl, bl + 0.5, bl - 0.5] ELSE [bl, bl + 1, bl - 1] END AS around_l FROM q),
u AS (SELECT *, 0 AS rule_pos, 0 AS in_rule, generate_subscripts(around_s, 1) - 1 AS point, unnest(around_s) AS x FROM z UNION ALL SELECT *, 1, 1, generate_subscripts(around_r, 1) - 1, unnest(around_r) FROM z
  UNION ALL SELECT *, 2, 0, generate_subscripts(around_l, 1) - 1, unnest(around_l) FROM z WHERE n % 6 > 0),
v AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY n, x ORDER BY rule_pos, in_rule, point) AS turn FROM u) WHERE turn = 1),
w AS (SELECT v.*, {_FIRST.format(x='v.x', lim='v.bl').replace(' s ', ' v.s ')} AS k FROM v ANTI JOIN b ON b.n = v.n AND b.x = v.x AND b.lim = v.bl),
y AS (SELECT *, {_GIVES.format(x='x')} AS expected FROM w),
t AS (SELECT *, row_number() OVER (PARTITION BY n ORDER BY rule_pos, in_rule, point) AS m FROM y WHERE expected IS NOT NULL OR k = 2),
free AS (SELECT n, i, row_number() OVER (PARTITION BY n ORDER BY i) AS m FROM (SELECT n, unnest(range(1, 20)) AS i FROM p)
  WHERE (n, i) NOT IN (SELECT (n, (x % 6)::BIGINT) FROM c WHERE given = 1))
SELECT n AS function_id, 'f' || n || '#derived' || i AS test_id, rule_pos, in_rule AS pos, point, x, bl AS lim, expected, CASE WHEN k = 2 THEN 'ValueError' END AS exception,
  CASE WHEN n % 3 = 0 AND (rule_pos = 1 OR coalesce(k, 0) = 1) THEN 0.6::DOUBLE ELSE 0.9::DOUBLE END AS confidence FROM t JOIN free USING (n, m)""")
def derived_tests(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = B.derived_tests(*_functions(spark, sf_dir))
    arg = lambda k: F.get("assignment", F.lit(k))["value"]["num"]
    return got.select("function_id", "test_id", "rule_pos", "pos", "point", arg(0).alias("x"), arg(1).alias("lim"), _shown("expected").alias("expected"), "exception", "confidence")
