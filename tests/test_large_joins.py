"""Joins of tables that grow are dealt by key: at 60 times sf0.1 these broadcast tables that the driver couldn't hold."""

import ast
import contextlib
import io
import re
from collections import Counter
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from marksheet.operators import events as EV
from marksheet.operators import scoring as SC
from marksheet.operators import source_facts as SF
from marksheet.operators import textdiff as TD
from marksheet.plans import adapters as A
from marksheet.plans.queries import ORACLES, QUERIES
from marksheet.sources import snapshots as SN
from marksheet.sources import tables as T

DATA = "/root/testdata/sf0.001"


def plan(df):
    said = io.StringIO()
    with contextlib.redirect_stdout(said):
        df.explain()
    return said.getvalue()


@pytest.mark.parametrize("name", ["filled_calls", "derived_tests", "printed_literals"])
def test_nothing_is_broadcast(spark, name):
    assert "Broadcast" not in plan(entry.queries()[name](spark, DATA))


def test_work_follows_the_rows(spark):
    few = spark.createDataFrame([(i, "abs(1)\n") for i in range(3)], "file_id int, source string").coalesce(1)
    assert SF.source_facts(few).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    rows = spark.range(10 * T.ROWS_A_TASK, numPartitions=1)
    dealt = T.spread(rows, "id")
    assert dealt.rdd.getNumPartitions() >= 10 and dealt.count() == rows.count()


def test_tasks_of_sources_follow_the_sources(spark, monkeypatch):
    monkeypatch.setattr(SF, "SOURCES_A_TASK", 10)
    monkeypatch.setattr(SF, "ROWS_A_FRAME", 3)
    sources = spark.range(400).selectExpr("id AS file_id", "concat('import a\nabs(', id, ')\nx.y(len(1))\n') AS source")
    facts = SF.source_facts(sources, only=["call"])
    assert facts.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, facts.select("file_id", "fact", "name", "line").collect())) == [(i, "call", n, k) for i in range(400) for n, k in (("abs", 2), ("len", 3))]


def test_long_chains_of_attributes(spark):
    chain = "x" + ".a" * 1500
    got = SF.source_facts(spark.createDataFrame([(1, f"{chain}()\nabs({chain})\n")], "file_id int, source string")).collect()
    assert {(r.fact, r.name, r.line) for r in got} == {("method", chain, 1), ("call", "abs", 2)}


def test_nothing_is_lost_below_leaves():
    for path in Path(SF.__file__).parent.glob("*.py"):
        nodes = list(ast.walk(ast.parse(path.read_text())))
        got = Counter(f[0] for f in SF._facts(path.read_text()))
        assert got["call"] + got["method"] == sum(isinstance(n, ast.Call) and isinstance(n.func, (ast.Name, ast.Attribute)) for n in nodes)
        assert got["construct"] == sum(type(n) in SF.CONSTRUCTS for n in nodes) and got["function"] == sum(isinstance(n, (ast.FunctionDef, ast.AsyncFunctionDef)) for n in nodes)


def test_equal_spans_are_one_island(spark):
    """The SQL of merge_intervals sorts equal spans twice, in orders that may differ."""
    rows = [(1, 5, 9)] * 40 + [(1, 20, 25)] * 40 + [(1, 9, 12)] * 3
    got = EV.merge_intervals(spark.createDataFrame(rows, "doc_id int, start long, stop long")).collect()
    assert sorted(map(tuple, got)) == [(1, 1, 5, 12), (1, 2, 20, 25)]


def test_spans_with_nulls_and_halves_are_as_in_sql(spark, tmp_path):
    """DuckDB sorts nulls last and rounds halves to even."""
    rows = [(1, 5, 2.5), (1, 8, 3.5), (1, 12, None), (1, 12, 1.0), (1, None, 4.0), (1, 20, None), (1, 20, 3.0), (501, None, None), (2, None, 1.0), (2, 7, 0.5), (None, 3, 1.0), (None, 4, 1.5), (-1, 2, 2.0)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    con = duckdb.connect()
    con.sql("SET threads = 1")
    con.sql(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    want = con.sql(f"SELECT doc_id, island, start, stop FROM ({ORACLES['merge_intervals']})").fetchall()
    got = QUERIES["merge_intervals"](spark, str(tmp_path)).select("doc_id", "island", "start", "stop").collect()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) == 9


def test_equal_pieces_are_found_once(spark):
    TD._matches.cache_clear()
    rows = TD._aligned(["the cat sat\n"], ["the big cat\n"])
    assert rows[0]["op"] == "changed" and TD._matches.cache_info().misses == 1 and TD._matches.cache_info().hits == 1
    cases = spark.createDataFrame([("a", "x\n", "y\n"), ("b", "x\n", "x\n")], "case_id string, expected string, actual string").coalesce(1)
    assert TD.diff_lines(cases).rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_checks_are_read_once_for_their_exercises(spark):
    rows = A.checks(spark, DATA).select("check_id", F.col("exercise_id").alias("located_exercise"), F.col("file").alias("located_file"))
    assert plan(SC.exercise_membership(rows, A.exercises(spark))).count("FileScan parquet") == 1


def test_a_large_project_is_many_tasks(spark):
    rows = [(1, i, f"src/m{i}.py", "file", 5) for i in range(50)]
    entries = SN.snapshot_entries(spark.createDataFrame(rows, "project_id int, pos long, raw string, kind string, size long").coalesce(1))
    assert "RLIKE" not in plan(entries)  # paths are looked at once, before this plan
    entries = T.written(entries, "entries")
    projects = SN.snapshot_projects(entries)
    for df in (projects, SN.snapshot_tree(entries, projects)):
        assert re.search(r"Join \[project_id#\d+, block#\d+L\]", plan(df))


def test_merged_exercises_are_matched_once(spark):
    """Their places were worked out anew, by folds over arrays, for each of the joins that ask for them."""
    said = plan(entry.queries()["merged_tests"](spark, DATA))
    assert "untaken" not in said and said.count("lineitem.parquet") <= 20


def test_calls_are_bound_once(spark):
    """Arguments met parameters row by row, and that twice over: for base values and for the calls made already."""
    said = plan(entry.queries()["derived_tests"](spark, DATA))
    assert said.count("lineitem.parquet") == 1 and "bound-calls" in said
    said = plan(entry.queries()["filled_calls"](spark, DATA))
    assert said.count("lineitem.parquet") == 2 and "LeftAnti" not in said
