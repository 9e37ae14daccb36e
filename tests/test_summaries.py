"""Summaries of sections, heaviest entries, functions in another module."""

from marksheet.operators import summaries as S


def test_tone_and_words(spark):
    rows = [("a", "pass", True, False), ("b", "warning", True, False), ("c", "bonus", False, True), ("d", "fail", False, False), ("d", "warning", True, False), ("d", "warning", None, False), ("e", "skipped", True, None), ("f", "fail", True, True)]
    got = {r.k: (r.summary, r.tone) for r in S.section_summaries(spark.createDataFrame(rows, "k string, status string, mandatory boolean, bonus boolean"), ["k"]).collect()}
    assert got == {
        "a": ("1 / 1 passed", "pass"), "b": ("0 / 1 passed · 1 warning", "warning"), "c": ("0 / 1 passed · 1 bonus not done", "bonus"), "d": ("0 / 3 passed · 1 failing · 2 warnings", "warning"),
        "e": ("0 / 1 passed · 1 failing", "fail"), "f": ("0 / 1 passed · 1 failing", "warning"),
    }


def test_heaviest_entries(spark):
    paths = ["b/1", "b/2", "a/x/1", "a/2", "c", "d/1", "d"]
    tree = spark.createDataFrame([(1, p, "file") for p in paths] + [(1, "z", "directory")], "project_id int, path string, kind string")
    assert [(r.name, r.files) for r in S.heaviest_entries(tree).orderBy("place").collect()] == [("a", 2), ("b", 2), ("d", 2)]


def test_defined_elsewhere(spark):
    functions = spark.createDataFrame([(1, "z.py", "f", 3), (1, "y.py", "f", 9), (1, "y.py", "f", 7), (1, "m.py", "g", 1), (1, "y.py", "g", 2), (2, "y.py", "h", 1)], "project_id int, path string, name string, line int")
    wanted = spark.createDataFrame([(1, "m.py", "f"), (1, "m.py", "g"), (1, "m.py", "h")], "project_id int, path string, name string")
    assert [tuple(r) for r in S.defined_elsewhere(wanted, functions).collect()] == [(1, "m.py", "f", "y.py", 7, 1)]
