"""Every query with SQL gives what DuckDB gives; operators against small cases and plain loops."""

import datetime
import random
from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

from marksheet.functions import scores as S
from marksheet.functions import text as X
from marksheet.operators import events as EV
from marksheet.operators import history as H
from marksheet.operators import scoring as SC
from marksheet.operators import structure as ST
from marksheet.plans import adapters as A
from marksheet.plans.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents conversations".split()


def plain(v):
    if v is None or v != v:
        return None
    if isinstance(v, bool) or isinstance(v, (str, datetime.datetime)):
        return str(v)
    return round(float(v), 6)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_what_sql_gives(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    got = QUERIES[name](spark, SF)
    rel = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(rel.columns)
    order = sorted(got.columns)
    a = Counter(tuple(plain(r[c]) for c in order) for r in got.collect())
    b = Counter(tuple(plain(v) for v in row) for row in con.sql(f"SELECT {', '.join(chr(34) + c + chr(34) for c in order)} FROM ({ORACLES[name]})").fetchall())
    assert a == b and a


@pytest.mark.parametrize(("passed", "total", "want"), [(2, 3, 66.7), (1, 3, 33.3), (1999, 2000, 99.9), (0, 3, 0.0), (0, 0, None), (5, 5, 100.0)])
def test_percent(spark, passed, total, want):
    assert spark.range(1).select(S.percent(F.lit(passed), F.lit(total))).first()[0] == want


def test_dedupe_takes_the_worst_then_the_last(spark):
    rows = [(1, "a", "pass", 1), (1, "a", "fail", 2), (1, "a", "fail", 3), (1, "b", "info", 4), (1, "b", "pass", 5)]
    got = SC.dedupe_checks(spark.createDataFrame(rows, "run_id int, check_id string, status string, emit_seq int")).collect()
    assert sorted((r.check_id, r.status, r.emit_seq, r.position) for r in got) == [("a", "fail", 3, 1), ("b", "info", 4, 4)]


def test_changes_may_be_in_two_lists(spark):
    base = spark.createDataFrame([(1, "a", "fail"), (1, "b", "pass"), (1, "c", "skipped")], "pair_id int, check_id string, status string")
    head = spark.createDataFrame([(1, "a", "pass"), (1, "c", "fail"), (1, "d", "fail")], "pair_id int, check_id string, status string")
    got = sorted((r.check_id, r.change) for r in H.compare_runs(base, head).collect())
    assert got == [("a", "fixed"), ("b", "removed_checks"), ("c", "still_failing"), ("d", "new_checks"), ("d", "new_failures")]


REQUIREMENT = "project_id int, pos int, path string, kind string, required boolean, bonus boolean"
TREE = "project_id int, path string, kind string"


def test_requirements_are_claimed_once(spark):
    req = [(1, 0, "src/a.py", "file", True, False), (1, 1, "src/b.py", "file", True, False), (1, 2, "lib/b.py", "file", True, False), (1, 3, "x/c.py", "file", True, True), (1, 4, "d.py", "file", False, False), (1, 5, "docs", "directory", True, False)]
    tree = [(1, "src/a.py", "file"), (1, "SRC/B.py", "file"), (1, "y/b.py", "file"), (1, "q/C.py", "file"), (1, "env/d.py", "file"), (1, "old/Docs", "directory"), (1, "docs", "file")]
    got = {r.path: (r.found, r.how, r.status) for r in ST.match_requirements(spark.createDataFrame(req, REQUIREMENT), spark.createDataFrame(tree, TREE)).collect()}
    assert got == {"src/a.py": ("src/a.py", "exact", "pass"), "src/b.py": ("SRC/B.py", "case", "fail"), "lib/b.py": ("y/b.py", "misplaced", "fail"), "x/c.py": ("q/C.py", "misplaced", "bonus"), "d.py": (None, "missing", "warning"), "docs": ("old/Docs", "misplaced", "fail")}


def plain_claims(req, tree, root, forbidden):
    """The three passes as loops."""
    kinds = {p: k for _, p, k in tree}
    found = {r[1]: (r[2], "exact") for r in req if kinds.get(r[2]) == r[3]}
    claimed = {f for f, _ in found.values()}
    for _, pos, path, kind, *_ in req:
        same = sorted(p for p in kinds if p.lower() == path.lower())
        if pos not in found and same and same[0] not in claimed and kinds[same[0]] == kind:
            found[pos] = (same[0], "case")
            claimed.add(same[0])
    for _, pos, path, kind, *_ in req:
        if pos in found:
            continue
        *folders, name = path.split("/")
        options = []
        for p, k in kinds.items():
            *above, other = p.split("/")
            if k == kind and p not in claimed and other.lower() == name.lower() and not set(above) & {*ST.IGNORED_FOLDERS, *forbidden}:
                common = next((i for i, (x, y) in enumerate(zip(above, folders)) if x != y), min(len(above), len(folders)))
                options.append(((other != name, not (not root or p == root or p.startswith(root + "/")), -common, len(above), p), p))
        if options:
            found[pos] = (min(options)[1], "misplaced")
            claimed.add(found[pos][0])
    return {r[1]: found.get(r[1], (None, "missing")) for r in req}


def test_requirements_against_loops(spark):
    rng = random.Random(11)
    name = lambda: "/".join([*rng.choices(["src", "SRC", "lib", "build", ".git", "deep"], k=rng.randint(0, 3)), rng.choice(["a.py", "A.py", "b.py", "B.py", "c.txt"])])
    req, tree, want = [], [], {}
    for project in range(25):
        own_req = [(project, i, p, "file", True, False) for i, p in enumerate(dict.fromkeys(name() for _ in range(6)))]
        own_tree = [(project, p, "file") for p in {name() for _ in range(10)}]
        want |= {(project, pos): f for pos, f in plain_claims(own_req, own_tree, "src", ["build"]).items()}
        req, tree = req + own_req, tree + own_tree
    got = ST.match_requirements(spark.createDataFrame(req, REQUIREMENT), spark.createDataFrame(tree, TREE), "src", ["build/"]).collect()
    assert {(r.project_id, r.pos): (r.found, r.how) for r in got} == want


def test_unwanted_keeps_the_outermost(spark):
    tree = spark.createDataFrame([(1, "build", "directory"), (1, "build/a.tmp", "file"), (1, "src/b.tmp", "file"), (1, "src", "directory"), (1, "src/k.py", "file")], TREE)
    assert sorted((r.path, r.pattern) for r in ST.unwanted(tree, ["*.tmp", "build/"]).collect()) == [("build", "build/"), ("src/b.tmp", "*.tmp")]


@pytest.mark.parametrize(("pattern", "path", "hit"), [
    ("*.pyc", "a/b/x.pyc", True), ("*.pyc", "x.PYC", False), ("a/*.py", "a/b/c.py", True), ("/a/x", "a/x", True), ("a/x", "b/a/x", False), ("**/x", "b/a/x", True), ("[ab].py", "q/b.py", True),
    ("[!ab].py", "b.py", False), ("[!ab].py", "c.py", True), ("[^a].py", "^.py", True), ("[]x].py", "].py", True), ("a?b", "d/a.b", True), ("a.b", "aXb", False), (".DS_Store", "x/.DS_Store", True), ("x+y", "x+y", True),
])
def test_patterns(spark, pattern, path, hit):
    assert spark.range(1).select(F.lit(path).rlike(X.glob_regex(pattern))).first()[0] is hit


def test_no_patterns():
    assert [X.glob_regex(p) for p in ("", "  ", "# x", "!keep")] == [None] * 4


def test_git_status(spark):
    raw = "1 .M N... 100644 100644 100644 a b src/a b.py\0002 R. N... 100644 100644 100644 a b R100 new.py\0old.py\0? junk.txt\0! x.pyc\0"
    got = sorted((r.path, r.state) for r in ST.parse_git_status(spark.createDataFrame([(1, raw)], "project_id int, raw string")).collect())
    assert got == [("junk.txt", "untracked"), ("new.py", "staged"), ("src/a b.py", "modified"), ("x.pyc", "ignored")]


def test_git_records_like_renames(spark):
    raw = "# branch.oid (initial)\0# branch.head main\0002 R. N... 1 1 1 a b R100 new\0002 R. like a rename\0002 .M N... 1 1 1 a b R90 x\nz\0y\0001 M. N... 1 1 1 a b c.py\0u UU N... 1 1 1 1 a b c both.py\0"
    df = spark.createDataFrame([(1, raw), (2, ""), (3, "# branch.oid abc\0# branch.head (detached)\0")], "project_id int, raw string")
    got = sorted((r.project_id, r.path, r.state) for r in ST.parse_git_status(df).collect())
    assert got == [(1, "both.py", "modified"), (1, "both.py", "staged"), (1, "c.py", "staged"), (1, "new", "staged"), (1, "x\nz", "modified")]
    assert sorted((r.project_id, r.oid, r.head) for r in ST.git_heads(df).collect()) == [(1, None, "main"), (2, None, None), (3, "abc", None)]


def test_sources_of_lines_stop_where_the_stream_does(spark):
    events = spark.createDataFrame([(1, 1, "output", "Name:"), (1, 2, "input", "Bo"), (1, 3, "output", ""), (1, 4, "output", "Hi Bo\nBye"), (1, 5, "output", "\nend"), (1, 6, "output", "cut off"), (1, 7, "output", "late")], "job_id int, seq long, kind string, text string")
    outputs = spark.createDataFrame([(1, "Name:Hi Bo\nBye\nend...late")], "job_id int, stdout string")
    got = {r.seq: (r.start_off, r.end_off) for r in EV.consistent_offsets(events, outputs).collect()}
    assert got == {1: (0, 5), 4: (5, 14), 5: (14, 18)}
    gap, swap = [("equal", "Name:", "Name:"), ("delete", " ", ""), ("equal", "Hi Bo", "Hi Bo")], [("equal", "Name:", "Name:"), ("replace", "Ho", "Hi Bo")]
    rows = [(1, "changed", 1, "Name:Hi Bo", gap), (1, "changed", 1, "Name:Hi Bo", swap), (1, "equal", 2, "Bye", None), (1, "changed", 3, "end...late", [("equal", "end", "end"), ("insert", "", "...late")]), (1, "missing", None, None, None), (1, "changed", 9, "x", None)]
    lines = spark.createDataFrame(rows, "job_id int, op string, actual_lineno int, actual string, segments array<struct<op: string, expected: string, actual: string>>")
    got = [(r.actual_lineno, r.segments and len(r.segments), r.event_seq) for r in EV.line_sources(lines, events, outputs).collect()]
    assert sorted(got, key=str) == sorted([(1, 3, 1), (1, 2, 4), (2, None, 4), (3, 2, 5), (None, None, None), (9, None, None)], key=str)


@pytest.mark.parametrize(("ka", "a", "kb", "b", "want"), [("int", 1.0, "int", 1.0, "equal"), ("bool", 1.0, "int", 1.0, "different"), ("float", 1.0, "int", 1.0, "int_for_float"), ("float", 1.0, "float", 1.0 + 1e-10, "close"), ("float", float("nan"), "float", float("nan"), "different")])
def test_typed_values(spark, ka, a, kb, b, want):
    assert spark.range(1).select(X.values_match(F.lit(ka), F.lit(a), F.lit(kb), F.lit(b))).first()[0] == want


@pytest.mark.parametrize(("a", "b", "prefix"), [("x\n", "x", 1), ("Ab", "ab", 0), ("hello", "helo", 3), ("abcdef", "uvwxyz", 0), ("", "", 0), ("🟢a", "🟢b", 1)])
def test_common_prefix(spark, a, b, prefix):
    assert spark.range(1).select(X.common_prefix(F.lit(a), F.lit(b))).first()[0] == prefix


def test_fixed_needs_a_pass_after_anything_that_can_be_fixed(spark):
    pairs = [("fail", "warning"), ("warning", "pass"), ("skipped", "pass"), ("info", "pass"), ("fail", "skipped"), ("warning", "fail"), (None, "pass"), (None, "skipped"), ("bonus", "fail"), ("fail", None)]
    base = spark.createDataFrame([(1, str(i), b) for i, (b, _) in enumerate(pairs) if b], "pair_id int, check_id string, status string")
    head = spark.createDataFrame([(1, str(i), h) for i, (_, h) in enumerate(pairs) if h], "pair_id int, check_id string, status string")
    got = {}
    for r in H.compare_runs(base, head).collect():
        got.setdefault(int(r.check_id), set()).add(r.change)
    assert got == {1: {"fixed"}, 2: {"fixed"}, 4: {"still_failing"}, 5: {"new_failures"}, 6: {"new_checks"}, 7: {"new_checks", "new_failures"}, 8: {"new_failures"}, 9: {"removed_checks"}}


CHECK = "run_id int, check_id string, status string, severity string, category string, mandatory boolean, bonus boolean, exercise_id string, function string, file string, diagnosis string, test_id string, emit_seq int"
EXERCISE = "subject_id string, pos int, exercise_id string, file string, required boolean, bonus boolean, functions array<string>"


def check(spark, rows):
    """rows of (check_id, status, category) with what differs from a plain mandatory check."""
    base = {"run_id": 1, "severity": "major", "mandatory": True, "bonus": False, "exercise_id": None, "function": None, "file": None, "diagnosis": None, "test_id": None}
    return spark.createDataFrame([base | {"check_id": i, "status": st, "category": c, "emit_seq": k} | more for k, (i, st, c, more) in enumerate(rows)], CHECK)


def test_states_of_exercises(spark):
    ex = spark.createDataFrame([("s", k, f"e{k}", f"f{k}.py", k < 5, k in (5, 6), ["u", "v"] if k in (5, 6) else []) for k in range(9)], EXERCISE)
    ex = ex.withColumn("required", F.col("pos") < 5)
    rows = [
        ("a", "pass", "functions", {"exercise_id": "e0"}), ("b", "warning", "explicit_tests", {"exercise_id": "e1"}), ("c", "fail", "functions", {"exercise_id": "e2"}), ("d", "pass", "output", {"exercise_id": "e2"}), ("e", "fail", "functions", {"exercise_id": "e3"}), ("f", "pass", "syntax", {"exercise_id": "e3"}),
        ("structure:file:f4.py", "fail", "structure", {"diagnosis": "missing_file", "file": "elsewhere/f4.py"}), ("g", "bonus", "functions", {"exercise_id": "e5", "function": "u", "diagnosis": "bonus_not_implemented", "mandatory": False, "bonus": True}), ("h", "bonus", "functions", {"exercise_id": "e5", "function": "v", "diagnosis": "missing_function", "mandatory": False, "bonus": True}),
        ("i", "bonus", "functions", {"exercise_id": "e6", "function": "u", "diagnosis": "missing_function", "mandatory": False, "bonus": True}), ("j", "pass", "functions", {"exercise_id": "e7", "mandatory": False}), ("k", "pass", "heuristic_tests", {"exercise_id": "e8", "mandatory": False}), ("syntax:f0.py", "fail", "syntax", {"file": None}),
    ]
    runs = spark.createDataFrame([(1, "s"), (2, "s")], "run_id int, subject_id string")
    located = SC.locate_checks(check(spark, rows), ex.select(F.col("file").alias("path")), ex)
    got = {(r.run_id, r.exercise_id): (r.state, r.passed, r.total) for r in SC.exercise_scores(located, ex, runs).collect()}
    one = {e: v for (run, e), v in got.items() if run == 1}
    assert one == {"e0": ("fail", 1, 2), "e1": ("warning", 1, 1), "e2": ("partial", 1, 2), "e3": ("fail", 1, 2), "e4": ("missing", 0, 1), "e5": ("not_implemented", 0, 2), "e6": ("fail", 0, 1), "e7": ("pass", 1, 1), "e8": ("warning", 0, 0)}
    assert all(v == ("warning", 0, 0) for (run, _), v in got.items() if run == 2)
    files = SC.file_scores(located, ex.select("subject_id", F.col("file").alias("path"), F.lit("file").alias("kind"), "required", "bonus"), ex, runs).where("run_id = 1").collect()
    assert {r.file: (r.present, r.exercise_ids, r.issues) for r in files}["f4.py"] == (False, "e4", 1)


def test_nothing_mandatory_is_not_ready(spark):
    r = SC.readiness(check(spark, [("a", "info", "git", {"mandatory": False})])).first()
    assert (r.readiness, r.verdict, r.total) == (0.0, "not_ready", 0)
    r = SC.readiness(check(spark, [("a", "fail", "git", {"severity": "critical"}), ("b", "pass", "git", {})])).first()
    assert (r.readiness, r.verdict, r.message) == (50.0, "not_ready", "1 mandatory failure(s) remain. Fix critical issues first.")


def test_confidence_names_functions_without_any_check(spark):
    fn = spark.createDataFrame([("s", "e0", "f", True, False, 0), ("s", "e0", "g", True, False, 1), ("s", "e1", "h", True, True, 2), ("s", "e2", "k", False, False, 3)], "subject_id string, exercise_id string, function string, required boolean, bonus boolean, pos int")
    runs = spark.createDataFrame([(1, "s", False, 2, 1, "local"), (2, "s", True, 2, 0, "docker")], "run_id int, subject_id string, reviewed boolean, ai_items int, notes int, sandbox_mode string")
    rows = [("test:f#ex1", "pass", "explicit_tests", {"exercise_id": "e0"}), ("test:f#ex2", "pass", "derived_tests", {}), ("x", "warning", "heuristic_tests", {"mandatory": False})]
    got = {r.run_id: (r.level, r.reasons.split("\n")) for r in SC.confidence(check(spark, rows), fn, runs).collect()}
    assert got[1][0] == "medium" and [x.split(" ")[0] for x in got[1][1]] == ["2", "1", "1", "The", "Developer"] and got[1][1][1].endswith(": g.")
    assert got[2][0] == "low" and [x[:2] for x in got[2][1]] == ["No", "No", "2 "]


def test_previous_analysis_has_a_smaller_number(spark):
    at = datetime.datetime(2024, 1, 1)
    df = spark.createDataFrame([(1, 1, at), (2, 2, at), (3, 2, at.replace(hour=3)), (4, 5, at)], "id int, number int, created_at timestamp").withColumn("subject_id", F.lit("s")).withColumn("project_id", F.lit("p"))
    assert {r.id: r.previous_id for r in H.previous_analysis(df).collect()} == {1: None, 2: 1, 3: 1, 4: 3}


def test_history_filters(spark):
    rows = A.analyses(spark, SF)
    got = H.list_analyses(rows, subject_id="s7", limit=5).collect()
    assert len(got) == 5 and {r.subject_id for r in got} == {"s7"} and H.list_analyses(rows, limit=0).count() == 1


def test_order_of_rows_does_not_matter(spark):
    rows = QUERIES["dedupe_checks"](spark, SF)
    again = QUERIES["dedupe_checks"](spark, SF).repartition(7)
    assert rows.exceptAll(again).count() == 0


def test_protected_analyses_are_ranked_and_spared(spark):
    rows = A.analyses(spark, "/root/testdata/sf0.001").select("id", "subject_id", "project_id", "number").collect()
    groups = {}
    for r in rows:
        groups.setdefault((r.subject_id, r.project_id), []).append((r.number, r.id))
    want = {i for g in groups.values() for _, i in sorted(g, reverse=True)[3:] if i % 10}
    got = {r.id for r in QUERIES["retention_protected"](spark, "/root/testdata/sf0.001").collect()}
    assert got == want and not any(i % 10 == 0 for i in got)
    rows = [(i, "s", "p", i) for i in (10, 9, 8, 7, 6, 20, 5)]
    df = spark.createDataFrame(rows, "id long, subject_id string, project_id string, number long")
    assert {r.id for r in H.keep_newest(df, ["subject_id", "project_id"], "number", 3, df.where("id % 10 = 0")).collect()} == {8, 7, 6, 5}


def test_history_lists_every_subject(spark):
    subjects = Counter(r.subject_id for r in A.analyses(spark, "/root/testdata/sf0.001").collect())
    got = Counter(r.subject_id for r in QUERIES["history_of_subjects"](spark, "/root/testdata/sf0.001").collect())
    assert got == {s: min(n, 50) for s, n in subjects.items()}
