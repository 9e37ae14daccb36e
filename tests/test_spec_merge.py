"""Merged specs against a loop over the exercises."""

import random

from marksheet.operators import spec_merge as M

EXERCISE = "spec_id int, pos bigint, exercise_id string, file_path string, kind string, side_effects boolean, script struct<prompts: array<string>, required_outputs: array<string>>, constraints string"
FUNCTION = "spec_id int, exercise_pos bigint, pos int, name string, rules array<string>, reference string"
TEST = "spec_id int, exercise_pos bigint, function string, pos int, test_id string, call string"


def as_tables(spark, specs):
    ex, fn, ts = [], [], []
    for s, spec in specs.items():
        for e in spec:
            ex.append((s, e["pos"], e["id"], e["file"], e["kind"], e["effects"], e["script"], e["limits"]))
            for k, f in enumerate(e["functions"]):
                fn.append((s, e["pos"], k, f["name"], f["rules"], f["reference"]))
                ts += [(s, e["pos"], f["name"], n, *t) for n, t in enumerate(f["tests"])]
            ts += [(s, e["pos"], None, n, *t) for n, t in enumerate(e["tests"])]
    return M.Spec(spark.createDataFrame(ex, EXERCISE), spark.createDataFrame(fn, FUNCTION), spark.createDataFrame(ts, TEST))


def made(rng, of_base):
    out = []
    for p in range(rng.choice([0, 1, 2, 4, 7])):
        kind = rng.choice(["file", "functions", "script"])
        names = rng.sample([f"f{k}" for k in range(12)], rng.choice([0, 0, 1, 1, 2, 3]))
        new_id = lambda prefix: f"{prefix}{rng.choice([1, 1, 2, 3, 5, '07', 12])}_{p}" if rng.random() < 0.3 else f"{prefix}{rng.randint(1, 9)}"
        functions = [{"name": n, "rules": rng.choice([[], [], ["r1"], ["r2", "r3"], None]), "reference": rng.choice([None, "x", "y"]), "tests": [(new_id(f"{n}#ex"), rng.choice("abcd")) for _ in range(rng.choice([0, 1, 2, 4]))]} for n in names]
        script = rng.choice([None, None, ([], ["o"]), (["p"], None), (["q"], [])])
        tests = [(new_id(f"e{p}#session"), "s") for _ in range(rng.choice([0, 1, 3]))] if script else []
        eid = f"e{p}" if of_base else rng.choice(["e0", "e1", "e1_2", "e2", "z", "e0_2"])
        out.append({"pos": p, "id": eid, "file": rng.choice(["a", "a", "b", "c", None]), "kind": kind, "effects": kind == "script", "script": script, "limits": rng.choice([None, "abs"]), "functions": functions, "tests": tests})
    return out


def plain_merge(base, other):
    spec = [dict(e, key=(0, e["pos"]), added=False, functions=[dict(f, tests=[(*t, False) for t in f["tests"]], added=False) for f in e["functions"]], tests=[(*t, False) for t in e["tests"]]) for e in base]
    ids = {t[0] for e in spec for t in e["tests"] + [t for f in e["functions"] for t in f["tests"]]}
    taken = []

    def fresh(tests, prefix):
        out = []
        for t in tests:
            n = next(n for n in range(1, 10**6) if f"{prefix}{n}" not in ids)
            ids.add(f"{prefix}{n}")
            out.append((f"{prefix}{n}", t[1], True))
        return out

    for o in other:
        defined = {f["name"] for e in spec for f in e["functions"]}
        names = {f["name"] for f in o["functions"]}
        options = [e for e in spec if o["file"] is not None and e["file"] == o["file"] and e["key"] not in taken]
        into = next((e for e in options if names & {f["name"] for f in e["functions"]}), None)
        if into is None and len(options) == 1 and not names & defined:
            into = options[0]
        if into is None:
            used, eid, n = {e["id"] for e in spec}, o["id"], 2
            while eid in used:
                eid, n = f"{o['id']}_{n}", n + 1
            functions = [dict(f, tests=fresh(f["tests"], f["name"] + "#ex"), added=True) for f in o["functions"] if f["name"] not in defined]
            kind = o["kind"] if o["kind"] != "functions" or functions else "script" if o["script"] else "file"
            spec.append(dict(o, id=eid, key=(1, o["pos"]), added=True, functions=functions, kind=kind, tests=fresh(o["tests"], eid + "#session")))
            continue
        taken.append(into["key"])
        for f in o["functions"]:
            mine = next((g for g in into["functions"] if g["name"] == f["name"]), None)
            if mine:
                mine["rules"] = mine["rules"] or f["rules"]
                mine["reference"] = mine["reference"] if mine["reference"] is not None else f["reference"]
                for t in f["tests"]:
                    if t[1] not in {x[1] for x in mine["tests"]}:
                        mine["tests"] = mine["tests"] + fresh([t], f["name"] + "#ex")
            elif f["name"] not in defined:
                into["functions"].append(dict(f, tests=fresh(f["tests"], f["name"] + "#ex"), added=True))
                if into["kind"] == "file":
                    into["kind"], into["effects"] = "functions", False
        if o["script"]:
            if into["script"] is None:
                into["script"], into["tests"] = o["script"], into["tests"] + fresh(o["tests"], into["id"] + "#session")
                if into["kind"] == "file":
                    into["kind"], into["effects"] = "script", True
            else:
                into["script"] = tuple(a if a else b if b is not None else a for a, b in zip(into["script"], o["script"]))
                into["tests"] = into["tests"] or fresh(o["tests"], into["id"] + "#session")
        into["limits"] = into["limits"] if into["limits"] is not None else o["limits"]
    return spec


def test_merge(spark):
    rng = random.Random(3)
    base, other = ({s: made(rng, side) for s in range(150)} for side in (True, False))
    got = M.merge_specs(as_tables(spark, base), as_tables(spark, other))
    script = lambda s: None if s is None else tuple(None if x is None else list(x) for x in s)
    exercises, functions, tests = set(), [], []
    for s in base:
        for e in plain_merge(base[s], other[s]):
            key = (s, *e["key"])
            exercises.add((key, e["id"], e["file"], e["kind"], e["effects"], repr(script(e["script"])), e["limits"], e["added"]))
            functions += [(key, k + 1, f["name"], f["rules"] or [], f["reference"], f["added"]) for k, f in enumerate(e["functions"])]
            tests += [(key, f["name"], k + 1, *t) for f in e["functions"] for k, t in enumerate(f["tests"])] + [(key, "", k + 1, *t) for k, t in enumerate(e["tests"])]
    assert {((r.spec_id, r.side, r.pos), r.exercise_id, r.file_path, r.kind, r.side_effects, repr(script(r.script)), r.constraints, r.added) for r in got.exercises.collect()} == exercises
    by_place = lambda f: f[:2]
    assert sorted((((r.spec_id, r.side, r.exercise_pos), r.pos, r.name, r.rules or [], r.reference, r.added) for r in got.functions.collect()), key=by_place) == sorted(functions, key=by_place)
    assert sorted(((r.spec_id, r.side, r.exercise_pos), r.function or "", r.pos, r.test_id, r.call, r.added) for r in got.tests.collect()) == sorted(tests)
    assert sum(e[7] for e in exercises) > 50 and sum(t[5] for t in tests) > 200


def test_an_added_exercise_may_be_taken_once(spark):
    ex = lambda *rows: spark.createDataFrame([(1, p, f"e{p}", "a.py", "functions", False, None, None) for p in rows], EXERCISE)
    fn = lambda *rows: spark.createDataFrame([(1, p, 0, n, None, None) for p, n in rows], FUNCTION)
    none = spark.createDataFrame([], TEST)
    goes = M.match_exercises(M.Spec(ex(), fn(), none), M.Spec(ex(0, 1, 2), fn((0, "f"), (1, "f"), (2, "f")), none))
    assert sorted((r.exercise_pos, r.side, r.pos) for r in goes.collect()) == [(0, 1, 0), (1, 1, 0), (2, 1, 2)]


def test_files_and_globals(spark):
    files = lambda *rows: spark.createDataFrame([(1, k, p) for k, p in enumerate(rows)], "spec_id int, pos int, path string")
    got = M.merged_files(files("a", "b"), files("c", "a", "c")).collect()
    assert sorted((r.path, r.pos, r.added) for r in got) == [("a", 0, False), ("b", 1, False), ("c", 0, True)]
    schema = "spec_id int, allowed_builtins array<string>, allowed_imports array<string>, forbidden_builtins array<string>, forbidden_imports array<string>, forbidden_methods array<string>"
    a = spark.createDataFrame([(1, [], None, ["x", "y"], None, [])], schema)
    b = spark.createDataFrame([(1, ["len"], ["os"], ["z", "x"], ["re"], None), (2, None, None, ["q"], None, None)], schema)
    assert sorted(tuple(r) for r in M.merged_globals(a, b).collect()) == [(1, [], ["os"], ["x", "y", "z"], ["re"], []), (2, None, None, ["q"], [], [])]


def test_one_side_empty(spark):
    rng = random.Random(4)
    specs = {s: made(rng, True) for s in range(20)}
    some, none = as_tables(spark, specs), as_tables(spark, {})
    assert [t.count() for t in M.merge_specs(some, none)] == [t.count() for t in some]
    assert [t.count() for t in M.merge_specs(none, none)] == [0, 0, 0]
    got = {(r.spec_id, r.pos) for r in M.merge_specs(none, some).exercises.collect()}
    assert got == {(s, e["pos"]) for s in specs for e in plain_merge([], specs[s])} and got
