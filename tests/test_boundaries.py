"""Cases, outcomes and derived tests against Python's own comparisons."""

import math
import operator
import random

from marksheet.operators import boundaries as B

OPS = {"<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge, "==": operator.eq, "!=": operator.ne}
SIMPLE = {bool: "bool", int: "int", float: "float", str: "str"}
NOTHING = object()


def packed(v):
    if v is NOTHING:
        return None
    return ("str", None, v) if isinstance(v, str) else (SIMPLE[type(v)], float(v), None)


def unpacked(v):
    if v is None:
        return NOTHING
    return v.text if v.kind == "str" else {"int": int, "float": float, "bool": bool}[v.kind](v.num)


def key(args):
    return tuple(("num", float(a)) if type(a) in (int, float) else (type(a).__name__, a) for a in args)


def made(rng):
    some = lambda: rng.choice([0, 1, 3, 5, 4, 2.0, 2.5, -1, "a", True])
    params = [(n, rng.choice(["int", "int", "int", "float", "float", "str", "bool", "other", None, None, None]), rng.choice([NOTHING, NOTHING, NOTHING, 3, 2.5, "b"])) for n in "xyz"[: rng.choice([0, 1, 1, 2, 2, 2, 3])]]
    calls = [(rng.choice(["explicit", "user", "derived"]), {n: some() for n in "xyzw" if rng.random() < (0.05 if n == "w" else 0.85) and (n == "w" or n in [p[0] for p in params])}) for _ in range(rng.choice([0, 0, 1, 3, 6]))]
    side = lambda: ("param", rng.choice("xxxxyyz")) if rng.random() < 0.55 else ("value", rng.choice([0, 2, 5, 7, 2.0, 2.5, 4.75, "a", True, NOTHING]))
    rules = [{"by": rng.choice(["explicit", "user", "ai_extracted", "derived"]), "raises": rng.choice([None, None, None, "ValueError"]), "returns": rng.choice([NOTHING, 1, 2.5, "low", False]), "param": rng.choice([None, None, None, "x"]), "when": [(side(), rng.choice(list(OPS)), side()) for _ in range(rng.choice([0, 1, 1, 2, 2, 3]))]} for _ in range(rng.choice([0, 1, 2, 4]))]
    return {"params": params, "calls": calls, "rules": rules, "by": rng.choice(["explicit", "derived"]), "must": rng.random() < 0.85, "reference": rng.choice([NOTHING, 7, "ref"])}


def bound(f, args):
    if set(args) - {p[0] for p in f["params"]}:
        return None
    out = [args.get(n, d) for n, _, d in f["params"]]
    return None if any(v is NOTHING for v in out) else out


def outcome(f, rules, reference, args):
    env = {p[0]: a for p, a in zip(f["params"], args)}
    for k, r in rules:
        holds = True
        for (lk, lv), op, (rk, rv) in r["when"]:
            a, b = (env.get(lv, NOTHING) if lk == "param" else lv), (env.get(rv, NOTHING) if rk == "param" else rv)
            if a is NOTHING or b is NOTHING:
                return ("error",)
            try:
                holds = OPS[op](a, b)
            except TypeError:
                return ("error",)
            if not holds:
                break
        if holds:
            if r["raises"]:
                return ("raises", r["raises"], k)
            v = env.get(r["param"], NOTHING) if r["param"] else r["returns"]
            return ("value", v, k) if v is not NOTHING else ("error",) if r["param"] else ("unknown", None, k)
    return ("value", reference, None) if reference is not NOTHING else ("unknown", None, None)


def around(const, kind, op):
    if isinstance(const, str):
        return [const] if kind in (None, "str") and op in ("==", "!=") else []
    if isinstance(const, bool) or const is NOTHING or kind not in (None, "int", "float"):
        return []
    if kind == "float" or (kind is None and isinstance(const, float)):
        return [float(const), const + 0.5, const - 0.5]
    lo = math.floor(const)
    return [lo, lo + 1] if lo != const else [lo - 1, lo, lo + 1]


def beside(pivot, kind):
    if type(pivot) not in (int, float) or kind not in (None, "int", "float"):
        return []
    if kind == "float" or (kind is None and isinstance(pivot, float)):
        return [float(pivot), pivot + 0.5, pivot - 0.5]
    return [int(pivot), int(pivot) + 1, int(pivot) - 1] if pivot == int(pivot) else []


def plain_cases(f, rules):
    names = [p[0] for p in f["params"]]
    tests = sorted(enumerate(f["calls"]), key=lambda t: (t[1][0] == "derived", t[0]))
    base = next((b for _, (_, a) in tests if (b := bound(f, a)) is not None), None)
    if base is None:
        base = [d if d is not NOTHING else {"int": 1, "float": 1.0, "str": "a", "bool": True}.get(a or "int", NOTHING) for _, a, d in f["params"]]
    kinds = {n: a or SIMPLE.get(type(v)) for (n, a, _), v in zip(f["params"], base)}
    value, seen = dict(zip(names, base)), set()
    for k, r in rules:
        for c, ((lk, lv), op, (rk, rv)) in enumerate(r["when"]):
            left, right = (lv if lk == "param" and lv in names else None), (rv if rk == "param" and rv in names else None)
            if left and right:
                points = beside(value[right], kinds[left]) if left != right else []
            elif left:
                points = around(rv if rk == "value" else NOTHING, kinds[left], op)
            else:
                points = around(lv if lk == "value" else NOTHING, kinds[right], op) if right else []
            for m, p in enumerate(points):
                args = [p if n == (left or right) else value[n] for n in names]
                if NOTHING not in args and key(args) not in seen:
                    seen.add(key(args))
                    yield k, c, m, args


def test_derived(spark):
    rng = random.Random(6)
    made_ones = {i: made(rng) for i in range(1500)}
    v = B.VALUE
    table = lambda rows, schema: spark.createDataFrame(rows, schema)
    functions = table([(i, i % 4, f"f{i}", f["by"], f["must"], packed(f["reference"])) for i, f in made_ones.items()], f"function_id int, spec_id int, name string, provenance string, must_return boolean, reference {v}")
    params = table([(i, k, n, a, packed(d)) for i, f in made_ones.items() for k, (n, a, d) in enumerate(f["params"])], f"function_id int, pos int, name string, annotation string, default {v}")
    calls = table([(i, k, c[0]) for i, f in made_ones.items() for k, c in enumerate(f["calls"])], "function_id int, pos int, provenance string")
    args = table([(i, k, n, packed(x)) for i, f in made_ones.items() for k, c in enumerate(f["calls"]) for n, x in c[1].items()], f"function_id int, call_pos int, name string, value {v}")
    rules = table([(i, k, r["by"], r["raises"], packed(r["returns"]), r["param"]) for i, f in made_ones.items() for k, r in enumerate(f["rules"])], f"function_id int, rule_pos int, provenance string, raises string, returns {v}, returns_param string")
    sides = lambda s: (s[1], None) if s[0] == "param" else (None, packed(s[1]))
    comparisons = table([(i, k, c, *sides(l), op, *sides(r)) for i, f in made_ones.items() for k, q in enumerate(f["rules"]) for c, (l, op, r) in enumerate(q["when"])], f"function_id int, rule_pos int, pos int, left_param string, left_value {v}, op string, right_param string, right_value {v}")
    used = table([(i % 4, f"f{i}#derived{n}") for i in range(0, 1500, 3) for n in (1, 3)], "spec_id int, test_id string")
    want, filled, kinds = {}, {}, set()
    for i, f in made_ones.items():
        sure = [(k, r) for k, r in enumerate(f["rules"]) if r["by"] != "derived"]
        reference = f["reference"] if f["by"] == "explicit" else NOTHING
        given = {k: b for k, (_, a) in enumerate(f["calls"]) if (b := bound(f, a)) is not None}
        for k, b in given.items():
            o = outcome(f, sure, reference, b)
            kinds.add(o[0])
            if f["must"] and o[0] in ("value", "raises"):
                filled[i, k] = (o[1] if o[0] == "value" else NOTHING, o[1] if o[0] == "raises" else None)
        taken, n = {key(b) for b in given.values()}, 0
        for k, c, m, a in plain_cases(f, sure) if f["must"] else []:
            o = outcome(f, sure, reference, a)
            if key(a) in taken or o[0] not in ("value", "raises"):
                continue
            n += 1
            while i % 3 == 0 and n in (1, 3):
                n += 1
            ai = "ai_extracted" in (f["rules"][k]["by"], f["rules"][o[2]]["by"] if o[2] is not None else None)
            want[i, f"f{i}#derived{n}"] = (k, c, m, [(type(x), x) for x in a], o[1] if o[0] == "value" else NOTHING, o[1] if o[0] == "raises" else None, 0.6 if ai else 0.9)
    typed = lambda x: (type(x), x)
    got = {(r.function_id, r.pos): (typed(unpacked(r.expected)), r.exception) for r in B.filled_calls(functions, params, calls, args, rules, comparisons).collect()}
    assert got == {k: (typed(a), b) for k, (a, b) in filled.items()} and kinds == {"value", "raises", "unknown", "error"}
    rows = B.derived_tests(functions, params, calls, args, rules, comparisons, used).collect()
    got = {(r.function_id, r.test_id): (r.rule_pos, r.pos, r.point, [typed(unpacked(a.value)) for a in r.assignment], typed(unpacked(r.expected)), r.exception, r.confidence) for r in rows}
    assert len(rows) == len(got) and got == {k: (*w[:4], typed(w[4]), *w[5:]) for k, w in want.items()} and len(want) > 300
