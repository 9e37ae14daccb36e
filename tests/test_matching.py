"""Near misses and printed texts against comparing all pairs."""

import difflib
import random
import re

from marksheet.operators import similar_names as N
from marksheet.operators import source_map as M
from pyspark.sql import functions as F


def plain_near_miss(name, candidates, cutoff):
    low = {}
    for c in candidates:
        low.setdefault(c.lower(), c)
    if name.lower() in low:
        return low[name.lower()], 1.0
    close = difflib.get_close_matches(name.lower(), list(low), n=1, cutoff=cutoff)
    return (low[close[0]], difflib.SequenceMatcher(None, close[0], name.lower()).ratio()) if close else None


def test_near_misses_are_those_of_all_pairs(spark):
    rng = random.Random(2)
    letters = "abcdeFGH_1é😀"
    word = lambda n: "".join(rng.choice(letters) for _ in range(n))
    groups = {}
    for g in range(12):
        cands = [word(rng.randint(0, 14)) for _ in range(30)] + ["is_safe", "Is_Safe", "is_save", "total_price"]
        rng.shuffle(cands)
        names = ["is_saef", "IS_SAFE", "", "total_prices", "x" * 250] + [("".join(c for c in rng.choice(cands) if rng.random() > 0.15) + rng.choice(["", "a", "x_"])) for _ in range(25)]
        groups[g] = (names, cands)
    asked = spark.createDataFrame([(g, n) for g, (names, _) in groups.items() for n in [*names, names[0]]] + [(0, None)], "group_id int, name string")
    known = spark.createDataFrame([(g, c, i) for g, (_, cands) in groups.items() for i, c in enumerate(cands)] + [(0, None, 99), (0, "is_safe", 100)], "group_id int, candidate string, pos int")
    for cutoff in (0.8, 0.6):
        got = {(r.group_id, r.name): (r.candidate, r.likeness) for r in N.near_misses(asked, known, cutoff).collect()}
        want = {(g, n): m for g, (names, cands) in groups.items() for n in names if (m := plain_near_miss(n, cands, cutoff))}
        assert got == want and len(got) > 100
    every = sum(len(set(names)) * len({c.lower() for c in cands}) for names, cands in groups.values())
    assert N.candidate_pairs(asked, known, 0.8).count() < every / 5
    assert N.near_misses(asked.limit(0), known).count() == N.near_misses(asked, known.limit(0)).count() == 0


def test_similar_files(spark):
    tree = [(1, "src/main.py", "file"), (1, "lib/Main.py", "file"), (1, "src/main.txt", "file"), (1, "mian", "directory"), (1, "Makefle", "file"), (2, "main.py", "file"), (1, "a/utlis.py", "file"), (1, "makefile.bak", "file")]
    req = [(1, "app/mian.py", "file"), (1, "utils.py", "file"), (1, "Makefile", "file"), (1, "main", "directory"), (2, "x/completely_else.py", "file"), (1, "utils.txt", "file")]
    got = N.similar_files(spark.createDataFrame(req, "project_id int, path string, kind string"), spark.createDataFrame(tree, "project_id int, path string, kind string")).collect()
    assert {(r.project_id, r.path): r.similar for r in got} == {(1, "app/mian.py"): "lib/Main.py", (1, "utils.py"): "a/utlis.py", (1, "Makefile"): "Makefle", (1, "main"): "mian"}


def plain_score(text, value, is_template, in_call, line):
    if not value.strip():
        return None
    io, fixed = int(in_call in M.IO_CALLS), value.replace("{}", "")
    if value == text:
        return 5, io, len(value), -line
    if is_template and re.fullmatch(".*".join(map(re.escape, value.split("{}"))), text, re.S):
        return 4, io, len(value), -line
    if text in value:
        return 3, io, -len(value), -line
    if len(fixed.strip()) >= 4 and all(p in text for p in value.split("{}") if p):
        return 2, io, len(fixed), -line
    a, b = text.lower(), fixed.lower()
    common = max((n for i in range(len(b)) for n in range(4, len(b) - i + 1) if b[i : i + n] in a), default=0)
    return (1, io, common, -line) if common >= 4 else None


def test_literals_are_those_of_all_pairs(spark):
    rng = random.Random(9)
    bits = ["Enter ", "a number", ": ", "{}", "Too hot", "!", "x", "(.*)", "\n", " ", "TOTAL", "é", "\\", "total", "ab", "12"]
    say = lambda n: "".join(rng.choice(bits) for _ in range(n))
    texts, literals = [], []
    for m in range(15):
        here = [(m, pos, say(rng.randint(0, 5)), rng.randint(1, 9), rng.choice([None, "print", "input", "f"])) for pos in range(25)]
        literals += [(*x, "{}" in x[2] and rng.random() < 0.8) for x in here]
        for _ in range(40):
            made = rng.choice(here)[2].replace("{}", str(rng.randint(1, 500))) if rng.random() < 0.6 else say(rng.randint(0, 5))
            texts.append((len(texts), m, rng.choice(["", "\n"]) + made + rng.choice(["", "\r\n"])))
    texts += [(9000, 0, None), (9001, 77, "Enter a number"), (9002, 0, " \n")]
    literals += [(0, 99, None, 1, None, False)]
    got = {r.text_id: (r.pos, (r.tier, r.io, r.n, -r.line)) for r in M.locate_texts(spark.createDataFrame(texts, "text_id int, module_id int, text string"), spark.createDataFrame(literals, "module_id int, pos int, value string, line int, in_call string, is_template boolean")).collect()}
    want = {}
    for t, m, text in texts:
        needle = (text or "").strip("\r\n")
        for lm, pos, value, line, call, template in literals:
            if lm == m and needle.strip() and value is not None and (s := plain_score(needle, value, template, call, line)) and (t not in want or s > want[t][1]):
                want[t] = (pos, s)
    assert got == want and {s[0] for _, s in got.values()} == {1, 2, 3, 4, 5} and len(got) > 400


def test_longest_common(spark):
    pairs = [("abcdef", "xxcdeyy"), ("", "a"), ("same", "same"), ("ab", "cd"), ("a" * 300 + "b", "b" + "a" * 200)]
    df = spark.createDataFrame(pairs, "a string, b string")
    assert [r.n for r in df.select(M.longest_common(F.col("a"), F.col("b")).alias("n")).collect()] == [3, 0, 4, 0, 200]
