"""Root detection against loops over all folders and prefixes, on trees of every kind of layout."""

import random

import pytest
from marksheet.operators import roots as R


def plain_detect(tree, expected):
    kinds = dict(tree)
    kinds[""] = "directory"
    children = {}
    for p in tree:
        parent, _, name = p[0].rpartition("/")
        children.setdefault(parent, {})[name] = p[1]
    expected = sorted({p: min(k for q, k in expected if q == p) for p, _ in expected}.items())
    cands, level = [""], [""]
    for _ in range(R.MAX_DEPTH):
        level = [f"{p}/{n}" if p else n for p in level for n in sorted(children.get(p, {})) if children[p][n] == "directory" and n not in R.NOT_ROOTS]
        cands += level
    git = [c for c in cands if children.get(c, {}).get(".git") == "directory"]
    prefixes = [""] + sorted({"/".join(p.split("/")[:i]) + "/" for p, _ in expected for i in range(1, p.count("/") + 1)})
    at = lambda root, rest: "/".join(x for x in (root, rest) if x)
    opts = []
    for c in cands:
        for prefix in [""] if c in git else prefixes:
            n = 0
            for p, k in expected:
                under = not prefix or p.startswith(prefix) or p + "/" == prefix
                if not under and kinds.get(at(c, p)) == k:
                    n = None
                    break
                n += under and kinds.get(at(c, "" if p + "/" == prefix else p[len(prefix) :])) == k
            if n is not None:
                opts.append((c, prefix, n))
    rank = lambda o: (-o[2], len(o[1]), o[0].count("/") + 1 if o[0] else 0, o[0])
    best = min(opts, key=rank)
    chosen, note = best, None
    if git:
        best_git = min((o for o in opts if o[0] in git), key=rank)
        around = [g for g in git if not g or best[0] == g or best[0].startswith(g + "/")]
        if best_git[2]:
            chosen = best_git
        elif around and best[2]:
            chosen = (max(around, key=len), "", 0)
            note = f"The git repository root is '{chosen[0] or '.'}', but the expected files were found under '{best[0] or '.'}/{best[1]}': paths are checked from the repository root."
        elif not best[2]:
            chosen = (min(git, key=lambda g: (g.count("/"), len(g))), "", 0)
    elif not chosen[2]:
        top = {n: k for n, k in children.get("", {}).items() if n not in R.BESIDE_TOP}
        if len(top) == 1 and (name := next(iter(top))) != ".git" and top[name] == "directory":
            chosen = (name, "", 0)
    ties = [o for o in opts if o[2] == chosen[2] and o[1] == chosen[1] and o[0] != chosen[0]]
    if note is None:
        root, prefix, n = chosen
        parts = []
        if expected and not n:
            parts.append("None of the expected files were found at their expected paths.")
        elif prefix:
            parts.append(f"The analyzed folder looks like '{prefix}' of your repository, not its root: files are checked relative to it ({n}/{len(expected)} expected paths found).")
        elif root:
            parts.append(f"Using '{root}/' as the repository root ({n}/{len(expected)} expected paths found there).")
        elif expected and 2 * n < len(expected):
            parts.append(f"Only {n}/{len(expected)} expected paths were found at the repository root.")
        if ties and n:
            parts.append("Other folders match equally well (" + ", ".join(f"'{t[0] or '.'}/'" for t in ties[:3]) + ").")
        note = " ".join(parts) or None
    sure = chosen[2] > 0 and not chosen[1] and 2 * chosen[2] >= len(expected) and not ties and (not git or chosen[0] in git)
    return (*chosen, len(expected), note, sure)


def with_parents(files):
    out = dict(files)
    for p in files:
        for i in range(1, p.count("/") + 1):
            out.setdefault("/".join(p.split("/")[:i]), "directory")
    return out


def test_roots_are_those_of_all_options(spark):
    rng = random.Random(3)
    names = ["src", "app", "util", "env", "repo", ".git"]
    trees, wants = {}, {}
    for p in range(160):
        layout = [f"{d}/{f}" if d else f for d in ["", "src", "src/util", "app", "lab/ex"] for f in ["main.py", "m1.py", "m2.py"] if rng.random() < 0.35]
        where = rng.choice(["", "repo", "a/b", "env", "lab", "src"])
        files = {f"{where}/{f}" if where else f: "file" for f in layout if rng.random() < 0.8}
        if rng.random() < 0.4:
            second = rng.choice(["copy", "repo", "z/y/x"])
            files |= {f"{second}/{f}": "file" for f in layout if rng.random() < 0.7}
        if rng.random() < 0.3:
            files |= {f"{rng.choice(names)}/{rng.choice(names)}/{rng.choice('xyz')}.py": "file" for _ in range(3)}
        tree = with_parents(files)
        for _ in range(rng.choice([0, 0, 1, 2])):
            folder = rng.choice(["", *[f for f, k in tree.items() if k == "directory"]])
            tree.setdefault(f"{folder}/.git" if folder else ".git", "directory")
        if rng.random() < 0.1:
            tree[".DS_Store"] = "file"
        # A path is a file or a folder, and what lies below a file doesn't exist.
        trees[p] = {k: v for k, v in tree.items() if not any(tree.get("/".join(k.split("/")[:i])) == "file" for i in range(1, k.count("/") + 1))} or {"only.txt": "file"}
        wants[p] = [(f, "file") for f in layout] + [(d, "directory") for d in ["src", "lab", "lab/ex"] if rng.random() < 0.3]
    schema = "project_id int, path string, kind string"
    got = R.detect_roots(spark.createDataFrame([(p, f, k) for p, t in trees.items() for f, k in t.items()], schema), spark.createDataFrame([(p, f, k) for p, w in wants.items() for f, k in w], schema)).collect()
    assert len(got) == len(trees)
    for r in got:
        assert tuple(r)[1:] == plain_detect(list(trees[r.project_id].items()), wants[r.project_id]), (trees[r.project_id], wants[r.project_id])
    assert {bool(r.strip_prefix) for r in got} == {True, False} and {r.confident for r in got} == {True, False} and sum("git repository" in (r.note or "") for r in got) > 1


@pytest.mark.parametrize(("files", "want"), [
    (["repo/src/a.py", "repo/src/b.py"], ("repo", "", 2)), (["a.py", "b.py"], ("", "src/", 2)), (["src/a.py"], ("", "", 1)), (["only/thing.txt"], ("only", "", 0)), (["x/src/a.py", "y/src/a.py"], ("x", "", 1)),
])
def test_layouts(spark, files, want):
    tree = [(1, p, k) for p, k in with_parents(dict.fromkeys(files, "file")).items()]
    schema = "project_id int, path string, kind string"
    r = R.detect_roots(spark.createDataFrame(tree, schema), spark.createDataFrame([(1, "src/a.py", "file"), (1, "src/b.py", "file")], schema)).first()
    assert (r.root, r.strip_prefix, r.matched) == want
