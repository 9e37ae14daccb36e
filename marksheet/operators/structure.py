"""Trees of project files against what a subject asks for, constraints against what the code does."""

from __future__ import annotations

import functools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marksheet.functions import scores as S
from marksheet.functions import text as X


#: Folders in which nothing is looked for.
IGNORED_FOLDERS = ["__MACOSX", ".git", "node_modules", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache"]


def match_requirements(required: DataFrame, tree: DataFrame, root: str = "", forbidden_folders: list[str] | None = None) -> DataFrame:
    """required(project_id, pos, path, kind, required, bonus) to what answers each: the path itself, the path in another
    case, or the best of the same name elsewhere (exact name, below root, most folders in common, fewest folders, path).
    Nothing in an ignored or forbidden folder answers by name. Each entry of tree(project_id, path, kind) answers one
    requirement; in each pass the first by pos chooses first.

    The passes are joins. Choosing in turn is a fold over the candidates of one base name of a project, so it runs in
    groups of that size."""
    entries = tree.select("project_id", "kind", F.col("path").alias("found"))
    exact = required.join(entries.withColumn("path", F.col("found")), ["project_id", "kind", "path"]).withColumn("how", F.lit("exact"))
    first = Window.partitionBy("project_id", "found").orderBy("pos")

    def left(pool: DataFrame, taken: DataFrame, *keys: str) -> DataFrame:
        return pool.join(taken.select("project_id", *keys), ["project_id", *keys], "left_anti")

    rest, free = left(required, exact, "pos"), left(entries, exact, "found")
    # Of entries that are one path in another case, the smallest is looked at.
    folded = entries.groupBy("project_id", F.lower("found").alias("low")).agg(F.min(F.struct("found", "kind")).alias("e")).select("project_id", "low", "e.found", "e.kind")
    cased = rest.withColumn("low", F.lower("path")).join(folded.join(free.select("project_id", "found"), ["project_id", "found"], "left_semi"), ["project_id", "kind", "low"])
    cased = cased.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth", "low").withColumn("how", F.lit("case"))
    rest, free = left(rest, cased, "pos"), left(free, cased, "found")
    folders = F.slice(F.split("found", "/"), 1, F.size(F.split("found", "/")) - 1)
    wanted = F.slice(F.split("path", "/"), 1, F.size(F.split("path", "/")) - 1)
    hidden = F.exists(folders, lambda f: f.isin(*IGNORED_FOLDERS))
    patterns = [X.glob_regex(p.rstrip("/")) for p in forbidden_folders or []]
    hidden |= F.exists(folders, lambda f: functools.reduce(lambda a, p: a | f.rlike(p), patterns, F.lit(False)))
    differs = F.zip_with(folders, wanted, lambda a, b: ~a.eqNullSafe(b))
    common = F.coalesce(F.array_min(F.transform(differs, lambda d, i: F.when(d, i))), F.size(folders))
    below = F.lit(root == "") | (F.col("found") == root) | F.startswith("found", F.lit(root + "/"))
    rank = F.struct((X.basename(F.col("found")) != X.basename(F.col("path"))).alias("a"), (~below).alias("b"), (-common).alias("c"), F.size(folders).alias("d"), F.col("found").alias("e"))
    named = rest.withColumn("name", F.lower(X.basename(F.col("path")))).join(free.withColumn("name", F.lower(X.basename(F.col("found")))), ["project_id", "kind", "name"]).where(~hidden)
    choices = named.groupBy("project_id", "kind", "name", "pos").agg(F.transform(F.array_sort(F.collect_list(rank)), lambda r: r["e"]).alias("choices"))
    queue = choices.groupBy("project_id", "kind", "name").agg(F.array_sort(F.collect_list(F.struct("pos", "choices"))).alias("queue"))
    none = F.expr("cast(array() as array<struct<pos: bigint, found: string>>)")
    pick = lambda done, q: F.concat(done, F.array(F.struct(q["pos"].cast("long").alias("pos"), F.try_element_at(F.filter(q["choices"], lambda c: ~F.exists(done, lambda d: d["found"].eqNullSafe(c))), F.lit(1)).alias("found"))))
    moved = queue.select("project_id", F.inline(F.aggregate("queue", none, pick))).where("found is not null")
    moved = rest.join(moved, ["project_id", "pos"]).withColumn("how", F.lit("misplaced"))
    missing = left(rest, moved, "pos").withColumn("found", F.lit(None).cast("string")).withColumn("how", F.lit("missing"))
    every = exact.unionByName(cased).unionByName(moved).unionByName(missing)
    outcome = S.requirement_outcome(F.col("required"), F.col("bonus"))
    return every.withColumn("status", F.when(F.col("how") == "exact", "pass").otherwise(outcome["status"]))


def with_folders(tree: DataFrame) -> DataFrame:
    """tree with a row of kind directory for every folder above its entries."""
    above = tree.select("project_id", F.explode(X.parents(F.col("path"))).alias("path")).where("path is not null").distinct()
    known = tree.where("kind = 'directory'").select("project_id", "path")
    return tree.select("project_id", "path", "kind").unionByName(above.join(known, ["project_id", "path"], "left_anti").withColumn("kind", F.lit("directory")))


def unwanted(tree: DataFrame, patterns: list[str]) -> DataFrame:
    """Paths that a pattern forbids, with the first that does; of those, only the outermost. x/ is about folders."""
    tests = [F.when(F.col("path").rlike(r) & (F.lit(not p.strip().endswith("/")) | (F.col("kind") == "directory")), F.lit(p)) for p in patterns if (r := X.glob_regex(p))]
    hit = tree.withColumn("pattern", F.coalesce(F.lit(None).cast("string"), *tests)).where("pattern is not null")
    above = hit.select("project_id", "path", F.explode(X.parents(F.col("path"))).alias("folder")).where("folder is not null")
    inside = above.join(hit.where("kind = 'directory'").select("project_id", F.col("path").alias("folder")), ["project_id", "folder"], "left_semi").select("project_id", "path").distinct()
    return hit.join(inside, ["project_id", "path"], "left_anti")


def files_below(tree: DataFrame) -> DataFrame:
    """How many files each folder holds at any depth."""
    return tree.where("kind = 'file'").select("project_id", F.explode(X.parents(F.col("path"))).alias("folder")).where("folder is not null").groupBy("project_id", "folder").agg(F.count("*").alias("files"))


def case_collisions(tree: DataFrame) -> DataFrame:
    """Paths that are one path where case doesn't count; the first stays."""
    w = Window.partitionBy("project_id", F.lower("path"))
    return tree.withColumn("n", F.count("*").over(w)).withColumn("nth", F.row_number().over(w.orderBy("path"))).where("n > 1 and nth > 1").drop("n", "nth")


def ordered_tree(tree: DataFrame) -> DataFrame:
    """tree(project_id, path, ...) with place, from 1, in the order of a tree: by the parts of the path, case counting last."""
    return tree.withColumn("place", F.row_number().over(Window.partitionBy("project_id").orderBy(X.path_order(F.col("path")))))


def merge_constraints(general: DataFrame, own: DataFrame) -> DataFrame:
    """(subject_id, allowed, forbidden): an own allow-list replaces the general one unless null; forbidden lists unite."""
    a, b = general.alias("a"), own.alias("b")
    union = F.array_sort(F.array_union(F.coalesce("a.forbidden", F.array().cast("array<string>")), F.coalesce("b.forbidden", F.array().cast("array<string>"))))
    return a.join(b, "subject_id", "left").select("subject_id", "b.exercise_id", F.coalesce("b.allowed", "a.allowed").alias("allowed"), union.alias("forbidden"))


def modules_matching(modules: DataFrame, patterns: DataFrame) -> DataFrame:
    """(module, pattern) where the module is the pattern or below it, by equality with the module's own beginnings."""
    parts = F.split("module", r"\.")
    begins = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))
    return modules.select("module", F.explode(begins).alias("pattern")).join(patterns.select("pattern"), "pattern").select("module", "pattern")


def call_violations(calls: DataFrame, forbidden: DataFrame) -> DataFrame:
    """Calls of forbidden names: how often, on which lines, in how many functions, and the first column."""
    hit = calls.join(forbidden.select("name"), "name", "left_semi")
    return hit.groupBy("project_id", "name").agg(F.count("*").alias("calls"), F.array_join(F.array_sort(F.collect_list("line")), ",").alias("lines"), F.countDistinct("function").alias("functions"), F.min_by("col", "seq").alias("first_col"))


def _git_records(raw: DataFrame) -> DataFrame:
    """(project_id, raw): porcelain v2 output, NUL-separated, a row for each record but the old paths of renames.

    An old path follows its record and may look like one, so in a run of records that begin like renames every other is a
    path, and after a run of odd length so is the next."""
    order = Window.partitionBy("project_id").orderBy("pos")
    rows = raw.select("project_id", F.posexplode(F.split("raw", "\0")).alias("pos", "rec")).where("rec <> ''").withColumn("two", F.startswith("rec", F.lit("2 ")))
    rows = rows.withColumn("run", F.sum((~F.col("two")).cast("int")).over(order))
    rows = rows.withColumn("nth", F.sum(F.col("two").cast("int")).over(Window.partitionBy("project_id", "run").orderBy("pos")))
    before = F.coalesce(F.lag(F.when(F.col("two"), F.col("nth")).otherwise(0)).over(order), F.lit(0))
    return rows.withColumn("before", before).where(F.when(F.col("two"), F.col("nth") % 2 == 1).otherwise(F.col("before") % 2 == 0)).select("project_id", "pos", "rec")


def parse_git_status(raw: DataFrame) -> DataFrame:
    """(project_id, raw) of porcelain v2 to (project_id, path, state): staged, modified, untracked or ignored; an unmerged path is
    staged and modified; records of other kinds give none."""
    kind = F.substring("rec", 1, 1)
    last = lambda fields: F.regexp_extract("rec", rf"(?s)\A(?:[^ ]* ){{{fields}}}(.*)\z", 1)
    path = F.when(kind == "1", last(8)).when(kind == "2", last(9)).when(kind == "u", last(10)).when(kind.isin("?", "!"), F.substring("rec", 3, 100_000))
    xy = F.split("rec", " ").getItem(1)
    changed = F.array_compact(F.array(F.when(F.substring(xy, 1, 1) != ".", F.lit("staged")), F.when(F.substring(xy, 2, 1) != ".", F.lit("modified"))))
    states = F.when(kind == "?", F.array(F.lit("untracked"))).when(kind == "!", F.array(F.lit("ignored"))).when(kind == "u", F.array(F.lit("modified"), F.lit("staged"))).otherwise(F.when(F.length(xy) == 2, changed))
    return _git_records(raw).select("project_id", path.alias("path"), F.explode(states).alias("state")).where("path <> ''")


def git_heads(raw: DataFrame) -> DataFrame:
    """(project_id, oid, head) of porcelain v2: the commit and branch; null before the first commit, and off any branch. Of headers
    that repeat, the last counts."""
    rows = _git_records(raw).where(F.startswith("rec", F.lit("# ")))
    value = lambda name: F.max_by(F.regexp_extract("rec", r"(?s)\A# \S+ (.*)\z", 1), F.when(F.startswith("rec", F.lit(f"# branch.{name} ")), F.col("pos")))
    got = raw.select("project_id").distinct().join(rows.groupBy("project_id").agg(value("oid").alias("oid"), value("head").alias("head")), "project_id", "left")
    return got.select("project_id", F.when(F.col("oid") != "(initial)", F.col("oid")).alias("oid"), F.when(F.col("head") != "(detached)", F.col("head")).alias("head"))
