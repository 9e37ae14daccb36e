"""Where in a snapshot the repository is: the folder under which most of the expected paths exist.

A snapshot may hold the repository in a folder, or be a folder of it; then a beginning of the expected paths is stripped. Every
entry votes for each folder above it with the rest of its path, every expected path asks with each of its own beginnings cut
off, and one join on (project, rest, kind) counts what matches for each option (root, prefix).

Rules: folders down to MAX_DEPTH can be roots, MAX_CANDIDATES of a project in the order of depth and name, none of NOT_ROOTS nor
what is below one; under a root that holds .git nothing is stripped; a prefix is not stripped where an expected path outside
it exists, as that folder is the root then. The option that matches most counts, then the shortest prefix, the least depth, the
smallest path. A git root counts before all others if it matches something or the best option lies inside it; where nothing
matches, the git root nearest to the top does, or a single top folder. A project without expected paths expects nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Depth and number of folders that can be roots, folders that can't, what a single top folder may lie beside.
MAX_DEPTH, MAX_CANDIDATES = 3, 500
NOT_ROOTS = (".git", "__pycache__", "__MACOSX", "node_modules", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode")
BESIDE_TOP = ("__MACOSX", ".DS_Store")


def _depth(path: Column) -> Column:
    return F.when(path == "", 0).otherwise(F.size(F.split(path, "/")))


def _joined(parts: Column, start: Column | int, n: Column) -> Column:
    return F.array_join(F.slice(parts, start, n), "/")


def candidates(tree: DataFrame) -> DataFrame:
    """Folders that can be roots, with their place among a project's: (project_id, root, place, is_git)."""
    parts = F.split("path", "/")
    top = tree.select("project_id").distinct().withColumn("root", F.lit(""))
    folders = tree.where((F.col("kind") == "directory") & (F.size(parts) <= MAX_DEPTH) & ~F.arrays_overlap(parts, F.array(*map(F.lit, NOT_ROOTS)))).select("project_id", F.col("path").alias("root"))
    order = Window.partitionBy("project_id").orderBy(_depth(F.col("root")), F.split("root", "/"))
    named = top.unionByName(folders).distinct().withColumn("place", F.row_number().over(order)).where(F.col("place") <= MAX_CANDIDATES)
    git = tree.where((F.col("kind") == "directory") & (F.substring_index("path", "/", -1) == ".git")).select("project_id", F.regexp_replace("path", "/?[^/]*$", "").alias("root")).distinct().withColumn("git", F.lit(True))
    return named.join(git, ["project_id", "root"], "left").select("project_id", "root", "place", F.coalesce("git", F.lit(False)).alias("is_git"))


def options(tree: DataFrame, expected: DataFrame) -> DataFrame:
    """(project_id, root, prefix, matched, outside) of the options that match something; outside: how many expected paths that the
    prefix doesn't begin exist under the root."""
    parts = F.split("path", "/")
    depth = F.explode(F.sequence(F.lit(0), F.least(F.lit(MAX_DEPTH), F.size(parts))))
    entries = tree.select("project_id", "path", "kind").distinct().select("project_id", "kind", parts.alias("parts"), depth.alias("d"))
    # A folder is its own root with nothing left; the top is a folder, too.
    top = tree.select("project_id").distinct().select("project_id", F.lit("").alias("root"), F.lit("").alias("rest"), F.lit("directory").alias("kind"))
    offers = entries.select("project_id", _joined(F.col("parts"), 1, F.col("d")).alias("root"), _joined(F.col("parts"), F.col("d") + 1, F.size("parts") - F.col("d")).alias("rest"), "kind").unionByName(top)
    # Beginnings of the path itself, and all of it where another expected path lies below.
    n = F.size(parts)
    begins = F.transform(F.sequence(F.lit(0), n), lambda d: F.when(d == 0, F.lit("")).otherwise(F.concat(F.array_join(F.slice(parts, F.lit(1), d), "/"), F.lit("/"))))
    asked = expected.select("project_id", "path", "kind", begins.alias("begins"))
    used = asked.select("project_id", F.explode(F.slice("begins", F.lit(1), F.size("begins") - 1)).alias("prefix")).distinct()
    cut = asked.select("project_id", "kind", "path", "begins", F.explode("begins").alias("prefix")).join(used, ["project_id", "prefix"], "left_semi")
    wanted = cut.select("project_id", "kind", "begins", "prefix", F.substring("path", F.length("prefix") + 1, F.greatest(F.length("path") - F.length("prefix"), F.lit(0))).alias("rest"))
    hits = wanted.join(offers, ["project_id", "rest", "kind"])
    # A hit without prefix also counts as present below each of its path's beginnings.
    vote = F.struct("prefix", F.lit(1).alias("vote"), F.lit(0).alias("below"))
    present = F.transform("begins", lambda p: F.struct(p.alias("prefix"), F.lit(0).alias("vote"), F.lit(1).alias("below")))
    told = hits.select("project_id", "root", F.inline(F.when(F.col("prefix") == "", F.concat(F.array(vote), present)).otherwise(F.array(vote))))
    counts = told.groupBy("project_id", "root", "prefix").agg(F.sum("vote").alias("matched"), F.sum("below").alias("below"))
    there = F.coalesce(F.max(F.when(F.col("prefix") == "", F.col("below"))).over(Window.partitionBy("project_id", "root")), F.lit(0))
    return counts.withColumn("outside", there - F.col("below")).where("matched > 0").select("project_id", "root", "prefix", "matched", "outside")


def _is_under(path: Column, folder: Column) -> Column:
    return (folder == "") | (path == folder) | F.startswith(path, F.concat(folder, F.lit("/")))


def detect_roots(tree: DataFrame, expected: DataFrame) -> DataFrame:
    """tree(project_id, path, kind) and expected(project_id, path, kind) to (project_id, root, strip_prefix, matched, expected, note,
    confident). Of expected paths that repeat, the smallest kind counts."""
    expected = expected.groupBy("project_id", "path").agg(F.min("kind").alias("kind"))
    # A root without a match that is allowed stays with none, for git roots and for what is around them.
    found = candidates(tree).join(options(tree, expected), ["project_id", "root"], "left")
    allowed = F.coalesce((F.col("prefix") == "") | (~F.col("is_git") & (F.col("outside") == 0)), F.lit(False))
    found = found.select("project_id", "root", "place", "is_git", F.when(allowed, F.col("prefix")).otherwise("").alias("prefix"), F.when(allowed, F.col("matched")).otherwise(0).cast("long").alias("matched"))
    every, project = found, Window.partitionBy("project_id")
    own = F.struct((-F.col("matched")).alias("less"), F.length("prefix").alias("cut"), _depth(F.col("root")).alias("depth"), "root", "prefix")
    nearest = F.struct(F.greatest(_depth(F.col("root")) - 1, F.lit(0)).alias("slashes"), F.length("root").alias("n"), "place", "root")
    every = every.select(
        "*", F.min(F.when(F.col("matched") > 0, own)).over(project).alias("some"), F.min(F.when(F.col("is_git") & (F.col("matched") > 0), own)).over(project).alias("git"), F.min(F.when(F.col("is_git"), nearest)).over(project).alias("nearest")
    )
    nothing = F.struct(F.lit(0).cast("long").alias("less"), F.lit(0).alias("cut"), F.lit(0).alias("depth"), F.lit("").alias("root"), F.lit("").alias("prefix"))
    every = every.withColumn("best", F.coalesce("some", nothing)).withColumn("around", F.max(F.when(F.col("is_git") & _is_under(F.col("best.root"), F.col("root")), F.struct(F.length("root").alias("n"), "root"))).over(project))
    tops = tree.select("project_id", F.substring_index("path", "/", 1).alias("name"), ((F.col("kind") == "directory") | F.contains("path", F.lit("/"))).alias("folder")).where(~F.col("name").isin(*BESIDE_TOP))
    tops = tops.groupBy("project_id").agg(F.min("name").alias("top"), F.max("name").alias("last"), F.max("folder").alias("folder")).where("top = last and folder and top <> '.git'").select("project_id", "top")
    wanted = expected.groupBy("project_id").agg(F.count("*").alias("expected"))
    told = lambda root, prefix, matched: F.struct(root.alias("root"), prefix.alias("prefix"), matched.alias("matched"))
    mine = told(F.col("best.root"), F.col("best.prefix"), -F.col("best.less"))
    blank, zero = F.lit(""), F.lit(0).cast("long")
    matches = F.col("best.less") < 0
    inside = F.col("git").isNull() & F.col("around").isNotNull() & matches
    chosen = (
        F.when(F.col("nearest").isNull(), F.when(matches | F.col("top").isNull(), mine).otherwise(told(F.col("top"), blank, zero)))
        .when(F.col("git").isNotNull(), told(F.col("git.root"), F.col("git.prefix"), -F.col("git.less")))
        .when(inside, told(F.col("around.root"), blank, zero))
        .when(~matches, told(F.col("nearest.root"), blank, zero))
        .otherwise(mine)
    )
    rows = every.join(tops, "project_id", "left").withColumn("c", chosen).withColumn("inside", inside)
    # Other roots that match as well with the same prefix.
    tie = (F.col("c.matched") > 0) & (F.col("matched") == F.col("c.matched")) & (F.col("prefix") == F.col("c.prefix")) & (F.col("root") != F.col("c.root"))
    rows = rows.groupBy("project_id").agg(
        F.first("c").alias("c"), F.first("best").alias("best"), F.first("inside").alias("inside"), F.first("nearest").isNotNull().alias("has_git"), F.max(F.col("is_git") & (F.col("root") == F.col("c.root"))).alias("is_git"),
        F.transform(F.array_sort(F.collect_list(F.when(tie, F.struct("place", "root")))), lambda t: t["root"]).alias("ties"),
    )
    rows = rows.join(wanted, "project_id", "left").withColumn("expected", F.coalesce("expected", F.lit(0)))
    dot = lambda r: F.when(r == "", ".").otherwise(r)
    n, of = F.col("c.matched").cast("string"), F.col("expected").cast("string")
    first = (
        F.when((F.col("expected") > 0) & (F.col("c.matched") == 0), F.lit("None of the expected files were found at their expected paths."))
        .when(F.col("c.prefix") != "", F.concat(F.lit("The analyzed folder looks like '"), "c.prefix", F.lit("' of your repository, not its root: files are checked relative to it ("), n, F.lit("/"), of, F.lit(" expected paths found).")))
        .when(F.col("c.root") != "", F.concat(F.lit("Using '"), "c.root", F.lit("/' as the repository root ("), n, F.lit("/"), of, F.lit(" expected paths found there).")))
        .when((F.col("expected") > 0) & (2 * F.col("c.matched") < F.col("expected")), F.concat(F.lit("Only "), n, F.lit("/"), of, F.lit(" expected paths were found at the repository root.")))
    )
    others = F.array_join(F.transform(F.slice("ties", 1, 3), lambda r: F.concat(F.lit("'"), dot(r), F.lit("/'"))), ", ")
    second = F.when((F.size("ties") > 0) & (F.col("c.matched") > 0), F.concat(F.lit("Other folders match equally well ("), others, F.lit(").")))
    within = F.concat(F.lit("The git repository root is '"), dot(F.col("c.root")), F.lit("', but the expected files were found under '"), dot(F.col("best.root")), F.lit("/"), "best.prefix", F.lit("': paths are checked from the repository root."))
    note = F.when(F.col("inside"), within).otherwise(F.concat_ws(" ", first, second))
    sure = (F.col("c.matched") > 0) & (F.col("c.prefix") == "") & (2 * F.col("c.matched") >= F.col("expected")) & (F.size("ties") == 0) & (~F.col("has_git") | F.coalesce("is_git", F.lit(False)))
    return rows.select("project_id", "c.root", F.col("c.prefix").alias("strip_prefix"), "c.matched", "expected", F.when(note != "", note).alias("note"), sure.alias("confident"))
