"""Snapshots of projects: folders on shared storage listed and read in tasks, and what of a listing is kept, by rules on its
paths, sizes and order.

A listing is (project_id, pos, raw, kind, size): pos is the place in the order of listing, once a project; kind is file, directory,
link or special; raw is the path below the project's folder as it was listed."""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marksheet.functions import text as X
from marksheet.sources.tables import once, written

#: Folders that stay empty in a snapshot, folders of archives alone, letters and names that Windows doesn't store.
SKIPPED_FOLDERS = ["node_modules", ".venv", "venv", "env", ".tox", ".mypy_cache", ".pytest_cache"]
JUNK_FOLDERS = ["__MACOSX"]
FORBIDDEN_LETTERS = ["<", ">", ":", '"', "|", "?", "*"]
DEVICES = r"^(CON|PRN|AUX|NUL|CONIN\$|CONOUT\$|(COM|LPT)[1-9¹²³])$"
#: Rows of a listing that one task looks at to find where a budget is spent.
BLOCK = 4096
#: Fixed value: tasks for each core that look at paths.
TASKS_A_CORE = 4
#: What a task holds of a listing or of contents before it hands them on.
BATCH_ROWS, BATCH_BYTES = 10_000, 32 << 20


@dataclass(frozen=True)
class Limits:
    """Fixed values, in files, folders and bytes; git's own files have their own budget."""

    files: int = 5000
    folders: int = 5000
    total_bytes: int = 50 << 20
    file_bytes: int = 5 << 20
    git_files: int = 20_000
    git_bytes: int = 200 << 20


# ---------------------------------------------------------------- folders


def _walk(folder: str) -> Iterator[tuple[str, str, int | None]]:
    """(path, kind, size) of all below a folder: names of a folder in order, the folder met last is opened next. Links and folders
    that a snapshot skips are named, not opened."""
    from pyarrow import fs

    store, top = fs.FileSystem.from_uri(folder)
    local, pending = isinstance(store, fs.LocalFileSystem), [""]
    while pending:
        here = pending.pop()
        found = store.get_file_info(fs.FileSelector(f"{top}/{here}".rstrip("/")))
        for info in sorted(found, key=lambda i: i.base_name):
            path = f"{here}/{info.base_name}".lstrip("/")
            if local and os.path.islink(info.path):
                yield path, "link", None
            elif info.type == fs.FileType.Directory:
                yield path, "directory", None
                if info.base_name not in SKIPPED_FOLDERS:
                    pending.append(path)
            else:
                yield path, "file" if info.type == fs.FileType.File else "special", info.size


def list_folders(folders: DataFrame) -> DataFrame:
    """The listing of (project_id, folder), folder a URI that executors can read; an unreadable one fails the job. A task holds
    the folders that it has yet to open, and one batch."""

    def listed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for project, folder in zip(batch["project_id"], batch["folder"]):
                rows = []
                for pos, row in enumerate(_walk(folder)):
                    rows.append((project, pos, *row))
                    if len(rows) == BATCH_ROWS:
                        yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})
                        rows = []
                yield pd.DataFrame(rows, columns=columns).astype({"size": "Int64"})

    columns = ["project_id", "pos", "raw", "kind", "size"]
    key = folders.schema["project_id"].dataType.simpleString()
    return folders.select("project_id", "folder").mapInPandas(listed, f"project_id {key}, pos long, raw string, kind string, size long")


def read_contents(files: DataFrame) -> DataFrame:
    """(project_id, path, content) of (project_id, folder, path): the bytes of files that a snapshot keeps."""
    key = files.schema["project_id"].dataType.simpleString()

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        for batch in batches:
            rows, held = [], 0
            for project, folder, path in zip(batch["project_id"], batch["folder"], batch["path"]):
                store, top = fs.FileSystem.from_uri(folder)
                with store.open_input_stream(f"{top}/{path}") as f:
                    rows.append((project, path, f.read()))
                held += len(rows[-1][2])
                if held > BATCH_BYTES:
                    yield pd.DataFrame(rows, columns=["project_id", "path", "content"])
                    rows, held = [], 0
            yield pd.DataFrame(rows, columns=["project_id", "path", "content"])

    return files.select("project_id", "folder", "path").mapInPandas(read, f"project_id {key}, path string, content binary")


# ---------------------------------------------------------------- paths


def unsafe(raw: Column) -> Column:
    """Why a path can't be below the project's folder, or null: absolute ones, drives, .. and NUL."""
    path = F.replace(raw, F.lit("\\"), F.lit("/"))
    return (
        F.when(F.contains(raw, F.lit("\0")), "nul").when(F.startswith(path, F.lit("/")) | path.rlike("^[A-Za-z]:"), "absolute")
        .when(F.array_contains(F.split(path, "/"), ".."), "escaping")
    )


def clean_parts(raw: Column) -> Column:
    """The names of a path, without empty ones and single dots; none for the folder itself."""
    return F.filter(F.split(F.replace(raw, F.lit("\\"), F.lit("/")), "/"), lambda x: ~x.isin("", "."))


def name_problem(name: Column) -> Column:
    """Why a name can't be stored everywhere, or null."""
    bad = F.array_join(F.array_sort(F.array_distinct(F.filter(F.split(name, ""), lambda c: c.isin(*FORBIDDEN_LETTERS)))), " ")
    stem = F.upper(F.rtrim(F.substring_index(name, ".", 1)))
    return (
        F.when(name.rlike(r"[\x00-\x1F]"), "control character in the name").when(name.rlike(f"[{''.join(FORBIDDEN_LETTERS)}]"), F.concat(F.lit("character(s) "), bad, F.lit(" not allowed in file names")))
        .when(name.rlike(r"[ .]\z"), "name ending with a space or a dot").when(stem.rlike(DEVICES), F.concat(F.lit("reserved device name '"), stem, F.lit("'")))
    )


def _folded(name: Column) -> Column:
    return F.lower(F.upper(name))


def _path(parts: Column, n: Column) -> Column:
    return F.array_join(F.slice(parts, F.lit(1), n), "/")


def _below(parent: Column, name: Column) -> Column:
    return F.when(parent == "", name).otherwise(F.concat(parent, F.lit("/"), name))


# ---------------------------------------------------------------- entries


def _classified(listing: DataFrame) -> DataFrame:
    """fate and note of each row by its own path alone; null fate where other rows matter."""
    parts, size, folder = F.col("parts"), F.size("parts"), F.col("kind") == "directory"
    rows = listing.select("project_id", "pos", "kind", F.coalesce("size", F.lit(0)).alias("size"), F.coalesce("raw", F.lit("")).alias("raw"))
    rows = once(rows, unsafe=unsafe(F.col("raw")), parts=clean_parts(F.col("raw"))).drop("raw")
    # The outermost folder of a name with a meaning decides.
    folders = F.when(folder, parts).otherwise(F.slice(parts, F.lit(1), F.greatest(size - 1, F.lit(0))))
    rows = once(rows, path=F.array_join("parts", "/"), problem=F.get(F.array_compact(F.transform("parts", name_problem)), F.lit(0)), special=F.get(F.filter(folders, lambda x: x.isin(".git", *SKIPPED_FOLDERS, *JUNK_FOLDERS)), F.lit(0)))
    special, problem = F.col("special"), F.col("problem")
    skipped, junk, link = special.isin(*SKIPPED_FOLDERS), special.isin(*JUNK_FOLDERS), special.isNull() & ~folder & (F.try_element_at(parts, F.lit(-1)) == ".git")
    fate = (
        F.when(F.col("unsafe").isNotNull(), "unsafe").when(F.col("path") == "", "root").when(problem.isNotNull() | F.col("kind").isin("link", "special"), "skipped").when(special == ".git", "git")
        .when(skipped, "placeholder").when(junk | link, "skipped")
    )
    note = (
        F.when(F.col("unsafe").isNotNull(), F.col("unsafe")).when(problem.isNotNull(), F.concat("problem", F.lit(", not copied"))).when(F.col("kind") == "link", "symbolic link, not copied").when(F.col("kind") == "special", "special file, not copied")
        .when(skipped, "dependency/cache folder, not copied").when(junk, "archive metadata, not part of the project").when(link, "git link file pointing outside the project, not copied")
    )
    top = F.when(skipped, _path(parts, F.array_position(parts, special).cast("int")))
    return once(rows, placeholder=top, fate=fate, note=note).drop("unsafe", "problem", "special")


def _conflicts(open_rows: DataFrame) -> DataFrame:
    """open_rows with conflict, null where a path may stay: of paths that can't be stored side by side the first listed does.

    Below one spelling of a folder, the first of names that differ by case alone owns the name; what comes later by another spelling, or
    needs a file as its folder, conflicts, outermost folder first. All rows of a folder live or fall with it, so no order among
    folders is needed: names are counted once each, and only spellings that lose are joined back."""
    parts, n = F.col("parts"), F.size("parts")
    level = F.explode(F.sequence(F.lit(1), n)).alias("depth")
    rows = open_rows.select("project_id", "pos", "kind", "parts", level)
    at = F.col("depth")
    rows = rows.select("project_id", "pos", at, _path(parts, at - 1).alias("parent"), F.element_at(parts, at).alias("name"), ((at < n) | (F.col("kind") == "directory")).alias("folder"))
    spelled = rows.groupBy("project_id", "parent", _folded(F.col("name")).alias("folded"), "name").agg(F.min("pos").alias("pos"), F.min_by("folder", "pos").alias("folder"), F.min("depth").alias("depth"))
    first = F.first(F.struct("name", "folder", "pos")).over(Window.partitionBy("project_id", "parent", "folded").orderBy("pos"))
    spelled = spelled.withColumn("owner", first).select("project_id", "parent", "name", "depth", "owner", _below(F.col("parent"), F.col("name")).alias("path"), _below(F.col("parent"), F.col("owner.name")).alias("owned"))
    other = F.col("owner.name") != F.col("name")
    lost = spelled.where(other | ~F.col("owner.folder"))
    reason = F.when(other, F.concat(F.lit("folder '"), "path", F.lit("' differs only by letter case from '"), "owned", F.lit("'"))).otherwise(F.concat(F.lit("its parent '"), "path", F.lit("' is a file")))
    lost = lost.select("project_id", "path", "depth", reason.alias("conflict"))
    mine = open_rows.withColumn("folder", _path(parts, n - 1)).withColumn("block", _block())
    folders = mine.where("folder <> ''").select("project_id", "folder", "block").distinct()
    inside = folders.select("project_id", "folder").distinct().select("project_id", "folder", F.explode(F.array_append(X.parents(F.col("folder")), F.col("folder"))).alias("path")).where("path is not null").join(lost, ["project_id", "path"])
    inside = inside.groupBy("project_id", "folder").agg(F.min_by("conflict", "depth").alias("inside"))
    rows = mine.join(folders.join(inside, ["project_id", "folder"]), ["project_id", "folder", "block"], "left").join(spelled.select("project_id", "path", "owner", "owned"), ["project_id", "path"], "left")
    reason = F.when(F.col("owned") == F.col("path"), "duplicate entry").otherwise(F.concat(F.lit("differs only by letter case from '"), "owned", F.lit("'")))
    own = F.when((F.col("owner.pos") != F.col("pos")) & ~((F.col("owned") == F.col("path")) & F.col("owner.folder") & (F.col("kind") == "directory")), reason)
    return rows.select(*open_rows.columns, F.coalesce("inside", own).alias("conflict"))


def snapshot_entries(listing: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(project_id, pos, path, kind, size, placeholder, fate, note) of each row of a listing.

    fate: keep; git (kept under its own budget); placeholder (in a folder that stays empty: placeholder is its path); skipped, conflict
    and too_large, with a note; root (the folder itself); unsafe (its project is rejected). A null raw is the folder itself, a null
    size 0. Case is folded by upper and lower case of each letter.

    Paths are dear to look at: the listing, which may come in a few files, is dealt to all cores, and what was found is written for the steps
    that follow."""
    tasks = TASKS_A_CORE * listing.sparkSession.sparkContext.defaultParallelism
    rows = written(_classified(listing.repartition(tasks, "project_id", "pos")), "snapshot-rows")
    rows = _conflicts(rows.where("fate is null")).unionByName(rows.where("fate is not null"), allowMissingColumns=True)
    large = (F.col("kind") != "directory") & (F.col("size") > limits.file_bytes)
    note = F.coalesce("note", F.when(F.col("fate").isNull(), F.coalesce(F.concat("conflict", F.lit(", not copied")), F.when(large, F.format_string(f"file too large: %.1f MB, limit {limits.file_bytes >> 20} MB", F.col("size") / (1 << 20))))))
    fate = F.coalesce("fate", F.when(F.col("conflict").isNotNull(), "conflict").when(large, "too_large").otherwise("keep"))
    return rows.select("project_id", "pos", "path", "kind", "size", "placeholder", fate.alias("fate"), note.alias("note"))


# ---------------------------------------------------------------- budgets


def _block() -> Column:
    return F.floor(F.col("pos") / BLOCK)


def _spent(amounts: DataFrame) -> DataFrame:
    """(project_id, measure, pos) where the amounts of a measure, in order of pos, first come above its limit.

    Sums by block of places first; only the block in which a budget is spent is looked at row by row."""
    by = Window.partitionBy("project_id", "measure").orderBy("block")
    amounts = amounts.withColumn("block", _block())
    blocks = amounts.groupBy("project_id", "measure", "block", "limit").agg(F.sum("amount").alias("amount")).withColumn("upto", F.sum("amount").over(by))
    full = blocks.where("upto > `limit`").groupBy("project_id", "measure").agg(F.min_by(F.struct("block", (F.col("upto") - F.col("amount")).alias("before")), "block").alias("b")).select("project_id", "measure", "b.*")
    inside = amounts.join(full, ["project_id", "measure", "block"]).withColumn("upto", F.col("before") + F.sum("amount").over(Window.partitionBy("project_id", "measure").orderBy("pos")))
    return inside.where("upto > `limit`").groupBy("project_id", "measure").agg(F.min("pos").alias("pos"))


def snapshot_projects(entries: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """(project_id, status, reason, at_pos, files, total_bytes, git_files, git_kept, heaviest) of snapshot_entries(), which are read
    several times: write them first.

    A project is rejected at the first row that is unsafe or spends a budget (too_many_files, too_large, too_many_folders); files and
    bytes are then those up to there, heaviest the three entries at the top with most files, as name:files. Otherwise ok. Folders
    count where they are listed before anything in them. Git's files count apart: over their budget none is kept."""
    kept = entries.where("fate = 'keep'")
    uses = entries.where("fate = 'keep' or fate = 'git' and kind = 'directory'")
    above = uses.select("project_id", "pos", F.explode(X.parents(F.col("path"))).alias("path")).where("path is not null").unionByName(uses.where("kind = 'directory'").select("project_id", "pos", "path"))
    first = above.groupBy("project_id", "path").agg(F.min("pos").alias("pos"))
    folders = kept.where("kind = 'directory'").join(first, ["project_id", "path", "pos"], "left_semi")
    amount = lambda df, measure, value, limit: df.select("project_id", "pos", F.lit(measure).alias("measure"), value.cast("long").alias("amount"), F.lit(limit).cast("long").alias("limit"))
    files = kept.where("kind <> 'directory'")
    spent = _spent(amount(files, "too_many_files", F.lit(1), limits.files).unionByName(amount(files, "too_large", F.col("size"), limits.total_bytes)).unionByName(amount(folders, "too_many_folders", F.lit(1), limits.folders)))
    bad = spent.unionByName(entries.where("fate = 'unsafe'").select("project_id", F.concat(F.lit("unsafe:"), "note").alias("measure"), "pos"))
    # On one row files are counted before bytes.
    order = F.struct("pos", F.when(F.col("measure") == "too_many_files", 0).otherwise(1), "measure")
    ended = bad.groupBy("project_id").agg(F.min("pos").alias("at_pos"), F.min_by("measure", order).alias("reason"))
    # Rows of a project may be too many for a task: they are summed by block, and only the block in which a project ends is looked at row by row.
    rows = entries.withColumn("block", _block()).withColumn("top", F.element_at(F.split("path", "/"), 1))
    counted, git = (F.col("fate") == "keep") & (F.col("kind") != "directory"), (F.col("fate") == "git") & (F.col("kind") != "directory")
    size = lambda which: F.sum(F.when(which, F.col("size")).otherwise(0))
    blocks = rows.groupBy("project_id", "top", "block").agg(F.count_if(counted).alias("files"), size(counted).alias("total_bytes"), F.count_if(git).alias("git_files"), size(git).alias("git_bytes"))
    last = ended.select("project_id", "at_pos", F.floor(F.col("at_pos") / BLOCK).alias("last"))
    before = F.col("last").isNull() | (F.col("block") < F.col("last"))
    blocks = blocks.join(last.drop("at_pos"), "project_id", "left").select("project_id", "top", *[F.when(before, F.col(c)).otherwise(0).alias(c) for c in ("files", "total_bytes")], "git_files", "git_bytes")
    rest = rows.where(counted).join(last.withColumnRenamed("last", "block"), ["project_id", "block"]).where("pos <= at_pos")
    rest = rest.groupBy("project_id", "top").agg(F.count("*").alias("files"), F.sum("size").alias("total_bytes")).withColumn("git_files", F.lit(0).cast("long")).withColumn("git_bytes", F.lit(0).cast("long"))
    sums = [F.sum(c).alias(c) for c in ("files", "total_bytes", "git_files", "git_bytes")]
    tops = blocks.unionByName(rest).groupBy("project_id", "top").agg(*sums)
    place = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("files"), "top"))
    heavy = tops.where("files > 0").select("project_id", "top", "files", place.alias("place")).where("place <= 3")
    heavy = heavy.groupBy("project_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat("top", F.lit(":"), F.col("files").cast("string")).alias("text")))).alias("heavy"))
    heavy = heavy.join(ended.where("reason IN ('too_many_files', 'too_large')").select("project_id"), "project_id", "left_semi")
    total = tops.groupBy("project_id").agg(*sums).join(ended, "project_id", "left").join(heavy, "project_id", "left").withColumn("heavy", F.coalesce("heavy", F.expr("cast(array() as array<struct<place:int,text:string>>)")))
    fits = (F.col("git_files") <= limits.git_files) & (F.col("git_bytes") <= limits.git_bytes)
    return total.select("project_id", F.when(F.col("reason").isNull(), "ok").otherwise("rejected").alias("status"), "reason", "at_pos", "files", "total_bytes", "git_files", fits.alias("git_kept"), F.array_join(F.transform("heavy", lambda x: x["text"]), ", ").alias("heaviest"))


def snapshot_tree(entries: DataFrame, projects: DataFrame) -> DataFrame:
    """(project_id, path, kind, size, place) of what accepted projects keep outside git, with all folders above, those that stay
    empty too, in the order of a tree. A path's place is among its project's."""
    from marksheet.operators.structure import ordered_tree

    git = F.array_contains(F.split("path", "/"), ".git")
    # Projects meet their rows by block, as one alone may have more rows than a task should hold.
    rows = entries.withColumn("block", _block())
    accepted = rows.select("project_id", "block").distinct().join(projects.where("status = 'ok'").select("project_id"), "project_id", "left_semi")
    rows = rows.join(accepted, ["project_id", "block"], "left_semi")
    files = rows.where("fate = 'keep' and kind <> 'directory'").select("project_id", "path", "kind", "size")
    named = rows.where("fate = 'keep' or fate = 'git' and kind = 'directory'").select("project_id", F.explode(X.parents(F.col("path"))).alias("path"))
    empty = rows.where("fate = 'placeholder'").select("project_id", F.col("placeholder").alias("path")).distinct()
    # Folders above an empty one are made with it.
    empty = empty.unionByName(empty.select("project_id", F.explode(X.parents(F.col("path"))).alias("path")))
    folders = named.unionByName(rows.where("fate = 'keep' and kind = 'directory'").select("project_id", "path")).unionByName(empty).where("path is not null").where(~git).distinct()
    return ordered_tree(files.unionByName(folders.select("project_id", "path", F.lit("directory").alias("kind"), F.lit(None).cast("long").alias("size"))))
