"""Queries of snapshots, with their SQL: orders are the listings of forty projects, one of which has a third of all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.sources import snapshots as SN
from marksheet.sources.tables import written

from . import adapters as A
from .queries import query

_FOLDERS = ["src", "src/util", "Src", "src/UTIL", ".git/objects", "node_modules/x", "__MACOSX", "docs", "lib/core", "lib", "a/venv/b", "tests"]
_LISTING = f"""l AS (SELECT CASE WHEN k % 3 = 0 THEN 0 ELSE c % 40 END AS project_id, k AS pos, CASE WHEN k % 13 = 0 THEN 'directory' ELSE 'file' END AS kind,
  CASE WHEN k % 31 = 0 THEN floor(t * 20) ELSE floor(t / 16) END::BIGINT AS size, {_FOLDERS}[(k * 7 + c) % 12 + 1] AS folder,
  CASE WHEN k % 97 = 0 THEN 'con.py' WHEN k % 89 = 0 THEN 'a?b:.py' WHEN k % 83 = 0 THEN 'end.' WHEN k % 79 = 0 THEN '.git' ELSE CASE WHEN k % 11 = 0 THEN 'M' ELSE 'm' END || ((c * 31 + k) % 6000) || '.py' END AS name,
  CASE WHEN c % 13 = 5 AND k % 101 = 0 THEN '../x' WHEN k % 13 = 0 OR k % 29 = 0 THEN folder WHEN k % 19 = 0 THEN './' || folder || '//m' || (k % 50) || '.py/deep.py' WHEN k % 17 = 0 THEN replace(folder || '/' || name, '/', chr(92)) ELSE folder || '/' || name END AS raw
  FROM (SELECT o_orderkey AS k, o_custkey AS c, o_totalprice AS t FROM orders)),
c AS (SELECT *, array_to_string(parts, '/') AS path, list_filter(CASE WHEN kind = 'directory' THEN parts ELSE parts[1:len(parts) - 1] END, lambda x: x IN ('.git', 'node_modules', 'venv', '__MACOSX'))[1] AS special
  FROM (SELECT project_id, pos, kind, size, raw, list_filter(string_split(replace(raw, chr(92), '/'), '/'), lambda x: x NOT IN ('', '.')) AS parts FROM l)),
a0 AS (SELECT *, NULL::VARCHAR AS clash, CASE WHEN special IN ('node_modules', 'venv') THEN array_to_string(parts[1:list_position(parts, special)], '/') END AS placeholder,
  CASE WHEN list_contains(parts, '..') THEN 'unsafe' WHEN name IN ('con.py', 'a?b:.py', 'end.') THEN 'skipped' WHEN special = '.git' THEN 'git' WHEN special IN ('node_modules', 'venv') THEN 'placeholder' WHEN special IS NOT NULL OR name = '.git' THEN 'skipped' END AS fate0,
  CASE WHEN list_contains(parts, '..') THEN 'escaping' WHEN name = 'con.py' THEN 'reserved device name ''CON'', not copied' WHEN name = 'a?b:.py' THEN 'character(s) : ? not allowed in file names, not copied' WHEN name = 'end.' THEN 'name ending with a space or a dot, not copied'
    WHEN special IN ('node_modules', 'venv') THEN 'dependency/cache folder, not copied' WHEN special = '__MACOSX' THEN 'archive metadata, not part of the project' WHEN special IS NULL AND name = '.git' THEN 'git link file pointing outside the project, not copied' END AS note0
  FROM (SELECT *, CASE WHEN kind <> 'directory' THEN parts[-1] ELSE '' END AS name FROM c))"""


def _stage(d: int) -> str:
    """Depth by depth: who owns a path among what is left, and what falls out there."""
    pre = f"array_to_string(parts[1:{d}], '/')"
    return f"""o{d} AS (SELECT project_id, lower({pre}) AS f, arg_min({pre}, pos) AS op, arg_min(len(parts) > {d} OR kind = 'directory', pos) AS ofolder, min(pos) AS opos FROM a{d - 1} WHERE fate0 IS NULL AND clash IS NULL AND len(parts) >= {d} GROUP BY ALL),
a{d} AS (SELECT a.* REPLACE (CASE WHEN fate0 IS NOT NULL OR clash IS NOT NULL OR len(parts) < {d} OR opos = pos THEN clash
  WHEN len(parts) > {d} THEN CASE WHEN op <> {pre} THEN 'folder ''' || {pre} || ''' differs only by letter case from ''' || op || '''' WHEN NOT ofolder THEN 'its parent ''' || {pre} || ''' is a file' END
  WHEN op <> path THEN 'differs only by letter case from ''' || op || '''' WHEN kind <> 'directory' OR NOT ofolder THEN 'duplicate entry' END AS clash) FROM a{d - 1} a LEFT JOIN o{d} o ON a.project_id = o.project_id AND lower({pre}) = f)"""


_ENTRIES = f"""{_LISTING}, {', '.join(_stage(d) for d in range(1, 5))},
e AS (SELECT project_id, pos, path, kind, size, placeholder, coalesce(fate0, CASE WHEN clash IS NOT NULL THEN 'conflict' WHEN kind = 'file' AND size > 5242880 THEN 'too_large' ELSE 'keep' END) AS fate,
  coalesce(note0, CASE WHEN fate0 IS NOT NULL THEN NULL WHEN clash IS NOT NULL THEN clash || ', not copied' WHEN kind = 'file' AND size > 5242880 THEN printf('file too large: %.1f MB, limit 5 MB', size / 1048576) END) AS note FROM a4)"""
_ABOVE = "unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/')))"
_PROJECTS = f"""{_ENTRIES}, ab AS (SELECT project_id, pos, {_ABOVE} AS path FROM e WHERE fate = 'keep' OR (fate = 'git' AND kind = 'directory')
  UNION ALL SELECT project_id, pos, path FROM e WHERE kind = 'directory' AND fate IN ('keep', 'git')),
fd AS (SELECT project_id, path, min(pos) AS pos FROM ab GROUP BY ALL),
r AS (SELECT e.project_id, e.pos, sum(CASE WHEN fate = 'keep' AND kind = 'file' THEN 1 ELSE 0 END) OVER w AS nf, sum(CASE WHEN fate = 'keep' AND kind = 'file' THEN size ELSE 0 END) OVER w AS nb, sum(CASE WHEN fate = 'keep' AND kind = 'directory' AND fd.pos = e.pos THEN 1 ELSE 0 END) OVER w AS nd, fate
  FROM e LEFT JOIN fd USING (project_id, path) WINDOW w AS (PARTITION BY e.project_id ORDER BY e.pos)),
x AS (SELECT project_id, min(pos) AS at_pos, arg_min(CASE WHEN nf > 5000 THEN 'too_many_files' WHEN nb > 52428800 THEN 'too_large' WHEN nd > 5000 THEN 'too_many_folders' ELSE 'unsafe:escaping' END, pos) AS reason
  FROM r WHERE nf > 5000 OR nb > 52428800 OR nd > 5000 OR fate = 'unsafe' GROUP BY ALL),
k AS (SELECT e.project_id, string_split(path, '/')[1] AS top, count(*) AS n FROM e LEFT JOIN x USING (project_id) WHERE fate = 'keep' AND kind = 'file' AND (at_pos IS NULL OR pos <= at_pos) GROUP BY ALL),
h AS (SELECT project_id, string_agg(top || ':' || n, ', ' ORDER BY n DESC, top) AS heaviest FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, top) AS place FROM k) WHERE place <= 3 GROUP BY ALL),
pr AS (SELECT e.project_id, CASE WHEN x.reason IS NULL THEN 'ok' ELSE 'rejected' END AS status, x.reason, x.at_pos, count(*) FILTER (WHERE fate = 'keep' AND kind = 'file' AND (at_pos IS NULL OR pos <= at_pos)) AS files,
  coalesce(sum(size) FILTER (WHERE fate = 'keep' AND kind = 'file' AND (at_pos IS NULL OR pos <= at_pos)), 0)::BIGINT AS total_bytes, count(*) FILTER (WHERE fate = 'git' AND kind = 'file') AS git_files,
  count(*) FILTER (WHERE fate = 'git' AND kind = 'file') <= 20000 AND coalesce(sum(size) FILTER (WHERE fate = 'git' AND kind = 'file'), 0) <= 209715200 AS git_kept
  FROM e LEFT JOIN x USING (project_id) GROUP BY e.project_id, x.reason, x.at_pos)"""


def listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = A.table(spark, sf_dir, "orders")
    k, c, t = F.col("o_orderkey"), F.col("o_custkey"), F.col("o_totalprice")
    folder = F.element_at(F.array(*map(F.lit, _FOLDERS)), ((k * 7 + c) % 12 + 1).cast("int"))
    number = F.concat(F.when(k % 11 == 0, "M").otherwise("m"), ((c * 31 + k) % 6000).cast("string"), F.lit(".py"))
    path = F.concat(folder, F.lit("/"), F.when(k % 97 == 0, "con.py").when(k % 89 == 0, "a?b:.py").when(k % 83 == 0, "end.").when(k % 79 == 0, ".git").otherwise(number))
    deep = F.concat(F.lit("./"), folder, F.lit("//m"), (k % 50).cast("string"), F.lit(".py/deep.py"))
    raw = F.when((c % 13 == 5) & (k % 101 == 0), "../x").when((k % 13 == 0) | (k % 29 == 0), folder).when(k % 19 == 0, deep).when(k % 17 == 0, F.replace(path, F.lit("/"), F.lit("\\"))).otherwise(path)
    size = F.when(k % 31 == 0, F.floor(t * 20)).otherwise(F.floor(t / 16))
    return o.select(F.when(k % 3 == 0, 0).otherwise(c % 40).cast("long").alias("project_id"), k.alias("pos"), raw.alias("raw"), F.when(k % 13 == 0, "directory").otherwise("file").alias("kind"), size.cast("long").alias("size"))


def _entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return written(SN.snapshot_entries(listing(spark, sf_dir)), "snapshot-entries")


@query(f"WITH {_ENTRIES} SELECT * FROM e")
def snapshot_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SN.snapshot_entries(listing(spark, sf_dir))


@query(f"WITH {_PROJECTS} SELECT pr.*, CASE WHEN pr.reason IN ('too_many_files', 'too_large') THEN coalesce(heaviest, '') ELSE '' END AS heaviest FROM pr LEFT JOIN h USING (project_id)")
def snapshot_projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return SN.snapshot_projects(_entries(spark, sf_dir))


@query(f"""WITH {_PROJECTS}, ok AS (SELECT e.* FROM e JOIN pr USING (project_id) WHERE status = 'ok'),
hold AS (SELECT DISTINCT project_id, placeholder AS path FROM ok WHERE fate = 'placeholder'),
fo AS (SELECT project_id, path FROM ok WHERE fate = 'keep' AND kind = 'directory' UNION SELECT project_id, {_ABOVE} FROM ok WHERE fate = 'keep' OR (fate = 'git' AND kind = 'directory') UNION SELECT * FROM hold UNION SELECT project_id, {_ABOVE} FROM hold),
t AS (SELECT project_id, path, kind, size FROM ok WHERE fate = 'keep' AND kind = 'file' UNION ALL SELECT project_id, path, 'directory', NULL FROM fo WHERE NOT list_contains(string_split(path, '/'), '.git'))
SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY list_transform(string_split(path, '/'), lambda x: struct_pack(l := lower(x), x := x)))::INT AS place FROM t""")
def snapshot_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _entries(spark, sf_dir)
    return SN.snapshot_tree(entries, SN.snapshot_projects(entries))
