"""Queries of text forms, sources of lines, patches, orders of paths, constraints, time limits, changes and git states, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marksheet.functions import scores as S
from marksheet.functions import text as X
from marksheet.operators import events as EV
from marksheet.operators import history as H
from marksheet.operators import patches as P
from marksheet.operators import structure as ST

from . import adapters as A
from .queries import query


@query(r"""WITH s AS (SELECT doc_id, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s, text[1:60] AS t FROM documents)
SELECT doc_id, CASE WHEN length(s) <= 300 THEN s ELSE regexp_replace(s[1:299], '\s+$', '') || '…' END AS excerpt, replace(replace(replace(replace(t, chr(13), '␍'), chr(10), '↵'), chr(9), '→'), ' ', '·') AS shown FROM s""")
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.table(spark, sf_dir, "documents").select("doc_id", X.excerpt(F.col("text")).alias("excerpt"), X.visible(F.substring("text", 1, 60)).alias("shown"))


_ODD_PATHS = "odd AS (SELECT project_id, CASE length(path) % 7 WHEN 0 THEN '/' || path WHEN 1 THEN 'C:' || path WHEN 2 THEN path || '/../x' WHEN 3 THEN 'aux.' || path WHEN 4 THEN path || '/Con' ELSE path END AS path FROM tree)"


@query(f"WITH {A.TREE}, {_ODD_PATHS} SELECT project_id, path, path[1] = '/' OR path[2] = ':' OR contains(path, '..') OR path[1:4] = 'aux.' OR path[-3:] = 'Con' AS unsafe FROM odd")
def unsafe_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, p = F.length("path") % 7, F.col("path")
    odd = F.when(n == 0, F.concat(F.lit("/"), p)).when(n == 1, F.concat(F.lit("C:"), p)).when(n == 2, F.concat(p, F.lit("/../x"))).when(n == 3, F.concat(F.lit("aux."), p)).when(n == 4, F.concat(p, F.lit("/Con"))).otherwise(p)
    rows = A.tree(spark, sf_dir).select("project_id", odd.alias("path"))
    return rows.withColumn("unsafe", X.unsafe_path(F.col("path")))


@query(f"WITH {A.TREE} SELECT project_id, path, row_number() OVER (PARTITION BY project_id ORDER BY list_transform(string_split(path, '/'), lambda x: struct_pack(lower := lower(x), x := x))) AS place FROM tree")
def tree_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.ordered_tree(A.tree(spark, sf_dir)).select("project_id", "path", "place")


@query("SELECT event_id, greatest(0.1::DOUBLE, least(60.0::DOUBLE, CASE WHEN event_id % 4 = 0 THEN value % 9 ELSE value END)) AS seconds FROM events")
def effective_timeouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = A.table(spark, sf_dir, "events").select("event_id", "value", F.when(F.col("event_id") % 4 == 0, 5.0).otherwise(F.when(F.col("value") != 5.0, F.col("value"))).alias("asked"), (F.col("value") % 9).alias("setting"))
    return events.select("event_id", S.effective_timeout(F.coalesce("asked", "value"), F.col("setting")).alias("seconds"))


@query("""WITH g AS (SELECT s_suppkey AS subject_id, CASE WHEN s_nationkey % 3 > 0 THEN 'len,n' || s_nationkey END AS allowed, ['abs', 'f' || (s_nationkey % 4)] AS forbidden FROM supplier),
o AS (SELECT p_partkey % 50 AS subject_id, p_partkey AS exercise_id, CASE p_size % 4 WHEN 0 THEN 'print' WHEN 1 THEN '' END AS allowed, CASE WHEN p_size % 5 > 0 THEN ['f' || (p_size % 4), 'eval'] END AS forbidden FROM part)
SELECT g.subject_id, o.exercise_id, coalesce(o.allowed, g.allowed) AS allowed, array_to_string(list_sort(list_distinct(g.forbidden || coalesce(o.forbidden, []))), ',') AS forbidden FROM g LEFT JOIN o USING (subject_id)""")
def merged_constraints(spark: SparkSession, sf_dir: str) -> DataFrame:
    n, k = F.col("s_nationkey"), F.col("p_size")
    general = A.table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("subject_id"), F.when(n % 3 > 0, F.array(F.lit("len"), F.concat(F.lit("n"), n.cast("string")))).alias("allowed"), F.array(F.lit("abs"), F.concat(F.lit("f"), (n % 4).cast("string"))).alias("forbidden"))
    nothing = F.expr("cast(array() as array<string>)")
    own = A.table(spark, sf_dir, "part").select((F.col("p_partkey") % 50).alias("subject_id"), F.col("p_partkey").alias("exercise_id"), F.when(k % 4 == 0, F.array(F.lit("print"))).when(k % 4 == 1, nothing).alias("allowed"), F.when(k % 5 > 0, F.array(F.concat(F.lit("f"), (k % 4).cast("string")), F.lit("eval"))).alias("forbidden"))
    text = lambda c: F.when(F.col(c).isNotNull(), F.array_join(c, ","))
    return ST.merge_constraints(general, own).select("subject_id", "exercise_id", text("allowed").alias("allowed"), text("forbidden").alias("forbidden"))


@query(f"""WITH {A.ANALYSES}, d AS (SELECT a.id AS pair_id, round_even(b.readiness - a.readiness, 1) AS readiness_delta FROM analyses a JOIN analyses b ON b.id = a.id + 7)
SELECT pair_id, readiness_delta, CASE WHEN readiness_delta = 0 THEN '±0' WHEN readiness_delta > 0 THEN printf('+%.1f', readiness_delta) ELSE printf('−%.1f', abs(readiness_delta)) END AS shown FROM d""")
def readiness_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    runs = A.analyses(spark, sf_dir)
    change = H.readiness_change(runs.select(F.col("id").alias("pair_id"), "readiness"), runs.select((F.col("id") - 7).alias("pair_id"), "readiness"))
    return change.withColumn("shown", S.delta_text(F.col("readiness_delta")))


_GIT = "g AS (SELECT user_id AS project_id, event_id AS n, event_id % 7 AS k, CASE WHEN event_id % 3 = 0 THEN 'a b/' ELSE '' END || 'f' || event_id AS f FROM events)"


@query(f"""WITH {_GIT}, s AS (SELECT project_id, f AS path, unnest(CASE k WHEN 0 THEN ['staged'] WHEN 1 THEN ['untracked'] WHEN 2 THEN ['ignored'] WHEN 3 THEN ['staged', 'modified'] WHEN 4 THEN ['modified', 'staged'] WHEN 5 THEN ['modified'] ELSE [] END) AS state FROM g) SELECT * FROM s""")
def git_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events as the records of a status, joined to one output for each user; a rename's old path looks like a rename."""
    return ST.parse_git_status(_git_output(spark, sf_dir))


@query(f"WITH {_GIT} SELECT project_id, arg_max('oid' || n, n) FILTER (WHERE k = 6) AS oid, NULL::VARCHAR AS head FROM g GROUP BY ALL")
def git_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ST.git_heads(_git_output(spark, sf_dir))


def _git_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("event_id")
    k, f = n % 7, F.concat(F.when(n % 3 == 0, "a b/").otherwise(""), F.lit("f"), n.cast("string"))
    record = lambda head: F.concat(F.lit(head), f)
    rec = (
        F.when(k == 0, record("1 M. N... 100644 100644 100644 aa bb ")).when(k == 1, record("? ")).when(k == 2, record("! "))
        .when(k == 3, F.concat(record("2 RM N... 100644 100644 100644 aa bb R100 "), F.lit("\0" + "2 old name")))
        .when(k == 4, record("u UU N... 100644 100644 100644 100644 aa bb cc ")).when(k == 5, record("1 .M N... 100644 100644 100644 aa bb "))
        .otherwise(F.concat(F.lit("# branch.oid oid"), n.cast("string"), F.lit("\0# branch.head (detached)")))
    )
    rows = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("project_id"), F.struct(n.alias("n"), rec.alias("rec")).alias("r"))
    return rows.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list("r")), lambda r: r["rec"]), "\0").alias("raw"))


_PATCHES = r"""src AS (SELECT doc_id, regexp_split_to_array(text, '\r\n|\r|\n') AS l, text FROM documents WHERE text <> ''), f AS (SELECT doc_id, CASE WHEN l[-1] = '' THEN l[:-2] ELSE l END AS l, l[-1] <> '' AS open FROM src),
lines AS (SELECT doc_id, unnest(range(1, len(l) + 1)) AS line, unnest(l) AS text, len(l) AS n, open FROM f), ch AS (SELECT doc_id, line, 'new ' || line AS new, greatest(1, line - 1) AS a, least(n, line + 1) AS b FROM lines WHERE (line * 7 + doc_id) % 5 = 0),
g AS (SELECT *, coalesce(a > max(b) OVER (PARTITION BY doc_id ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + 1, true)::INT AS s FROM ch), h AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY line) AS hunk FROM g),
hunks AS (SELECT doc_id, hunk, min(a) AS a, max(b) AS b FROM h GROUP BY ALL), body AS (SELECT k.doc_id, k.hunk, k.a, k.b, l.line, CASE WHEN c.new IS NULL THEN ' ' || l.text || eof ELSE '-' || l.text || eof || chr(10) || '+' || c.new || eof END AS t
  FROM hunks k JOIN (SELECT *, CASE WHEN open AND line = n THEN chr(10) || '\ No newline at end of file' ELSE '' END AS eof FROM lines) l ON l.doc_id = k.doc_id AND l.line BETWEEN k.a AND k.b LEFT JOIN ch c ON c.doc_id = l.doc_id AND c.line = l.line),
p AS (SELECT doc_id, hunk, '@@ -' || a || CASE WHEN b > a THEN ',' || (b - a + 1) ELSE '' END || ' +' || a || CASE WHEN b > a THEN ',' || (b - a + 1) ELSE '' END || ' @@' || chr(10) || string_agg(t, chr(10) ORDER BY line) AS t FROM body GROUP BY doc_id, hunk, a, b),
patches AS (SELECT doc_id, '--- a/d' || doc_id || chr(10) || '+++ b/d' || doc_id || chr(10) || string_agg(t, chr(10) ORDER BY hunk) || chr(10) AS patch FROM p GROUP BY doc_id)"""


def _patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("file_id"), F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("path"), F.col("text").alias("source"))
    lines = P.file_lines(files).where((F.col("line") * 7 + F.col("file_id")) % 5 == 0)
    return P.write_patches(files, lines.select("file_id", "line", F.concat(F.lit("new "), F.col("line").cast("string")).alias("new")))


@query(f"WITH {_PATCHES} SELECT doc_id, patch FROM patches")
def written_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(spark, sf_dir).select(F.col("file_id").alias("doc_id"), "patch")


@query(f"""WITH {_PATCHES} SELECT c.doc_id, count(*) FILTER (WHERE TRUE) AS lines, count(c.new) AS added, min(CASE WHEN c.new IS NOT NULL THEN b.line END) AS first_changed, max(b.line) AS last_line FROM body b JOIN (SELECT b.doc_id, b.line, c.new FROM body b LEFT JOIN ch c USING (doc_id, line)) c ON c.doc_id = b.doc_id AND c.line = b.line GROUP BY c.doc_id""")
def read_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each patch read back: lines of the old file that it shows, lines added, the first that changed, the last shown."""
    rows = P.parse_patches(_patches(spark, sf_dir).select(F.col("file_id").alias("patch_id"), "patch"))
    kind = F.col("kind")
    return rows.groupBy(F.col("patch_id").alias("doc_id")).agg(F.count("old_no").alias("lines"), F.count_if(kind == "add").alias("added"), F.min(F.when(kind == "del", F.col("old_no"))).alias("first_changed"), F.max("old_no").alias("last_line"))


_STREAMS = """io AS (SELECT user_id AS job_id, event_id AS seq, CASE WHEN event_type = 'purchase' THEN 'input' ELSE 'output' END AS kind, props || CASE WHEN event_id % 3 = 0 THEN chr(10) ELSE '' END AS text FROM events),
o AS (SELECT *, sum(length(text)) OVER (PARTITION BY job_id ORDER BY seq) AS e, sum(length(text)) OVER (PARTITION BY job_id ORDER BY seq) - length(text) AS b FROM io WHERE kind = 'output'),
outs AS (SELECT job_id, string_agg(CASE WHEN job_id % 4 = 1 AND seq % 11 = 5 THEN upper(text) ELSE text END, '' ORDER BY seq) AS stdout FROM o GROUP BY job_id),
fine AS (SELECT job_id, seq, b, e FROM (SELECT o.*, bool_and(stdout[b + 1:e] = text) OVER (PARTITION BY job_id ORDER BY seq) AS ok FROM o JOIN outs USING (job_id)) WHERE ok)"""


def _streams(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """events as what jobs print; of some jobs the output differs from what the events say."""
    n = F.col("event_id")
    io = A.table(spark, sf_dir, "events").select(F.col("user_id").alias("job_id"), n.alias("seq"), F.when(F.col("event_type") == "purchase", "input").otherwise("output").alias("kind"), F.concat("props", F.when(n % 3 == 0, "\n").otherwise("")).alias("text"))
    told = F.when((F.col("job_id") % 4 == 1) & (F.col("seq") % 11 == 5), F.upper("text")).otherwise(F.col("text"))
    outs = io.where("kind = 'output'").groupBy("job_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", told.alias("text")))), lambda x: x["text"]), "").alias("stdout"))
    return io, outs


@query(f"WITH {_STREAMS} SELECT job_id, seq, b::BIGINT AS start_off, e::BIGINT AS end_off FROM fine")
def consistent_offsets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return EV.consistent_offsets(*_streams(spark, sf_dir)).select("job_id", "seq", "start_off", "end_off")


@query(f"""WITH {_STREAMS}, l AS (SELECT job_id, unnest(range(1, len(x) + 1)) AS n, unnest(x) AS part FROM (SELECT job_id, regexp_extract_all(stdout, '[^\n]*\n|[^\n]+$') AS x FROM outs)),
s AS (SELECT *, coalesce(sum(length(part)) OVER (PARTITION BY job_id ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM l),
p AS (SELECT *, start + CASE WHEN n % 2 = 0 THEN CASE WHEN n % 4 = 0 AND least(n, length(part)) > 0 THEN least(n, length(part)) - 1 ELSE least(n, length(part)) END ELSE 0 END AS edit FROM s)
SELECT job_id, n AS actual_lineno, coalesce((SELECT max(seq) FROM fine f WHERE f.job_id = p.job_id AND f.b <= p.edit AND p.edit < f.e), (SELECT max(seq) FROM fine f WHERE f.job_id = p.job_id AND f.b <= p.start AND p.start < f.e)) AS event_seq FROM p""")
def line_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second line differs from some character on, every fourth lacks what was expected there."""
    io, outs = _streams(spark, sf_dir)
    lines = outs.select("job_id", F.posexplode(X.lines_kept(F.col("stdout"))).alias("k", "actual")).withColumn("actual_lineno", F.col("k") + 1)
    n, cut = F.col("actual_lineno"), F.least("actual_lineno", F.length("actual"))
    seg = lambda op, expected, actual: F.struct(F.lit(op).alias("op"), expected.alias("expected"), actual.alias("actual"))
    head, tail = F.substr("actual", F.lit(1), cut), F.substr("actual", cut + 1)
    segments = F.when(n % 4 == 0, F.array(seg("equal", head, head), seg("delete", F.lit("x"), F.lit("")), seg("equal", tail, tail))).otherwise(F.array(seg("equal", head, head), seg("replace", F.lit("x"), tail)))
    diff = lines.select("job_id", "actual_lineno", "actual", F.when(n % 2 == 0, "changed").otherwise("equal").alias("op"), segments.alias("segments"))
    return EV.line_sources(diff, io, outs).select("job_id", "actual_lineno", "event_seq")
