"""Queries of grounding, near misses, printed texts, roots and outlines over the driver's tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from marksheet.operators import grounding as G
from marksheet.operators import outlines as O
from marksheet.operators import roots as R
from marksheet.operators import similar_names as N
from marksheet.operators import source_map as M

from marksheet.sources.tables import spread

from . import adapters as A
from .queries import query

# ---------------------------------------------------------------- grounding

_BOUNDED = r"""'(?s)^(.*?(?:^|[^\pL\pN_]))' || array_to_string(string_split({p}, ''), '\s*') || '(?:$|[^\pL\pN_])'"""
_ITEMS = r"""w AS (SELECT doc_id, text, string_split(text, ' ') AS w FROM documents), ok AS (SELECT * FROM w WHERE regexp_full_match(w[3] || w[5] || w[6] || w[7] || w[8], '[A-Za-z]+') AND len(list_filter([w[3], w[5], w[6], w[7], w[8]], lambda x: x = '')) = 0),
items AS (SELECT doc_id, text, w[5] || w[6] AS p, NULL AS q, 0 AS item_id, NULL::VARCHAR[] AS seq FROM ok UNION ALL SELECT doc_id, text, w[6] || w[5], w[7], 1, NULL FROM ok
  UNION ALL SELECT doc_id, text, NULL, NULL, 2, [w[3], w[6], w[8]] FROM ok UNION ALL SELECT doc_id, text, NULL, NULL, 3, [w[8], w[3], w[6]] FROM ok)"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a spec of each document could claim: two words side by side, turned round, and three in order."""
    w = lambda k: F.get("w", k)
    docs = A.table(spark, sf_dir, "documents").select("doc_id", F.split("text", " ").alias("w")).where(F.forall(F.array(w(2), w(4), w(5), w(6), w(7)), lambda x: F.coalesce(x.rlike(r"\A[A-Za-z]+\z"), F.lit(False))))
    kinds = [("first", [F.concat_ws("  ", w(4), w(5))]), ("first", [F.concat_ws(" ", w(5), w(4)), w(6)]), ("sequence", [w(2), w(5), w(7)]), ("sequence", [w(7), w(2), w(5)])]
    items = F.array(*[F.struct(F.lit(k).alias("item_id"), F.lit(kind).alias("kind"), F.array(*p).alias("phrases")) for k, (kind, p) in enumerate(kinds)])
    unknown = [F.lit("ai_extracted").alias("provenance"), F.lit(None).cast("int").alias("line"), F.lit(0.7).alias("confidence")]
    return docs.select(F.col("doc_id").alias("subject_id"), F.inline(items)).select("*", *unknown)


@query(rf"""WITH {_ITEMS}, c AS (SELECT *, regexp_replace(text, '\s', '', 'g') AS c FROM items), s AS (SELECT *, strpos(c, seq[1]) AS p1 FROM c), t AS (SELECT *, CASE WHEN p1 > 0 THEN p1 + nullif(strpos(substr(c, p1 + 1), seq[2]), 0) END AS p2 FROM s),
f AS (SELECT *, CASE WHEN regexp_matches(text, {_BOUNDED.format(p='p')}) THEN 0 WHEN regexp_matches(text, {_BOUNDED.format(p='q')}) THEN 1 WHEN strpos(substr(c, p2 + 1), seq[3]) > 0 THEN 0 END AS hit FROM t)
SELECT doc_id AS subject_id, item_id, hit IS NOT NULL AS found, hit AS found_phrase, CASE WHEN hit IS NULL THEN 'ai_extracted' ELSE 'explicit' END AS provenance, CASE WHEN hit = 0 THEN 0.9 WHEN hit = 1 THEN 0.8 ELSE 0.6 END AS confidence,
  CASE WHEN seq IS NULL AND hit IS NOT NULL THEN (SELECT length(x) - length(replace(x, chr(10), '')) + 1 FROM (SELECT CASE WHEN hit = 0 THEN regexp_extract(text, {_BOUNDED.format(p='p')}, 1) ELSE regexp_extract(text, {_BOUNDED.format(p='q')}, 1) END AS x)) END AS line
FROM f""")
def ground_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = G.ground_items(_items(spark, sf_dir), A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject_id"), "text"))
    return got.select("subject_id", "item_id", F.col("place").isNotNull().alias("found"), "found_phrase", "provenance", "confidence", F.when(F.col("kind") == "first", F.col("line")).alias("line"))


@query()
def ground_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A condition with its value, and what follows a word for otherwise, in every document."""
    items = _items(spark, sf_dir).where("item_id = 0").drop("item_id", "kind").withColumn("phrases", F.split(F.get("phrases", F.lit(0)), "  "))
    kinds = F.array(F.struct(F.lit(0).alias("item_id"), F.lit("pair").alias("kind")), F.struct(F.lit(1).alias("item_id"), F.lit("otherwise").alias("kind")))
    got = G.ground_items(items.select("*", F.inline(kinds)), A.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("subject_id"), "text"))
    return got.select("subject_id", "item_id", "kind", "place", "line", "provenance", "confidence")


# ---------------------------------------------------------------- near misses

_NAMES = """names AS (SELECT DISTINCT p_partkey // 40 AS group_id, CASE p_partkey % 4 WHEN 0 THEN upper(n) WHEN 1 THEN n[1:2] || n[4:] WHEN 2 THEN n || '_' || (p_partkey % 3) ELSE n[2:2] || n[1:1] || n[3:] END AS name FROM (SELECT p_partkey, replace(p_name, ' ', '_') AS n FROM part)),
cands AS (SELECT p_partkey // 40 AS group_id, lower(c) AS other, arg_min(c, p_partkey) AS candidate FROM (SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN replace(p_name, ' ', '_') ELSE replace(p_name, ' ', '') || p_size END AS c FROM part) GROUP BY ALL)"""


def _names(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """part names as functions that a subject asks for, with slips, and as those that modules define."""
    p = A.table(spark, sf_dir, "part").withColumn("n", F.replace("p_name", F.lit(" "), F.lit("_"))).withColumn("group_id", F.floor(F.col("p_partkey") / 40))
    k, n = F.col("p_partkey"), F.col("n")
    cut = lambda a, size=10_000: F.substring(n, a, size)
    slip = F.when(k % 4 == 0, F.upper(n)).when(k % 4 == 1, F.concat(cut(1, 2), cut(4))).when(k % 4 == 2, F.concat(n, F.lit("_"), (k % 3).cast("string"))).otherwise(F.concat(cut(2, 1), cut(1, 1), cut(3)))
    have = F.when(k % 2 == 0, n).otherwise(F.concat(F.replace("p_name", F.lit(" "), F.lit("")), F.col("p_size").cast("string")))
    return p.select("group_id", slip.alias("name")), p.select("group_id", have.alias("candidate"), k.alias("pos"))


@query(f"""WITH {_NAMES}, pairs AS (SELECT group_id, name, lower(name) AS low, other, candidate FROM names JOIN cands USING (group_id)),
b AS (SELECT *, (length(low) + length(other))::DOUBLE AS t, list_sum(list_transform(list_distinct(string_split(low, '')), lambda c: least(length(low) - length(replace(low, c, '')), length(other) - length(replace(other, c, ''))))) AS m FROM pairs)
SELECT group_id, name, low, other, candidate FROM b WHERE 2.0::DOUBLE * least(length(low), length(other)) / t >= 0.8::DOUBLE AND 2.0::DOUBLE * m / t >= 0.8::DOUBLE""")
def near_miss_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.candidate_pairs(*_names(spark, sf_dir), N.FUNCTION_CUTOFF)


@query()
def near_misses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return N.near_misses(*_names(spark, sf_dir))


# ---------------------------------------------------------------- printed texts

_PRINTED = """lits AS (SELECT p_partkey // 40 AS module_id, p_partkey AS pos, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || ': {}' WHEN 2 THEN 'Enter ' || p_name ELSE p_type END AS value, p_size AS line, CASE WHEN p_partkey % 3 = 0 THEN 'print' END AS in_call, p_partkey % 8 = 1 AS is_template FROM part),
texts AS (SELECT p_partkey AS text_id, p_partkey // 40 AS module_id, CASE p_partkey % 5 WHEN 0 THEN p_name WHEN 1 THEN p_name || ': ' || p_size WHEN 2 THEN upper(p_name) WHEN 3 THEN 'The ' || p_name || ' is ready' ELSE p_name[1:3] END AS text FROM part)"""


@query(f"""WITH {_PRINTED}, pairs AS (SELECT *, replace(value, '{{}}', '') AS fixed, coalesce(in_call, '') = 'print' AS io, lower(text) AS lt, lower(replace(value, '{{}}', '')) AS lf FROM texts JOIN lits USING (module_id)),
scored AS (SELECT *, CASE WHEN value = text THEN 5 WHEN is_template AND starts_with(text, fixed) THEN 4 WHEN contains(value, text) THEN 3 WHEN length(trim(fixed)) >= 4 AND contains(text, fixed) THEN 2 ELSE 1 END AS tier,
  coalesce(list_max(list_transform(range(1, length(lf) - 2), lambda i: list_max(list_transform(range(4, length(lf) - i + 2), lambda n: CASE WHEN contains(lt, lf[i:i + n - 1]) THEN n ELSE 0 END)))), 0) AS common FROM pairs),
n AS (SELECT *, CASE tier WHEN 5 THEN length(value) WHEN 4 THEN length(value) WHEN 3 THEN -length(value) WHEN 2 THEN length(fixed) ELSE common END AS n FROM scored WHERE tier > 1 OR common >= 4)
SELECT text_id, module_id, pos, tier, io::INT AS io, n, line FROM n QUALIFY row_number() OVER (PARTITION BY text_id ORDER BY tier DESC, io DESC, n DESC, line, pos) = 1""")
def printed_literals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p, k, name = A.table(spark, sf_dir, "part"), F.col("p_partkey"), F.col("p_name")
    module = F.floor(k / 40).alias("module_id")
    value = F.when(k % 4 == 0, name).when(k % 4 == 1, F.concat(name, F.lit(": {}"))).when(k % 4 == 2, F.concat(F.lit("Enter "), name)).otherwise(F.col("p_type"))
    text = F.when(k % 5 == 0, name).when(k % 5 == 1, F.concat(name, F.lit(": "), F.col("p_size").cast("string"))).when(k % 5 == 2, F.upper(name)).when(k % 5 == 3, F.concat(F.lit("The "), name, F.lit(" is ready"))).otherwise(F.substring(name, 1, 3))
    literals = p.select(module, k.alias("pos"), value.alias("value"), F.col("p_size").alias("line"), F.when(k % 3 == 0, "print").alias("in_call"), (k % 8 == 1).alias("is_template"))
    return M.locate_texts(p.select(k.alias("text_id"), module, text.alias("text")), literals)


# ---------------------------------------------------------------- roots

_SNAPSHOTS = """base AS (SELECT p_partkey // 40 AS project_id, (['', 'repo/', 'a/b/', 'src/'])[p_partkey // 40 % 4 + 1] AS loc, (['src', 'src/util', 'app'])[p_partkey % 3 + 1] || '/m' || (p_partkey % 7) || '.py' AS file FROM part),
files AS (SELECT DISTINCT project_id, loc || file AS path FROM base UNION SELECT project_id, 'copy/' || file FROM base WHERE project_id % 3 = 0),
snap AS (SELECT project_id, path, 'file' AS kind FROM files UNION SELECT project_id, unnest(list_transform(range(1, len(string_split(path, '/'))), lambda n: array_to_string(string_split(path, '/')[1:n], '/'))), 'directory' FROM files
  UNION SELECT project_id, CASE WHEN project_id % 10 = 0 THEN '.git' ELSE loc || 'src/.git' END, 'directory' FROM base WHERE project_id % 5 = 0),
want(path, kind) AS (VALUES ('src/m1.py', 'file'), ('src/util/m3.py', 'file'), ('src/m4.py', 'file'), ('app/m2.py', 'file'), ('src', 'directory'), ('doc/x.txt', 'file'))"""


@query(f"""WITH {_SNAPSHOTS}, tree AS (SELECT * FROM snap UNION SELECT DISTINCT project_id, '', 'directory' FROM snap), pre(prefix) AS (VALUES (''), ('src/'), ('src/util/'), ('app/'), ('doc/')),
roots AS (SELECT project_id, path AS root, CASE WHEN path = '' THEN 0 ELSE len(string_split(path, '/')) END AS depth, EXISTS (SELECT 1 FROM snap g WHERE g.project_id = t.project_id AND g.path = CASE WHEN t.path = '' THEN '.git' ELSE t.path || '/.git' END) AS git
  FROM tree t WHERE kind = 'directory' AND (path = '' OR (len(string_split(path, '/')) <= 3 AND NOT list_contains(string_split(path, '/'), '.git')))),
asked AS (SELECT r.*, p.prefix, w.path, w.kind, (p.prefix = '' OR starts_with(w.path, p.prefix) OR w.path || '/' = p.prefix) AS under, CASE WHEN w.path || '/' = p.prefix THEN '' WHEN p.prefix <> '' AND starts_with(w.path, p.prefix) THEN w.path[length(p.prefix) + 1:] ELSE w.path END AS rest
  FROM roots r CROSS JOIN pre p CROSS JOIN want w WHERE NOT r.git OR p.prefix = ''),
opt AS (SELECT a.project_id, a.root, a.depth, a.git, a.prefix, count(*) FILTER (WHERE under AND t.path IS NOT NULL) AS matched FROM asked a LEFT JOIN tree t ON t.project_id = a.project_id AND t.kind = a.kind AND t.path = CASE WHEN a.root = '' THEN a.rest WHEN a.rest = '' THEN a.root ELSE a.root || '/' || a.rest END
  GROUP BY ALL HAVING count(*) FILTER (WHERE NOT under AND t.path IS NOT NULL) = 0),
best AS (SELECT * FROM opt QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY matched DESC, length(prefix), depth, root) = 1), bgit AS (SELECT * FROM opt WHERE git AND matched > 0 QUALIFY row_number() OVER (PARTITION BY project_id ORDER BY matched DESC, depth, root) = 1),
around AS (SELECT b.project_id, arg_max(r.root, length(r.root)) AS root FROM best b JOIN roots r ON r.project_id = b.project_id AND r.git AND (r.root = '' OR b.root = r.root OR starts_with(b.root, r.root || '/')) GROUP BY ALL),
pick AS (SELECT b.project_id, coalesce(g.root, CASE WHEN b.matched > 0 THEN a.root END, b.root) AS root, coalesce(g.prefix, CASE WHEN b.matched > 0 AND a.root IS NOT NULL THEN '' END, b.prefix) AS strip_prefix, coalesce(g.matched, CASE WHEN b.matched > 0 AND a.root IS NOT NULL THEN 0 END, b.matched) AS matched
  FROM best b LEFT JOIN bgit g USING (project_id) LEFT JOIN around a USING (project_id))
SELECT p.project_id, p.root, strip_prefix, p.matched, 6::BIGINT AS expected, p.matched > 0 AND strip_prefix = '' AND 2 * p.matched >= 6 AND NOT EXISTS (SELECT 1 FROM opt o WHERE o.project_id = p.project_id AND o.matched = p.matched AND o.prefix = p.strip_prefix AND o.root <> p.root)
  AND (NOT EXISTS (SELECT 1 FROM roots r WHERE r.project_id = p.project_id AND r.git) OR EXISTS (SELECT 1 FROM roots r WHERE r.project_id = p.project_id AND r.git AND r.root = p.root)) AS confident FROM pick p""")
def detected_roots(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    pick = lambda names, n: F.element_at(F.array(*map(F.lit, names)), (n + 1).cast("int"))
    base = A.table(spark, sf_dir, "part").select(F.floor(k / 40).alias("project_id"), pick(["", "repo/", "a/b/", "src/"], F.floor(k / 40) % 4).alias("at"), F.concat(pick(["src", "src/util", "app"], k % 3), F.lit("/m"), (k % 7).cast("string"), F.lit(".py")).alias("file"))
    p = F.col("project_id")
    files = base.select("project_id", F.concat("at", "file").alias("path")).union(base.where(p % 3 == 0).select("project_id", F.concat(F.lit("copy/"), "file"))).distinct().withColumn("kind", F.lit("file"))
    git = base.where(p % 5 == 0).select("project_id", F.when(p % 10 == 0, ".git").otherwise(F.concat("at", F.lit("src/.git"))).alias("path")).distinct()
    tree = files.transform(A.with_folders).unionByName(git.withColumn("kind", F.lit("directory"))).distinct()
    expected = [("src/m1.py", "file"), ("src/util/m3.py", "file"), ("src/m4.py", "file"), ("app/m2.py", "file"), ("src", "directory"), ("doc/x.txt", "file")]
    wanted = F.inline(F.array(*[F.struct(F.lit(path).alias("path"), F.lit(kind).alias("kind")) for path, kind in expected]))
    return R.detect_roots(tree, tree.select("project_id").distinct().select("project_id", wanted)).drop("note")


# ---------------------------------------------------------------- outlines

_LINES = """lines AS (SELECT l_orderkey AS doc_id, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) AS pos, (l_partkey % 4)::INT AS k, (l_suppkey % 3)::INT AS m, l_partkey AS n FROM lineitem)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as documents, their items as lines in an order of their own."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    return spread(A.table(spark, sf_dir, "lineitem"), "l_orderkey").select(F.col("l_orderkey").alias("doc_id"), F.row_number().over(order).alias("pos"), (F.col("l_partkey") % 4).cast("int").alias("k"), (F.col("l_suppkey") % 3).cast("int").alias("m"), F.col("l_partkey").alias("n"))


@query(f"""WITH {_LINES}, b AS (SELECT doc_id, pos, m > 0 AS heading, k + 1 AS level, 't' || n AS text FROM lines), h AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY pos) AS nth, count(*) FILTER (WHERE level = 1) OVER (PARTITION BY doc_id) AS tops FROM b WHERE heading),
e AS (SELECT * FROM h WHERE NOT (nth = 1 AND level = 1 AND tops = 1)), t AS (SELECT * FROM h WHERE nth = 1 AND level = 1 AND tops = 1),
open AS (SELECT r.doc_id, r.pos, string_agg(e.text, ' > ' ORDER BY e.pos) AS path FROM b r JOIN e ON e.doc_id = r.doc_id AND e.pos <= r.pos WHERE NOT EXISTS (SELECT 1 FROM e f WHERE f.doc_id = e.doc_id AND f.pos > e.pos AND f.pos <= r.pos AND f.level <= e.level) GROUP BY ALL)
SELECT b.doc_id, b.pos, coalesce(t.text, open.path, '') AS section FROM b LEFT JOIN open USING (doc_id, pos) LEFT JOIN t USING (doc_id, pos)""")
def section_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks = _lines(spark, sf_dir).select("doc_id", "pos", F.when(F.col("m") > 0, "heading").otherwise("paragraph").alias("kind"), F.when(F.col("m") > 0, F.col("k") + 1).alias("level"), F.concat(F.lit("t"), F.col("n").cast("string")).alias("text"))
    return O.heading_sections(blocks).select("doc_id", "pos", "section")


@query(f"""WITH {_LINES}, b AS (SELECT doc_id, pos, k * 2 + m AS width, 'n' || n || CASE WHEN n % 5 = 0 THEN '/' ELSE '' END AS name FROM lines), c AS (SELECT *, rtrim(name, '/') AS clean, coalesce(lead(width) OVER (PARTITION BY doc_id ORDER BY pos) > width, false) AS has_children FROM b),
up AS (SELECT r.doc_id, r.pos, string_agg(e.clean, '/' ORDER BY e.pos) AS path FROM c r JOIN c e ON e.doc_id = r.doc_id AND e.pos < r.pos AND e.width < r.width WHERE NOT EXISTS (SELECT 1 FROM c f WHERE f.doc_id = e.doc_id AND f.pos > e.pos AND f.pos < r.pos AND f.width <= e.width) GROUP BY ALL)
SELECT doc_id, pos, coalesce(up.path || '/', '') || clean AS path, name[-1:] = '/' OR has_children AS is_dir, has_children FROM c LEFT JOIN up USING (doc_id, pos)""")
def listing_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.concat(F.lit("n"), F.col("n").cast("string"), F.when(F.col("n") % 5 == 0, "/").otherwise(""))
    return O.listing_paths(_lines(spark, sf_dir).select("doc_id", "pos", (F.col("k") * 2 + F.col("m")).alias("width"), name.alias("name"))).select("doc_id", "pos", "path", "is_dir", "has_children")


@query(f"""WITH {_LINES}, s AS (SELECT doc_id, pos, CASE WHEN pos = 1 AND m = 0 THEN 0 ELSE k + 1 END AS level, NOT (pos = 1 AND m = 0) AS heading, n % 3 = 0 AS file, n % 4 = 1 AS title, n % 29 = 3 AS body FROM lines),
a AS (SELECT *, max(CASE WHEN file THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS ref FROM s),
r AS (SELECT a.*, CASE WHEN a.file THEN 'exercise' WHEN a.ref IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s x, s e WHERE e.doc_id = a.doc_id AND e.pos = a.ref AND x.doc_id = a.doc_id AND x.pos > a.ref AND x.pos <= a.pos AND (NOT x.heading OR x.level <= e.level)) THEN 'part' ELSE 'other' END AS role FROM a),
o AS (SELECT *, max(CASE WHEN role = 'other' AND heading AND title THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS op FROM r)
SELECT doc_id, pos, role, CASE WHEN role <> 'other' THEN ref END AS exercise_pos, CASE WHEN role = 'exercise' THEN title OR body OR (op IS NOT NULL AND NOT EXISTS (SELECT 1 FROM s x, s e WHERE e.doc_id = o.doc_id AND e.pos = o.op AND x.doc_id = o.doc_id AND x.pos > o.op AND x.pos <= o.pos AND x.heading AND x.level <= e.level)) END AS bonus FROM o""")
def exercise_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    first, n = (F.col("pos") == 1) & (F.col("m") == 0), F.col("n")
    rows = _lines(spark, sf_dir).select("doc_id", "pos", F.when(first, 0).otherwise(F.col("k") + 1).alias("level"), (~first).alias("has_heading"), (n % 3 == 0).alias("has_file"), (n % 4 == 1).alias("bonus_title"), (n % 29 == 3).alias("bonus_body"))
    return O.exercise_sections(rows).select("doc_id", "pos", "role", "exercise_pos", "bonus")
