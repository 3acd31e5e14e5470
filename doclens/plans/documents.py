"""More queries over the driver's tables, each with its SQL: documents and their files, suggestions, reports, renames."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.functions import paths, refs, text
from doclens.operators import assets, diff, merkle, patch, plan, runs, snapshot, threads, tree
from doclens.plans.queries import LINES, TURNS, table, turn_pairs
from doclens.sources import readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return register


def number(c) -> F.Column:
    return c.cast("string")


# ---------------------------------------------------------------- scans


@query(
    """WITH t AS (SELECT doc_id, CASE WHEN doc_id % 3 > 0 THEN concat('---', chr(10), 'title: T', doc_id, chr(10), CASE WHEN doc_id % 3 = 1 THEN concat('id: gdocs:', doc_id, chr(10)) ELSE '' END, '---', chr(10), text) ELSE text END AS text FROM documents),
h AS (SELECT doc_id, text, regexp_extract(text, '^---\\n((?:[^\\n]*\\n)*?)---(?:\\n|$)') AS head FROM t)
SELECT doc_id, head <> '' AS has, nullif(regexp_extract(head, 'id: (gdocs:[0-9]+)', 1), '') AS id, nullif(regexp_extract(head, 'title: ([^\\n]*)', 1), '') AS title, substr(text, length(head) + 1) AS body FROM h"""
)
def document_heads(spark, sf_dir):
    n = F.col("doc_id")
    head = F.concat(F.lit("---\ntitle: T"), number(n), F.lit("\n"), F.when(n % 3 == 1, F.concat(F.lit("id: gdocs:"), number(n), F.lit("\n"))).otherwise(""), F.lit("---\n"))
    d = table(spark, sf_dir, "documents").select("doc_id", F.when(n % 3 > 0, F.concat(head, "text")).otherwise(F.col("text")).alias("text"))
    return d.select("doc_id", readers.front_matter(F.col("text")).alias("h")).select("doc_id", "h.has", "h.id", "h.title", "h.body")


@query(
    """SELECT c.c_custkey AS id, n.n_name AS editor_name, CASE WHEN n.n_nationkey IS NOT NULL THEN concat(lower(n.n_name), '@x.org') END AS editor_email
FROM customer c LEFT JOIN nation n ON n.n_nationkey = c.c_nationkey AND n.n_nationkey % 4 <> 0"""
)
def editors(spark, sf_dir):
    people = table(spark, sf_dir, "nation").where("n_nationkey % 4 <> 0").select(F.col("n_nationkey").alias("editor_id"), F.col("n_name").alias("name"), F.concat(F.lower("n_name"), F.lit("@x.org")).alias("email"))
    objects = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.col("c_nationkey").alias("editor_id"))
    return readers.with_editors(objects, people).select("id", "editor_name", "editor_email")


@query(
    """WITH b AS (SELECT user_id AS doc_id, event_id AS ord, CASE event_id % 6 WHEN 0 THEN 'image' WHEN 1 THEN 'file' WHEN 2 THEN 'video' ELSE 'paragraph' END AS type FROM events)
SELECT doc_id, ord, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS INT) AS position FROM b WHERE type IN ('image', 'file', 'video')"""
)
def hosted_files(spark, sf_dir):
    k = F.col("event_id") % 6
    b = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.col("event_id").alias("ord"), F.when(k == 0, "image").when(k == 1, "file").when(k == 2, "video").otherwise("paragraph").alias("type"))
    return assets.hosted(b).select("doc_id", "ord", "position")


@query(
    """WITH RECURSIVE t AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS tab FROM events),
n AS (SELECT doc, tab, CASE WHEN tab > 2 THEN tab // 3 END AS parent, lpad(CAST(99999 - tab AS VARCHAR), 10, '0') AS own FROM t),
d AS (SELECT doc, tab, own AS sort FROM n WHERE parent IS NULL UNION ALL SELECT n.doc, n.tab, concat(d.sort, '/', n.own) FROM d JOIN n ON n.doc = d.doc AND n.parent = d.tab)
SELECT CAST(doc AS VARCHAR) AS doc_id, CAST(tab AS VARCHAR) AS tab_id, CAST(row_number() OVER (PARTITION BY doc ORDER BY sort) - 1 AS INT) AS position FROM d"""
)
def tab_positions(spark, sf_dir):
    """Tabs before their children, siblings by a descending index."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    t = table(spark, sf_dir, "events").select(number(F.col("user_id")).alias("doc_id"), place.alias("tab"))
    tabs = t.select("doc_id", number(F.col("tab")).alias("tab_id"), F.when(F.col("tab") > 2, F.expr("cast(tab div 3 as string)")).alias("parent_tab"), (99999 - F.col("tab")).alias("index"), F.lit("t").alias("title"))
    return tree.tab_order(tabs).select("doc_id", "tab_id", "position")


# ---------------------------------------------------------------- files of documents


@query(
    """WITH p AS (SELECT p_partkey, CASE p_partkey % 2 WHEN 0 THEN 'notion' ELSE 'gdocs' END AS source, CASE p_partkey % 5 WHEN 0 THEN 0 ELSE p_size * 3000000000 // (1 + p_partkey % 3 * 2000) END AS size, CASE WHEN p_partkey % 3 = 0 THEN 'text/plain' ELSE 'image/png' END AS mime FROM part)
SELECT p_partkey, CASE WHEN size = 0 THEN 'empty file' WHEN source = 'notion' AND size > 5368709120 THEN 'too large for a block' WHEN source = 'gdocs' AND mime NOT LIKE 'image/%' THEN 'a text document takes images only'
  WHEN source = 'gdocs' AND size > 5242880 THEN 'too large for an image' END AS verdict FROM p"""
)
def upload_verdicts(spark, sf_dir):
    k = F.col("p_partkey")
    size = F.when(k % 5 == 0, F.lit(0).cast("long")).otherwise(F.expr("cast(p_size as bigint) * 3000000000 div (1 + p_partkey % 3 * 2000)"))
    p = table(spark, sf_dir, "part").select("p_partkey", F.when(k % 2 == 0, "notion").otherwise("gdocs").alias("source"), size.alias("size"), F.when(k % 3 == 0, "text/plain").otherwise("image/png").alias("mime"))
    return p.select("p_partkey", assets.upload_verdict(F.col("source"), F.col("size"), F.col("mime")).alias("verdict"))


@query(
    """SELECT doc_id, CASE doc_id % 7 WHEN 0 THEN 'image/png' WHEN 1 THEN 'image/jpeg' WHEN 2 THEN 'application/pdf' WHEN 3 THEN 'text/csv' WHEN 4 THEN 'image/svg+xml' ELSE 'application/octet-stream' END AS mime FROM documents"""
)
def mime_types(spark, sf_dir):
    """Content types of files of documents, by extensions in either case."""
    n = F.col("doc_id")
    k = n % 7
    ext = F.when(k == 0, ".PNG").when(k == 1, ".jpg").when(k == 2, ".tar.pdf").when(k == 3, ".csv").when(k == 4, ".Svg").when(k == 5, "/.png").otherwise("")
    return table(spark, sf_dir, "documents").select("doc_id", paths.mime_of(F.concat("source", F.lit("/"), number(n), ext)).alias("mime"))


@query(
    """WITH c AS (SELECT doc_id AS id, concat('d', doc_id % 7, '/', doc_id, '.png') AS path, CASE WHEN doc_id % 4 > 0 THEN concat('m', doc_id % 5) END AS mark FROM documents),
p AS (SELECT id, CASE WHEN id % 6 = 0 THEN concat('old/', path) ELSE path END AS path, CASE WHEN id % 9 = 0 THEN 'm9' ELSE mark END AS mark FROM c WHERE id % 8 <> 0)
SELECT c.id, c.path, c.mark FROM c LEFT JOIN p ON p.id = c.id WHERE p.id IS NULL OR p.path <> c.path OR p.mark IS DISTINCT FROM c.mark"""
)
def moved_assets(spark, sf_dir):
    n = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select(n.alias("id"), F.concat(F.lit("d"), number(n % 7), F.lit("/"), number(n), F.lit(".png")).alias("path"), F.when(n % 4 > 0, F.concat(F.lit("m"), number(n % 5))).alias("mark"))
    p = c.where("id % 8 <> 0").select("id", F.when(F.col("id") % 6 == 0, F.concat(F.lit("old/"), "path")).otherwise(F.col("path")).alias("path"), F.when(F.col("id") % 9 == 0, "m9").otherwise(F.col("mark")).alias("mark"))
    return assets.moved_assets(c, p)


@query(
    """WITH l AS (SELECT doc_id, concat('a/', doc_id, '.md') AS path, concat('g', (doc_id * 7) % 1500) AS target_id, concat('https://x.org/', doc_id) AS url FROM documents),
p AS (SELECT concat('g', doc_id) AS id, concat(CASE WHEN doc_id % 2 = 0 THEN 'a/' ELSE 'b/' END, doc_id, '.md') AS path FROM documents)
SELECT l.path, target_id, CASE WHEN p.path IS NULL THEN url WHEN starts_with(p.path, 'a/') THEN substr(p.path, 3) ELSE concat('../', p.path) END AS href FROM l LEFT JOIN p ON p.id = target_id"""
)
def resolved_links(spark, sf_dir):
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    links = d.select(F.concat(F.lit("a/"), number(n), F.lit(".md")).alias("path"), F.concat(F.lit("g"), number((n * 7) % 1500)).alias("target_id"), F.concat(F.lit("https://x.org/"), number(n)).alias("url"))
    pages = d.select(F.concat(F.lit("g"), number(n)).alias("id"), F.concat(F.when(n % 2 == 0, "a/").otherwise("b/"), number(n), F.lit(".md")).alias("path"))
    return assets.resolve_links(links, pages).select("path", "target_id", "href")


@query(
    """WITH i AS (SELECT concat('g', doc_id, CASE WHEN doc_id % 3 = 1 THEN '#t.1' ELSE '' END) AS id, CASE WHEN doc_id % 3 = 2 THEN concat('g', doc_id - 1) END AS document, concat(doc_id, '.md') AS path FROM documents)
SELECT id, document, path FROM i WHERE coalesce(document, split_part(id, '#', 1)) IN (SELECT concat('g', doc_id) FROM documents WHERE doc_id % 4 = 1)"""
)
def carried_rows(spark, sf_dir):
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents")
    index = d.select(F.concat(F.lit("g"), number(n), F.when(n % 3 == 1, "#t.1").otherwise("")).alias("id"), F.when(n % 3 == 2, F.concat(F.lit("g"), number(n - 1))).alias("document"), F.concat(number(n), F.lit(".md")).alias("path"))
    return assets.carry_over(d.where("doc_id % 4 = 1").select(F.concat(F.lit("g"), number(n)).alias("id")), index)


@query(
    """WITH f AS (SELECT concat('d', doc_id % 40) AS document, concat('f', doc_id % 90, '-', doc_id % 11) AS path, doc_id FROM documents),
e AS (SELECT document, path FROM f WHERE doc_id % 3 = 0 UNION SELECT document, path FROM f WHERE doc_id % 5 = 0)
SELECT document, string_agg(path, ',' ORDER BY path) AS assets FROM e WHERE path NOT IN (SELECT path FROM f WHERE doc_id % 11 = 0) GROUP BY document"""
)
def document_assets(spark, sf_dir):
    n = F.col("doc_id")
    f = table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("d"), number(n % 40)).alias("document"), F.concat(F.lit("f"), number(n % 90), F.lit("-"), number(n % 11)).alias("path"))
    index = f.where("doc_id % 5 = 0").select("document", "path", F.lit("asset").alias("type")).unionByName(f.select("document", F.concat(F.lit("page"), "path").alias("path"), F.lit("page").alias("type")))
    return assets.assets_of(f.where("doc_id % 3 = 0"), index, f.where("doc_id % 11 = 0")).select("document", F.array_join("assets", ",").alias("assets"))


@query(
    """SELECT doc_id, coalesce(concat(source, '/', doc_id) <> concat(CASE WHEN doc_id % 5 = 0 THEN 'x' ELSE source END, '/', doc_id), false) OR coalesce(concat('T', doc_id % 4) <> concat('T', CASE WHEN doc_id % 6 = 0 THEN NULL ELSE doc_id % 3 END), false) AS wanted FROM documents WHERE doc_id % 6 <> 0
UNION ALL SELECT doc_id, doc_id % 5 = 0 FROM documents WHERE doc_id % 6 = 0"""
)
def wanted_renames(spark, sf_dir):
    n = F.col("doc_id")
    new = F.concat("source", F.lit("/"), number(n))
    old = F.concat(F.when(n % 5 == 0, "x").otherwise(F.col("source")), F.lit("/"), number(n))
    source_title = F.when(n % 6 != 0, F.concat(F.lit("T"), number(n % 3)))
    return table(spark, sf_dir, "documents").select("doc_id", assets.rename_wanted(old, new, F.concat(F.lit("T"), number(n % 4)), source_title).alias("wanted"))


TABS = """t AS (SELECT user_id AS doc, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS tab, event_type AS title FROM events),
n AS (SELECT doc, CAST(tab AS VARCHAR) AS tab, CASE WHEN tab > 2 THEN CAST(tab // 3 AS VARCHAR) END AS parent, concat(title, CASE WHEN tab % 7 = 0 THEN ' / x' ELSE '' END) AS title FROM t)"""


@query(
    f"""WITH RECURSIVE {TABS}, m AS (SELECT *, row_number() OVER (PARTITION BY doc, parent, title ORDER BY tab) AS turn, replace(title, '/', '-') AS stem FROM n),
d AS (SELECT doc, tab, concat('docs/', doc, '/', stem, CASE WHEN turn = 1 THEN '' ELSE concat(' (', turn, ')') END) AS path FROM m WHERE parent IS NULL
  UNION ALL SELECT m.doc, m.tab, concat(d.path, '/', stem, CASE WHEN turn = 1 THEN '' ELSE concat(' (', turn, ')') END) FROM d JOIN m ON m.doc = d.doc AND m.parent = d.tab)
SELECT doc AS doc_id, tab AS tab_id, concat(path, '.md') AS path FROM d"""
)
def tab_paths(spark, sf_dir):
    """Tabs named among their siblings, each in the folder of the one above it."""
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")) - 1
    t = table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), place.alias("tab"), "event_type")
    tabs = t.select("doc_id", number(F.col("tab")).alias("tab_id"), F.when(F.col("tab") > 2, F.expr("cast(tab div 3 as string)")).alias("parent_tab"), F.col("tab").alias("index"), F.concat("event_type", F.when(F.col("tab") % 7 == 0, " / x").otherwise("")).alias("title"), F.lit(None).cast("string").alias("kept"))
    return tree.tab_paths(tabs, t.select("doc_id").distinct().select("doc_id", F.concat(F.lit("docs/"), number(F.col("doc_id"))).alias("directory")))


@query(
    """WITH c AS (SELECT doc_id, CAST(doc_id % 4 AS INT) AS root_ord, concat(CASE doc_id % 6 WHEN 0 THEN 'Archive/x' WHEN 1 THEN 'Archive/keep/' WHEN 2 THEN 'a' WHEN 3 THEN 'sub/' WHEN 4 THEN 'b/a' ELSE 'Archive/keep/deep/' END, source, '-', doc_id, CASE WHEN doc_id % 7 < 3 THEN '.tmp' ELSE '.md' END) AS path, doc_id % 10 = 3 OR doc_id % 12 = 7 AS named FROM documents)
SELECT doc_id, path, CASE root_ord WHEN 0 THEN path NOT LIKE 'Archive/keep/%' AND (path LIKE '%.tmp' OR path LIKE 'Archive/%') WHEN 1 THEN path LIKE 'Archive/%' WHEN 2 THEN path LIKE '%.md' AND NOT regexp_matches(path, '(^|/)a[^/]*$') ELSE named END AS ignored FROM c"""
)
def ignored_paths(spark, sf_dir):
    """Four roots with lists of their own: taken back with its folder, without it, by name, and by reference."""
    hex_ = lambda k: F.lpad(number(k), 32, "a")
    lists = [(0, "notion:" + "f" * 32, ["*.tmp", "# old", "Archive/**", "!Archive/keep/", "!Archive/keep/**"]), (1, "notion:" + "e" * 32, ["Archive/**", "!Archive/keep/**"]), (2, "notion:" + "d" * 32, ["*.md", "!a*.md"]), (3, "notion:" + "c" * 32, ["notion:" + "a" * 31 + "3", "gdocs:1ABCDEFGHIJKLMNOPQRSTUVWXYZ-7", "!**"])]
    n = F.col("doc_id")
    k = n % 6
    folder = F.when(k == 0, "Archive/x").when(k == 1, "Archive/keep/").when(k == 2, "a").when(k == 3, "sub/").when(k == 4, "b/a").otherwise("Archive/keep/deep/")
    path = F.concat(folder, "source", F.lit("-"), number(n), F.when(n % 7 < 3, ".tmp").otherwise(".md"))
    above = F.when(n % 12 == 7, F.array(F.lit("gdocs:1ABCDEFGHIJKLMNOPQRSTUVWXYZ-7"))).otherwise(F.array(F.lit("notion:" + "b" * 32)))
    c = table(spark, sf_dir, "documents").select("doc_id", (n % 4).cast("int").alias("root_ord"), path.alias("path"), F.concat(F.lit("notion:"), hex_(n % 10)).alias("ref"), above.alias("ancestors"))
    return tree.ignored_paths(c, spark.createDataFrame(lists, "root_ord int, ref string, ignore array<string>")).select("doc_id", "path", "ignored")


# ---------------------------------------------------------------- plans and reports


@query(
    """WITH t AS (SELECT doc_id AS n, doc_id // 5 AS g, concat('r', doc_id // 5 % 4, '/D', doc_id // 5, '/') AS dir FROM documents),
x AS (SELECT n, g, dir, concat(dir, n, '.md') AS path, CASE g % 7 WHEN 0 THEN 'D' WHEN 1 THEN CASE WHEN n % 5 = 2 THEN 'R090' ELSE 'R100' END WHEN 2 THEN CASE WHEN n % 5 < 2 THEN 'D' ELSE 'M' END WHEN 3 THEN 'R100' WHEN 4 THEN 'M' WHEN 5 THEN 'R100' ELSE CASE WHEN n % 5 = 0 THEN 'D' ELSE 'R100' END END AS status,
  CASE g % 7 WHEN 1 THEN concat('r0/N', g, '/', n, '.md') WHEN 3 THEN concat('r0/N', g, '-', n % 2, '/', n, '.md') WHEN 5 THEN concat('r3/N', g, '/', n, '.md') ELSE concat('r0/S', n, '.md') END AS new FROM t WHERE g % 4 NOT IN (1, 2)),
c AS (SELECT g, count(*) FILTER (status LIKE 'R%') AS moved, min(n) AS first, min(CASE WHEN status LIKE 'R%' THEN left(new, length(new) - length(concat(n, '.md'))) END) AS lo, max(CASE WHEN status LIKE 'R%' THEN left(new, length(new) - length(concat(n, '.md'))) END) AS hi, bool_and(status LIKE 'R%') AS all_moved, bool_and(status = 'D') AS all_gone FROM x GROUP BY g),
w AS (SELECT x.*, first, lo, CASE WHEN all_gone THEN 'deleted' WHEN all_moved AND lo = hi AND lo[2] = dir[2] THEN 'renamed' END AS whole FROM x JOIN c USING (g) WHERE status <> 'M')
SELECT CAST(first AS INT) AS ord, 'root' AS disposition, whole AS kind, CAST(dir[2] AS INT) AS root_ord, CASE whole WHEN 'renamed' THEN lo ELSE dir END AS path, CASE whole WHEN 'renamed' THEN dir END AS previous_path, NULL AS reason FROM w WHERE n = first AND whole IS NOT NULL
UNION ALL SELECT CAST(n AS INT), 'root', 'modified', CAST(dir[2] AS INT), new, NULL, NULL FROM w WHERE whole = 'renamed' AND status <> 'R100'
UNION ALL SELECT CAST(n AS INT), 'refused', NULL, NULL, path, NULL, concat('a tab of ', dir) FROM w WHERE whole IS NULL"""
)
def tab_plan(spark, sf_dir):
    """Documents of five tabs, some in closed roots, that are deleted, moved as a whole, to several places, to another
    root, or in part."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(n.cast("int").alias("ord"), n.alias("n"), F.expr("doc_id div 5").alias("g"), F.concat(F.lit("r"), number(F.expr("doc_id div 5") % 4), F.lit("/D"), number(F.expr("doc_id div 5")), F.lit("/")).alias("dir"))
    k, file = F.col("g") % 7, F.concat(number(F.col("n")), F.lit(".md"))
    fifth = F.col("n") % 5
    path = F.concat("dir", file)
    tabs = d.select(path.alias("path"), F.lit("gdoc").alias("type"), F.lit(False).alias("read_only"), F.concat(F.lit("gdocs:D"), number(F.col("g")), F.lit("#t"), number(F.col("n"))).alias("ref"))
    docs = d.select(F.col("dir").alias("path"), F.lit("gdoc").alias("type"), F.lit(False).alias("read_only"), F.concat(F.lit("gdocs:D"), number(F.col("g"))).alias("ref")).distinct()
    status = F.when(k == 0, "D").when(k == 1, F.when(fifth == 2, "R090").otherwise("R100")).when(k == 2, F.when(fifth < 2, "D").otherwise("M")).when(k == 4, "M").when(k == 6, F.when(fifth == 0, "D").otherwise("R100")).otherwise("R100")
    g = number(F.col("g"))
    new = F.when(k == 1, F.concat(F.lit("r0/N"), g, F.lit("/"), file)).when(k == 3, F.concat(F.lit("r0/N"), g, F.lit("-"), number(F.col("n") % 2), F.lit("/"), file)).when(k == 5, F.concat(F.lit("r3/N"), g, F.lit("/"), file)).otherwise(F.concat(F.lit("r0/S"), file))
    moved = F.startswith("status", F.lit("R"))
    changes = d.withColumn("status", status).select("ord", "status", F.when(moved, new).otherwise(path).alias("path"), F.when(moved, path).alias("previous_path"))
    roots = spark.createDataFrame([(0, "r0/", "gdocs", False, False), (1, "r1/", "gdocs", True, False), (2, "r2/", "gdocs", False, True), (3, "r3/", "gdocs", False, False)], "root_ord int, root_path string, source string, read_only boolean, suggest boolean")
    return plan.tab_directory_plan(changes, roots, tabs.unionByName(docs))[0].drop("seq")



@query(
    """WITH o AS (SELECT user_id AS key, CASE event_id % 4 WHEN 0 THEN 'keep' WHEN 1 THEN 'insert' WHEN 2 THEN 'update' ELSE 'delete' END AS op, concat('f', event_id % 13) AS a, concat('f', event_id % 17) AS b FROM events)
SELECT DISTINCT key, asset FROM (SELECT key, a AS asset FROM o WHERE op IN ('insert', 'update') UNION ALL SELECT key, b FROM o WHERE op IN ('insert', 'update'))"""
)
def needed_assets(spark, sf_dir):
    e = F.col("event_id")
    op = F.when(e % 4 == 0, "keep").when(e % 4 == 1, "insert").when(e % 4 == 2, "update").otherwise("delete")
    o = table(spark, sf_dir, "events").select(F.col("user_id").alias("key"), op.alias("op"), F.array(F.concat(F.lit("f"), number(e % 13)), F.concat(F.lit("f"), number(e % 17))).alias("links"))
    return plan.needed_assets(o)


@query(
    """WITH k AS (SELECT concat(source, '.md') AS path, max(doc_id) AS id FROM documents WHERE doc_id % 2 = 0 GROUP BY source)
SELECT concat(source, '/', doc_id, '.md') AS path, k.id AS parent_id FROM documents LEFT JOIN k ON k.path = concat(source, '.md')"""
)
def page_parents(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    known = d.where("doc_id % 2 = 0").groupBy(F.concat("source", F.lit(".md")).alias("path")).agg(F.max("doc_id").alias("id"))
    return plan.parent_of(d.select(F.concat("source", F.lit("/"), number(F.col("doc_id")), F.lit(".md")).alias("path")), known)


@query(
    """SELECT path, line, CAST(row_number() OVER (ORDER BY last, path) AS INT) AS place FROM (SELECT concat('p', doc_id) AS path, doc_id % 4 = 0 AS last,
  concat(CASE WHEN doc_id % 4 = 0 THEN 'trashed' ELSE 'updated' END, ' p', doc_id, CASE WHEN doc_id % 3 > 0 THEN concat(', ', doc_id % 3, ' uploaded') ELSE '' END, CASE WHEN doc_id % 5 = 0 THEN '; skipped big.png, odd.bin' ELSE '' END) AS line FROM documents)"""
)
def push_reports(spark, sf_dir):
    n = F.col("doc_id")
    actions = table(spark, sf_dir, "documents").select(F.concat(F.lit("p"), number(n)).alias("path"), F.when(n % 4 == 0, "trashed").otherwise("updated").alias("action"), F.array_repeat(F.lit("f"), (n % 3).cast("int")).alias("uploaded"), F.when(n % 5 == 0, F.array(F.lit("big.png"), F.lit("odd.bin"))).otherwise(F.array().cast("array<string>")).alias("skipped"))
    return plan.push_report(actions).select("path", "line", F.row_number().over(Window.orderBy("last", "path")).alias("place"))


@query(
    """WITH e AS (SELECT user_id, event_id, event_type AS text, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS t, count(*) OVER (PARTITION BY user_id) AS n FROM events)
SELECT user_id, event_id, text, false AS plain FROM e WHERE n <= 12 OR t < 12
UNION ALL SELECT user_id, min(event_id), left(string_agg(text, '' ORDER BY t), 50), true FROM e WHERE n > 12 AND t >= 12 GROUP BY user_id"""
)
def capped_runs(spark, sf_dir):
    return plan.cap_runs(table(spark, sf_dir, "events").select("user_id", "event_id", F.col("event_type").alias("text")), "user_id", "event_id", 12, 50)


@query("SELECT path, id, CAST(row_number() OVER (ORDER BY path) AS INT) AS place FROM (SELECT concat(source, '/', doc_id, '.md') AS path, concat('gdocs:', doc_id) AS id FROM documents)")
def index_file(spark, sf_dir):
    """The lines of the index in their order."""
    d = table(spark, sf_dir, "documents").select(F.concat(F.lit("gdocs:"), number(F.col("doc_id"))).alias("id"), F.concat("source", F.lit("/"), number(F.col("doc_id")), F.lit(".md")).alias("path"))
    return snapshot.index_rows(d).select("path", "id", F.row_number().over(Window.orderBy("path")).alias("place"))


@query("SELECT doc_id, CAST(row_number() OVER (PARTITION BY source ORDER BY concat(source, '/', doc_id)) AS INT) AS turn FROM documents")
def creation_turns(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", F.concat("source", F.lit("/"), number(F.col("doc_id"))).alias("path"))
    return plan.creation_order(d, "source").select("doc_id", "turn")


@query(
    """SELECT doc_id AS ord, concat(source, '/', doc_id, '.md') AS path, 'changed since the last fetch' AS reason FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0"""
)
def stale_changes(spark, sf_dir):
    """Changes to documents that moved at their source since the last fetch."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.concat("source", F.lit("/"), number(F.col("doc_id")), F.lit(".md")).alias("path"))
    before = d.select(F.col("doc_id").alias("id"), "path", F.lit("t0").alias("time"), F.lit(None).cast("string").alias("md5"))
    now = before.withColumn("time", F.when(F.col("id") % 3 == 0, "t1").otherwise("t0"))
    return plan.stale_documents(d.where("doc_id % 2 = 0").select(F.col("doc_id").alias("ord"), "path"), snapshot.changes_since(now, before))


@query(
    """WITH c AS (SELECT user_id, event_id, CASE event_id % 3 WHEN 0 THEN [event_type, 'x', 'last one'] WHEN 1 THEN [event_type, CAST(event_id AS VARCHAR)] ELSE ['only'] END AS cells FROM events),
w AS (SELECT user_id, max(length(cells[1])) FILTER (len(cells) > 1) AS a, max(length(cells[2])) FILTER (len(cells) > 2) AS b FROM c GROUP BY user_id)
SELECT user_id, event_id, rtrim(CASE len(cells) WHEN 1 THEN cells[1] WHEN 2 THEN concat(rpad(cells[1], CAST(a AS INT), ' '), '  ', cells[2]) ELSE concat(rpad(cells[1], CAST(a AS INT), ' '), '  ', rpad(cells[2], CAST(greatest(b, length(cells[2])) AS INT), ' '), '  ', cells[3]) END, ' ') AS line FROM c JOIN w USING (user_id)"""
)
def report_columns(spark, sf_dir):
    e = F.col("event_id")
    cells = F.when(e % 3 == 0, F.array("event_type", F.lit("x"), F.lit("last one"))).when(e % 3 == 1, F.array("event_type", number(e))).otherwise(F.array(F.lit("only")))
    return runs.in_columns(table(spark, sf_dir, "events").select("user_id", "event_id", cells.alias("cells")), "user_id", "event_id")


@query("SELECT doc_id, CAST(max(len(string_split(line, ' '))) AS INT) AS width FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents) GROUP BY doc_id")
def table_widths(spark, sf_dir):
    """Lines as rows of cells, cut at blanks."""
    rows = table(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line")).select("doc_id", F.split("line", " ").alias("cells"))
    return runs.table_width(rows, "doc_id")


# ---------------------------------------------------------------- text


@query(
    """WITH t AS (SELECT doc_id, trim(replace(text, chr(10), ' ')) AS one, doc_id % 3 AS n FROM documents)
SELECT doc_id, CASE WHEN length(one) <= 60 THEN one ELSE concat(left(one, 59), '…') END AS short, concat(n, ' file', CASE WHEN n = 1 THEN '' ELSE 's' END) AS files,
  replace(replace(concat('a &amp;lt; b', chr(160)), '&lt;', '<'), '&amp;', '&') AS decoded FROM t"""
)
def short_texts(spark, sf_dir):
    decoded = text.decode_entities(F.lit("a &amp;lt; b "))
    return table(spark, sf_dir, "documents").select("doc_id", text.shorten(F.col("text")).alias("short"), text.plural(F.col("doc_id") % 3, "file").alias("files"), decoded.alias("decoded"))


@query(
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'gdocs:abc' WHEN 1 THEN concat(url, '?id=7') WHEN 2 THEN concat(url, '?id=7') ELSE url END AS text, CASE page_id % 4 WHEN 0 THEN 'docs/x.md' WHEN 2 THEN 'notes/' END AS alias FROM pages"""
)
def specs(spark, sf_dir):
    """Reference and path of what is asked to be added, cut at the last equals sign that is no parameter's."""
    p = F.col("page_id") % 4
    spec = F.when(p == 0, F.lit("gdocs:abc=docs/x.md")).when(p == 1, F.concat("url", F.lit("?id=7"))).when(p == 2, F.concat("url", F.lit("?id=7=notes/"))).otherwise(F.col("url"))
    return table(spark, sf_dir, "pages").select("page_id", refs.split_spec(spec).alias("s")).select("page_id", "s.text", "s.alias")


@query("SELECT event_id, CASE WHEN event_id % 4 = 0 THEN 'soon' ELSE strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M') END AS minute FROM events")
def wall_minutes(spark, sf_dir):
    time = F.when(F.col("event_id") % 4 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS'Z'"))
    return table(spark, sf_dir, "events").select("event_id", text.local_minute(time, "Etc/GMT-2").alias("minute"))


# ---------------------------------------------------------------- suggestions and threads


RUNS = """r AS (SELECT user_id AS doc_id, event_id // 40 AS par, event_id AS ord, concat(event_type, event_id % 10) AS text, event_id % 3 = 0 AS ins, event_id % 5 = 0 AS del, event_id % 11 = 0 AS own, event_id % 97 = 0 AS chip FROM events)"""


def paragraphs(spark, sf_dir) -> DataFrame:
    """doc_id, par, runs: the events of a user in paragraphs, some inserted or deleted by suggestions s1 and s2."""
    e = F.col("event_id")
    ids = lambda cond, name: F.when(cond, F.array(F.lit(name))).otherwise(F.array().cast("array<string>"))
    one = F.struct(e.alias("ord"), F.concat("event_type", number(e % 10)).alias("text"), F.when(e % 97 == 0, "chip").otherwise("text").alias("kind"), F.concat(ids(e % 3 == 0, "s1"), ids(e % 11 == 0, "s2")).alias("insertions"), ids(e % 5 == 0, "s2").alias("deletions"))
    return table(spark, sf_dir, "events").select(F.col("user_id").alias("doc_id"), F.expr("event_id div 40").alias("par"), one.alias("one")).groupBy("doc_id", "par").agg(F.sort_array(F.collect_list("one")).alias("runs"))


@query(f"WITH {RUNS} SELECT doc_id, par, coalesce(string_agg(text, '' ORDER BY ord) FILTER (((NOT ins AND NOT own) OR own) AND NOT del), '') AS text FROM r GROUP BY doc_id, par")
def accepted_texts(spark, sf_dir):
    """Paragraphs with one suggestion accepted, other insertions left out."""
    return paragraphs(spark, sf_dir).select("doc_id", "par", threads.accepted_text(F.col("runs"), F.lit("s2")).alias("text"))


@query(f"WITH {RUNS} SELECT doc_id, par, bool_and((ins OR own) AND NOT chip) AS suggested FROM r GROUP BY doc_id, par")
def suggested_paragraphs(spark, sf_dir):
    return paragraphs(spark, sf_dir).select("doc_id", "par", threads.is_suggested_paragraph(F.col("runs")).alias("suggested"))


@query(
    """WITH s AS (SELECT conv_id AS id, min(turn) AS first FROM conversations GROUP BY conv_id), d AS (SELECT conv_id AS id, count(*) AS n FROM conversations WHERE conv_id % 3 = 0 AND role = 'user' GROUP BY conv_id)
SELECT s.id, s.first, d.n FROM s LEFT JOIN d USING (id)"""
)
def discussed_suggestions(spark, sf_dir):
    c = table(spark, sf_dir, "conversations")
    said = c.where("conv_id % 3 = 0 and role = 'user'").groupBy(F.col("conv_id").alias("id")).agg(F.count("*").alias("n"))
    return threads.with_discussion(c.groupBy(F.col("conv_id").alias("id")).agg(F.min("turn").alias("first")), said)


@query(
    """WITH t AS (SELECT doc_id, text AS body, split_part(text, ' ', 5) AS q, CAST(doc_id % 4 AS INT) AS anchor FROM documents),
tabs AS (SELECT doc_id, 0 AS tab, substr(body, 1, 20) AS body, q, anchor FROM t UNION ALL SELECT doc_id, 1, substr(body, 21), q, anchor FROM t)
SELECT doc_id, CASE WHEN anchor IN (0, 1) THEN anchor ELSE coalesce(min(tab) FILTER (trim(q) <> '' AND contains(body, trim(q))), 0) END AS tab_ord FROM tabs GROUP BY doc_id, anchor"""
)
def thread_tabs(spark, sf_dir):
    """Threads in their anchor's tab where the document has it, else in the first tab with the quote, else in the first."""
    d = table(spark, sf_dir, "documents")
    tabs = d.select("doc_id", F.explode(F.array(F.struct(F.lit(0).alias("tab_ord"), F.substring("text", 1, 20).alias("body")), F.struct(F.lit(1).alias("tab_ord"), F.expr("substr(text, 21)").alias("body")))).alias("x")).select("doc_id", "x.*")
    asked = d.select("doc_id", F.lit("q").alias("id"), F.split_part("text", F.lit(" "), F.lit(5)).alias("quote"), (F.col("doc_id") % 4).cast("int").alias("anchor_tab"))
    return threads.place_threads(asked, tabs).select("doc_id", "tab_ord")


@query(
    f"""WITH {LINES}, b AS (SELECT doc_id, ord, line, lag(CASE WHEN length(line) % 4 = 0 THEN line END) OVER (PARTITION BY doc_id ORDER BY ord) AS attribute FROM l)
SELECT doc_id, CAST(ord AS INT) AS ord, attribute FROM b WHERE length(line) % 4 <> 0"""
)
def block_attributes(spark, sf_dir):
    """Lines whose length four divides stand for attribute comments: they go to the line behind them."""
    lines = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("ord", "line"))
    return runs.with_attributes(lines, F.length("line") % 4 == 0, text="line").select("doc_id", "ord", "attribute")


@query(
    f"""WITH {TURNS}, w AS (SELECT key, string_split(a, ' ') AS x, string_split(b, ' ') AS y FROM p), z AS (SELECT key, least(len(x), len(y)) AS n, x, y FROM w),
e AS (SELECT key, unnest(x[:n]) AS old, unnest(y[:n]) AS new, unnest(range(0, n)) AS i FROM z),
s AS (SELECT *, sum(CASE WHEN old = new OR coalesce(was, true) THEN 1 ELSE 0 END) OVER (PARTITION BY key ORDER BY i) AS run FROM (SELECT *, lag(old = new) OVER (PARTITION BY key ORDER BY i) AS was FROM e)),
t AS (SELECT key, run, 0 AS side, i, concat(CASE WHEN old = new THEN '  ' ELSE '- ' END, replace(old, chr(10), concat(chr(10), CASE WHEN old = new THEN '  ' ELSE '- ' END))) AS line FROM s WHERE old <> ''
  UNION ALL SELECT key, run, 1, i, concat('+ ', replace(new, chr(10), concat(chr(10), '+ '))) FROM s WHERE new <> '' AND new <> old)
SELECT key, coalesce(string_agg(line, chr(10) ORDER BY run, side, i), '') AS lines FROM z LEFT JOIN t USING (key) GROUP BY key"""
)
def rendered_hunks(spark, sf_dir):
    """The words of two turns, place by place, as unchanged lines and hunks of old and new ones."""
    w = turn_pairs(spark, sf_dir).select("key", F.split("a", " ").alias("x"), F.split("b", " ").alias("y"))
    n = F.least(F.size("x"), F.size("y"))
    made = threads.hunks(w.select("key", F.slice("x", F.lit(1), n).alias("before"), F.slice("y", F.lit(1), n).alias("after")))
    return made.select("key", F.array_join("lines", "\n").alias("lines"))


# ---------------------------------------------------------------- trees and patches

REMOVED = "a AS (SELECT concat('old/', doc_id) AS path, text FROM documents WHERE doc_id % 5 = 0), b AS (SELECT concat('new/', doc_id + 5) AS path, CASE WHEN doc_id % 2 = 0 THEN concat(text, chr(10), 'a new line') ELSE text END AS text FROM documents WHERE doc_id % 10 < 5 AND doc_id % 5 = 0)"


@query(
    f"""WITH {REMOVED}, x AS (SELECT path, line, count(*) * (length(line) + 1) AS w FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM a) GROUP BY path, line),
y AS (SELECT path, line, count(*) * (length(line) + 1) AS w FROM (SELECT path, unnest(string_split(text, chr(10))) AS line FROM b) GROUP BY path, line),
s AS (SELECT x.path AS previous_path, y.path AS path, sum(least(x.w, y.w)) AS shared FROM x JOIN y USING (line) GROUP BY ALL)
SELECT previous_path, s.path, round(shared / greatest(p.n, q.n), 6) AS score FROM s JOIN (SELECT path, sum(w) AS n FROM x GROUP BY path) p ON p.path = previous_path JOIN (SELECT path, sum(w) AS n FROM y GROUP BY path) q ON q.path = s.path WHERE shared / greatest(p.n, q.n) >= 0.5"""
)
def rename_scores(spark, sf_dir):
    """Removed and added files of which at least half is the same, line by line."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").where("doc_id % 5 = 0")
    new = d.where("doc_id % 10 < 5").select(F.concat(F.lit("new/"), number(n + 5)).alias("path"), F.when(n % 2 == 0, F.concat("text", F.lit("\na new line"))).otherwise(F.col("text")).alias("text"))
    return snapshot.rename_scores(d.select(F.concat(F.lit("old/"), number(n)).alias("path"), "text"), new).withColumn("score", F.round("score", 6))


@query(
    """WITH a AS (SELECT concat(source, '/d', doc_id % 10, '/', doc_id, '.md') AS path, source, doc_id, doc_id % 131 = 7 OR doc_id % 97 = 5 AS differs FROM documents),
f AS (SELECT concat(source, '/d', doc_id % 10) AS folder, true AS own, differs FROM a UNION ALL SELECT source, false, differs FROM a UNION ALL SELECT '', false, differs FROM a)
SELECT folder, bool_or(own) AS own FROM f WHERE differs GROUP BY folder"""
)
def changed_folders(spark, sf_dir):
    """Folders of which a file is altered or gone, by their hashes."""
    n = F.col("doc_id")
    d = table(spark, sf_dir, "documents").select(n, F.concat("source", F.lit("/d"), number(n % 10), F.lit("/"), number(n), F.lit(".md")).alias("path"), F.md5("text").alias("sha"))
    after = d.where("doc_id % 131 <> 7").withColumn("sha", F.when(n % 97 == 5, F.reverse("sha")).otherwise(F.col("sha")))
    return merkle.changed_folders(merkle.folder_hashes(d), merkle.folder_hashes(after))


@query(
    """SELECT event_id AS key, CASE WHEN event_id % 2 = 0 THEN concat('{"deleteContentRange":{"range":{"startIndex":', event_id % 50, ',"endIndex":', event_id % 50 + length(event_type), ',"tabId":"t.', event_id % 3, '"}}}')
  ELSE concat('{"insertText":{"location":{"index":', event_id % 50, ',"tabId":"t.', event_id % 3, '"},"text":"', event_type, '"}}') END AS json FROM events"""
)
def stamped_requests(spark, sf_dir):
    e = F.col("event_id")
    edits = table(spark, sf_dir, "events").select(e.alias("key"), (e % 50).cast("int").alias("index"), F.lit(0).alias("order"), F.when(e % 2 == 0, F.col("event_type")).otherwise("").alias("deleted"), F.when(e % 2 == 1, F.col("event_type")).otherwise("").alias("inserted"))
    made = patch.text_requests(edits).withColumn("tab", F.concat(F.lit("t."), number(F.col("key") % 3))).withColumn("segment", F.lit(None).cast("string"))
    return patch.request_json(made).select("key", "json")


@query("SELECT doc_id, CAST(doc_id % 3 AS INT) AS root_ord FROM documents WHERE doc_id % 3 < 2 UNION ALL SELECT doc_id, 2 FROM documents WHERE doc_id % 7 = 0")
def joined_roots(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id")
    return tree.union_roots([d.where("doc_id % 3 = 0"), d.where("doc_id % 3 = 1"), d.where("doc_id % 7 = 0")])
