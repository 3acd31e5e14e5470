"""Readers of recorded stores: front matter, manifests, JSON listings and blocks, as DataFrames with fixed schemas."""

from __future__ import annotations

from collections.abc import Callable

import yaml
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.functions.paths import path_problem

ROOTS = "root_ord int, source string, id string, root_path string, ignore array<string>, comments boolean, read_only boolean, suggest boolean"
PAGE = "id string, parent struct<type:string,page_id:string>, last_edited_time string, last_edited_by struct<id:string>, properties struct<title:struct<title:array<struct<plain_text:string>>>>"
FILE = "id string, name string, mimeType string, modifiedTime string, md5Checksum string, size string, parents array<string>, lastModifyingUser struct<displayName:string,permissionId:string,emailAddress:string>"
COMMENT = "id string, createdTime string, content string, resolved boolean, deleted boolean, anchor string, quotedFileContent struct<value:string>, author struct<displayName:string>, replies array<struct<id:string,createdTime:string,content:string,deleted:boolean,author:struct<displayName:string>>>"
EVENT = "id string, summary string, recurrence array<string>, start struct<dateTime:string,date:string,timeZone:string>, attachments array<struct<fileId:string,title:string,mimeType:string>>"
KNOWN = {"src", "path", "ignore", "comments", "readonly", "suggest"}


def front_matter(text: Column) -> Column:
    """struct(has, id, title, url, body): the fields between `---` lines at the start, and what follows."""
    head = F.regexp_extract(text, r"(?s)\A---\n(.*?\n)?---(?:\n|\z)", 0)
    field = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?m)^{name}: *(.*)$", 1)), F.lit(""))
    has = head != ""
    return F.struct(has.alias("has"), field("id").alias("id"), field("title").alias("title"), field("url").alias("url"), F.substring(text, F.length(head) + 1, F.length(text)).alias("body"))


def read_manifest(text: str) -> tuple[list[tuple], list[str]]:
    """Roots and every problem, each with its line. A root: source, id, path, ignore, comments, read_only, suggest."""
    try:
        node = yaml.compose(text)
        data = yaml.safe_load(text)
    except yaml.YAMLError as problem:
        mark = getattr(problem, "problem_mark", None)
        return [], [f"line {mark.line + 1 if mark else 1}: not YAML"]
    if not isinstance(data, dict) or data.get("version") != 1 or not isinstance(data.get("roots"), list):
        return [], ["line 1: a manifest has version 1 and a list of roots"]
    listed = next(v for k, v in node.value if k.value == "roots").value
    roots, problems = [], [f"line {k.start_mark.line + 1}: unknown key {k.value}" for k, _ in node.value if k.value not in ("version", "roots")]
    for n, (root, at) in enumerate(zip(data["roots"], listed, strict=True)):
        line = at.start_mark.line + 1
        if not isinstance(root, dict):
            problems.append(f"line {line}: a root is a mapping")
            continue
        problems += [f"line {k.start_mark.line + 1}: unknown key {k.value}" for k, _ in at.value if k.value not in KNOWN]
        problems += [f"line {line}: {key} is missing" for key in ("src", "path") if not isinstance(root.get(key), str)]
        problems += [f"line {line}: {key} is true or false" for key in ("comments", "readonly", "suggest") if not isinstance(root.get(key, False), bool)]
        source, _, id_ = str(root.get("src", "")).partition(":")
        if source not in ("notion", "gdocs", "calendar"):
            problems.append(f"line {line}: unknown source {source}")
        roots.append((n, source, id_, root.get("path"), root.get("ignore", []), root.get("comments"), root.get("readonly"), root.get("suggest")))
    return roots, problems


def write_manifest(roots: list[dict]) -> str:
    """Roots as YAML, absent fields left out."""
    rows = [{k: v for k, v in {"src": r["src"], "path": r["path"], "ignore": r.get("ignore") or None, "comments": r.get("comments"), "readonly": r.get("read_only"), "suggest": r.get("suggest")}.items() if v is not None} for r in roots]
    return yaml.safe_dump({"version": 1, "roots": rows}, sort_keys=False)


def manifest_roots(spark: SparkSession, text: str) -> DataFrame:
    """The roots of a manifest without problems; raises with all of them otherwise."""
    roots, problems = read_manifest(text)
    df = spark.createDataFrame(roots, ROOTS)
    problems += [f"root {r['root_ord']}: {r['p']}" for r in df.select("root_ord", path_problem(F.col("root_path")).alias("p")).where("p is not null").collect()]
    if problems:
        raise ValueError("; ".join(problems))
    return df


def pages(spark: SparkSession, path: str) -> DataFrame:
    """Recorded pages as objects: id, parent_id, title, last_edited_raw, editor_id."""
    raw = spark.read.schema(PAGE).json(path, multiLine=True)
    title = F.array_join(F.transform("properties.title.title", lambda t: t["plain_text"]), "")
    bare = lambda c: F.lower(F.replace(c, F.lit("-"), F.lit("")))
    return raw.select(bare(F.col("id")).alias("id"), bare(F.col("parent.page_id")).alias("parent_id"), title.alias("title"), F.col("last_edited_time").alias("last_edited_raw"), F.col("last_edited_by.id").alias("editor_id"))


def blocks(spark: SparkSession, path: str) -> DataFrame:
    """Recorded blocks, one JSON object each, as text again: id, type, json, has_children."""
    raw = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", "array<string>")).alias("json"))
    block = raw.select(F.parse_json("json").alias("v"))
    type_ = F.variant_get("v", "$.type", "string")
    return block.select(F.variant_get("v", "$.id", "string").alias("id"), type_.alias("type"), F.to_json("v").alias("json"), F.try_variant_get("v", "$.has_children", "boolean").alias("has_children"))


def block_tree(spark: SparkSession, path: str) -> DataFrame:
    """Recorded listings of blocks as a tree: id, parent_id, ord (within its listing), type, json, descend.

    A listing is a JSON array of blocks in their order. descend: whether a scan goes on below, which it does not into
    child pages and databases, whose blocks are documents of their own.
    """
    raw = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "array<string>")).alias("ord", "json"))
    block = raw.select("ord", F.parse_json("json").alias("v"))
    of = lambda p: F.try_variant_get("v", p, "string")
    bare = lambda c: F.lower(F.replace(c, F.lit("-"), F.lit("")))
    below = F.coalesce(F.try_variant_get("v", "$.has_children", "boolean"), F.lit(False)) & ~of("$.type").isin("child_page", "child_database")
    return block.select(bare(of("$.id")).alias("id"), bare(F.coalesce(of("$.parent.block_id"), of("$.parent.page_id"))).alias("parent_id"), "ord", of("$.type").alias("type"), F.to_json("v").alias("json"), below.alias("descend"))


def git_tree(spark: SparkSession, path: str) -> DataFrame:
    """A recorded recursive tree listing, lines of mode, type, blob and path: path, sha, mode of its blobs."""
    raw = spark.read.text(path)
    part = lambda n: F.regexp_extract("value", r"^([0-7]{6}) (\w+) ([0-9a-f]{40,64})\t(.*)$", n)
    return raw.where(part(2) == "blob").select(part(4).alias("path"), part(3).alias("sha"), part(1).alias("mode"))


def files(spark: SparkSession, path: str) -> DataFrame:
    """A recorded folder listing: id, name, mime, last_edited_raw, md5, size, editor."""
    raw = spark.read.schema(FILE).json(path, multiLine=True)
    return raw.select("id", "name", F.col("mimeType").alias("mime"), F.col("modifiedTime").alias("last_edited_raw"), F.col("md5Checksum").alias("md5"), F.col("size").cast("long").alias("size"), F.coalesce("lastModifyingUser.emailAddress", "lastModifyingUser.displayName").alias("editor"))


def comments(spark: SparkSession, path: str) -> DataFrame:
    """Recorded comments and their replies as rows: thread_id, ord, author, time, text, quoted, resolved, deleted."""
    raw = spark.read.schema(COMMENT).json(path, multiLine=True)
    own = F.struct(F.col("author.displayName").alias("author"), F.col("createdTime").alias("time"), F.col("content").alias("text"), F.coalesce("deleted", F.lit(False)).alias("deleted"))
    replies = F.transform(F.coalesce("replies", F.array()), lambda r: F.struct(r["author"]["displayName"].alias("author"), r["createdTime"].alias("time"), r["content"].alias("text"), F.coalesce(r["deleted"], F.lit(False)).alias("deleted")))
    each = raw.select(F.col("id").alias("thread_id"), F.col("quotedFileContent.value").alias("quoted"), F.coalesce("resolved", F.lit(False)).alias("resolved"), F.posexplode(F.concat(F.array(own), replies)).alias("ord", "e"))
    return each.select("thread_id", "ord", "e.author", "e.time", "e.text", "quoted", "resolved", "e.deleted")


def events(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.schema(EVENT).json(path, multiLine=True)
    return raw.select(F.col("id").alias("event_id"), F.coalesce("start.dateTime", "start.date").alias("start"), "summary", "recurrence", F.coalesce("attachments", F.array().cast("array<struct<fileId:string,title:string,mimeType:string>>")).alias("attachments"))


def assets(spark: SparkSession, path: str) -> DataFrame:
    """Files as bytes with their checksum."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length", F.sha2("content", 256).alias("checksum"), "content")


#: Source name -> reader of its listing.
READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {"notion": pages, "gdocs": files, "calendar": events}


def listing(spark: SparkSession, source: str, path: str) -> DataFrame:
    if source not in READERS:
        raise ValueError(f"unknown source {source}")
    return READERS[source](spark, path)


def with_editors(objects: DataFrame, editors: DataFrame) -> DataFrame:
    """Objects with their editor's name and email; an unknown editor keeps the id only."""
    return objects.join(editors.select("editor_id", F.col("name").alias("editor_name"), F.col("email").alias("editor_email")), "editor_id", "left")


def describe(objects: DataFrame, id_: str) -> DataFrame:
    """One object with the number of its children."""
    kids = objects.where(F.col("parent_id") == id_).agg(F.count("*").alias("children"))
    return objects.where(F.col("id") == id_).withColumn("children", F.lit(kids.first()["children"]))
