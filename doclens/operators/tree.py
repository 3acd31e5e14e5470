"""Trees of folders, pages and tabs as adjacency rows: walks with pruning, order, ignored subtrees, event instances."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType

from doclens.functions.refs import parse_literal
from doclens.functions.text import nfc, wall_stamp
from doclens.operators.lineage import cut
from doclens.operators.naming import assign_names


def walk(nodes: DataFrame, ignored: DataFrame | None = None) -> DataFrame:
    """id, depth, path, sort of every node under the roots (null parent); ignored nodes are not descended.

    nodes: id, parent_id, ord, name. Each round joins what a node knows of its ancestors with what the highest of these
    knows of its own, so that the rounds grow with the logarithm of the depth; they end when no further node has reached
    its root. Neither depth nor size has a limit. `sort` orders nodes before their children, siblings by ord: any long,
    null before all. Ids may be of any type.
    """
    keep = nodes if ignored is None else nodes.join(ignored.select("id"), "id", "left_anti")
    # in 16 digits, with the sign turned over: as text in the order of the numbers
    place = F.coalesce(F.lpad(F.hex(F.col("ord").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0"), F.lit(""))
    state = keep.select("id", F.col("parent_id").alias("above"), F.lit(0).alias("depth"), F.col("name").alias("path"), place.alias("sort"))
    before = None
    while True:
        state = cut(state)
        rooted, reached = state.where("above is null"), state.where("above is null").count()
        if reached == before:
            return rooted.drop("above")
        before = reached
        up = state.select(F.col("id").alias("above"), F.col("above").alias("next"), *(F.col(c).alias(f"{c}_up") for c in ("depth", "path", "sort")))
        joined = lambda c: F.concat(f"{c}_up", F.lit("/"), c).alias(c)
        climbed = state.join(up, "above").select("id", F.col("next").alias("above"), (F.col("depth") + F.col("depth_up") + 1).alias("depth"), joined("path"), joined("sort"))
        state = rooted.unionByName(climbed)


def kind_of(mime: Column) -> Column:
    """doc, folder, export, skipped (with its reason in skip_reason) or binary, by content type."""
    prefix = "application/vnd.google-apps."
    return (
        F.when(mime == f"{prefix}document", "doc")
        .when(mime == f"{prefix}folder", "folder")
        .when(mime.isin(f"{prefix}spreadsheet", f"{prefix}presentation", f"{prefix}drawing"), "export")
        .when(F.startswith(mime, F.lit(prefix)), "skipped")
        .otherwise("binary")
    )


def skip_reason(mime: Column) -> Column:
    return F.when(kind_of(mime) == "skipped", F.concat(F.lit("unsupported type "), mime)).when(mime.rlike("^(video|audio)/"), "a recording")


def child_counts(nodes: DataFrame) -> DataFrame:
    """id, children; zero for leaves."""
    counts = nodes.where("parent_id is not null").groupBy(F.col("parent_id").alias("id")).agg(F.count("*").alias("children"))
    return nodes.select("id").join(counts, "id", "left").fillna(0, ["children"])


def ignored_refs(walked: DataFrame, nodes: DataFrame, refs: DataFrame) -> DataFrame:
    """Nodes that are ignored by reference: they or an ancestor are named; roots never are.

    Rounds as in walk(): a node takes over whether the highest ancestor it knows, or one above that, is named.
    """
    named = refs.select("id").distinct().withColumn("named", F.lit(True))
    hit = F.coalesce("named", F.lit(False)) & F.col("parent_id").isNotNull()
    state = nodes.select("id", "parent_id").join(named, "id", "left").select("id", F.col("parent_id").alias("above"), hit.alias("hit"))
    before = None
    while True:
        state = cut(state)
        climbing = state.where("above is not null").count()
        if not climbing:
            return state.where("hit").select("id").distinct().join(walked.select("id"), "id", "left_semi")
        if climbing == before:
            raise ValueError("the tree has a cycle")
        before = climbing
        up = state.select(F.col("id").alias("above"), F.col("above").alias("next"), F.col("hit").alias("hit_up"))
        climbed = state.where("above is not null").join(up, "above", "left").select("id", F.col("next").alias("above"), (F.col("hit") | F.coalesce("hit_up", F.lit(False))).alias("hit"))
        state = state.where("above is null").unionByName(climbed)


def glob_pattern(glob: str) -> str:
    """An ignore-file pattern as a regular expression over relative paths; what it matches, it matches with all below."""
    body = glob.rstrip("/")
    anchored = "/" in body
    body = body.lstrip("/")
    out, i = "", 0
    while i < len(body):
        if body.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif body.startswith("/**", i) and i + 3 == len(body):
            out, i = out + "/.+", i + 3
        elif body.startswith("**", i):
            out, i = out + ".*", i + 2
        elif body[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif body[i] == "?":
            out, i = out + "[^/]", i + 1
        elif body[i] == "[" and "]" in body[i + 1 :]:
            end = body.index("]", i + 1)
            out, i = out + "[" + body[i + 1 : end].replace("!", "^", 1).replace("\\", "\\\\") + "]", end + 1
        else:
            if body[i] == "\\" and i + 1 < len(body):
                i += 1
            out, i = out + re.escape(body[i]), i + 1
    return f"^{'' if anchored else '(?:.*/)?'}{out}{'/.*' if glob.endswith('/') else '(?:/.*)?'}$"


def glob_rule(glob: str) -> tuple[bool, str] | None:
    """Whether a line of an ignore list takes back, and the expression of what it matches: a path, or a folder with its
    slash. None for comments and empty lines."""
    line = glob.strip()
    if not line or line.startswith("#"):
        return None
    back = line.startswith("!")
    return back, glob_pattern(line[back:]).replace("(?:/.*)?$", "/?$").replace("/.*$", "/$")


def folders_and_self(path: Column) -> Column:
    """Every folder above a path, with its slash, and the path."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.when(n < F.size(parts), F.lit("/")).otherwise(F.lit(""))))


def ignored_by_globs(path: Column, globs: list[str]) -> Column:
    """The last pattern that matches decides; `!` takes back, but not below an ignored folder."""
    rules = [r for r in map(glob_rule, globs) if r]

    def one(p: Column) -> Column:
        state = F.lit(False)
        for back, rule in rules:
            state = F.when(p.rlike(rule), F.lit(not back)).otherwise(state)
        return state

    return F.exists(folders_and_self(path), one) if rules else F.lit(False)


@F.pandas_udf(StructType([StructField("back", BooleanType()), StructField("rule", StringType())]))
def glob_rules(globs: pd.Series) -> pd.DataFrame:
    """The rule of each line of an ignore list; there are as many as people wrote."""
    return pd.DataFrame([glob_rule(g) or (None, None) if g is not None else (None, None) for g in globs], columns=["back", "rule"])


def ignored_paths(candidates: DataFrame, roots: DataFrame) -> DataFrame:
    """candidates (root_ord, path, ref, ancestors) with `ignored`, by the list of their own root.

    roots: root_ord, ref, ignore (array of lines). Lines that are references ignore the object and all below it, whatever
    is taken back; of the others the last that matches a path or a folder above it decides. Paths are relative to the
    root; the root itself is never ignored. Null lists and paths ignore nothing.
    """
    lines = roots.select("root_ord", F.posexplode("ignore").alias("at", "line"))
    read = lines.select("root_ord", "at", "line", parse_literal(F.col("line")).alias("r"))
    named = read.where("r.id is not null").groupBy("root_ord").agg(F.collect_set(F.concat("r.source", F.lit(":"), "r.id")).alias("named"))
    rules = read.where("r.id is null").select("root_ord", "at", glob_rules("line").alias("g")).where("g.rule is not null")
    ordered = rules.groupBy("root_ord").agg(F.sort_array(F.collect_list(F.struct("at", "g.back", "g.rule"))).alias("rules"))
    # a row per root, as many as people subscribed to: where it is small it goes to every task, by its measured size
    lists = roots.select("root_ord", F.col("ref").alias("_root")).join(named, "root_ord", "left").join(ordered, "root_ord", "left")
    rows = candidates.withColumn("_nfc", nfc("path")).join(lists, "root_ord", "left")
    last = lambda p: F.aggregate("rules", F.lit(False), lambda state, r: F.when(F.rlike(p, r["rule"]), ~r["back"]).otherwise(state))
    by_line = F.exists(folders_and_self(F.col("_nfc")), last)
    by_name = F.array_contains("named", F.col("ref")) | F.arrays_overlap("named", F.coalesce("ancestors", F.array().cast("array<string>")))
    is_root = F.col("path").isin("", ".") | (F.col("ref") == F.col("_root"))
    no = lambda c: F.coalesce(c, F.lit(False))
    return rows.withColumn("ignored", ~no(is_root) & (no(by_name) | no(by_line))).select(*candidates.columns, "ignored")


def tab_paths(tabs: DataFrame, directories: DataFrame) -> DataFrame:
    """doc_id, tab_id, path: where each tab's file goes; a tab with children has a folder of its name beside it.

    tabs: doc_id, tab_id, parent_tab, index, title, kept (the file name of the last time, or null). directories: doc_id,
    directory (without its slash). Names are given among the tabs of one parent, so they do not wait for one another;
    tabs without an id, and what is below them, have no path.
    """
    own = tabs.where("tab_id is not null and tab_id <> ''")
    named = assign_names(own.select(F.struct("doc_id", "parent_tab").alias("folder"), F.col("index").alias("ord"), F.col("tab_id").alias("id"), "title", F.lit(".md").alias("ext"), "kept"))
    node = lambda tab: F.struct(F.col("folder.doc_id").alias("doc_id"), tab.alias("tab_id"))
    up = F.col("folder.parent_tab")
    nodes = named.select(node(F.col("id")).alias("id"), F.when(up.isNotNull(), node(up)).alias("parent_id"), F.lit(0).alias("ord"), F.left("name", F.length("name") - 3).alias("name"))
    placed = walk(nodes).select("id.doc_id", "id.tab_id", F.col("path").alias("inner"))
    return placed.join(directories, "doc_id").select("doc_id", "tab_id", F.concat("directory", F.lit("/"), "inner", F.lit(".md")).alias("path"))


def tab_order(tabs: DataFrame) -> DataFrame:
    """Tabs of each document before their children, siblings by index: doc_id, tab_id, path, position (from 0)."""
    node = lambda tab: F.struct(F.col("doc_id"), F.col(tab).alias("tab_id"))
    walked = walk(tabs.select(node("tab_id").alias("id"), F.when(F.col("parent_tab").isNotNull(), node("parent_tab")).alias("parent_id"), F.col("index").alias("ord"), F.col("title").alias("name")))
    spot = F.row_number().over(Window.partitionBy("id.doc_id").orderBy("sort")) - 1
    return walked.select("id.doc_id", "id.tab_id", "path", spot.alias("position"))


def event_folders(instances: DataFrame, now: str) -> DataFrame:
    """Past instances of events with a folder name each; equal names are numbered by start, even for calls without files.

    instances: event_id, start (ISO text), summary, attachments (array of structs with fileId).
    """
    name = F.concat_ws(" ", wall_stamp(F.col("start")), F.col("summary"))
    turn = F.row_number().over(Window.partitionBy("event_id", F.lower("_name")).orderBy("start"))
    named = instances.where(F.to_timestamp("start") < F.to_timestamp(F.lit(now))).withColumn("_name", name).withColumn("_turn", turn)
    named = named.withColumn("folder", F.when(F.col("_turn") == 1, F.col("_name")).otherwise(F.concat("_name", F.lit(" ("), F.col("_turn").cast("string"), F.lit(")"))))
    return named.where(F.size("attachments") > 0).drop("_name", "_turn")


def event_files(folders: DataFrame) -> DataFrame:
    """Attachments of each instance, once per file, in their order."""
    each = folders.select("event_id", "folder", F.posexplode("attachments").alias("pos", "file"))
    return each.groupBy("event_id", "folder", F.col("file.fileId").alias("file_id")).agg(F.min("pos").alias("pos"))


def union_roots(parts: list[DataFrame]) -> DataFrame:
    """The outputs of all roots, in manifest order."""
    return reduce(DataFrame.unionByName, (p.withColumn("root_ord", F.lit(n)) for n, p in enumerate(parts)))


def adjacency(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "id string, parent_id string, ord int, name string")
