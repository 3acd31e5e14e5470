"""Plans of edits: what each changed path means, what is refused, in which order requests go out, reports."""

from __future__ import annotations

import logging

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.paths import asset_document, is_read_only, is_sidecar
from doclens.functions.refs import doc_of, tab_of
from doclens.functions.text import let, low_half, utf16_slice
from doclens.operators.lineage import cut
from doclens.operators.snapshot import assign_roots


def _with_root(rows: DataFrame, roots: DataFrame, path: str, prefix: str) -> DataFrame:
    """rows with <prefix>root_ord/read_only/suggest/source of the root that claims rows[path]."""
    keyed = assign_roots(rows.withColumn("_p", F.coalesce(F.col(path), F.lit("\0"))), roots.select("root_ord", "root_path"), "_p").drop("_p", "root_path")
    facts = roots.select("root_ord", is_read_only(F.col("read_only"), F.col("source")).alias(f"{prefix}locked"), F.coalesce("suggest", F.lit(False)).alias(f"{prefix}suggest"), F.col("source").alias(f"{prefix}source"))
    return keyed.join(facts, "root_ord", "left").withColumnRenamed("root_ord", f"{prefix}root")


def tab_directory_plan(changes: DataFrame, roots: DataFrame, index: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What changes mean that delete or move the tab files of a document with a directory of tabs, and which they are.

    In the index a tab is a `gdoc` with the reference `gdocs:document#tab`, its document one whose path ends in a slash.
    All of a document's tabs deleted delete the document; all of them moved to one new directory, under the same root and
    each to the same place in it, rename it, and what was edited on the way is modified besides. Anything less is
    refused tab by tab, as deleting a tab cannot be undone. Documents under read-only and suggest roots are left to the
    rules of those.

    -> rows as of plan_changes() with seq -1 (before the rows of single changes) or 0 (edits), and the `ord` of the
    changes that are done with.
    """
    docs = index.where("type = 'gdoc' and startswith(ref, 'gdocs:')").select("path", doc_of(F.col("ref")).alias("doc"), tab_of(F.col("ref")).isNotNull().alias("is_tab"))
    open_roots = roots.select("root_ord", (is_read_only(F.col("read_only"), F.col("source")) | F.coalesce("suggest", F.lit(False))).alias("closed"))
    rooted = lambda rows, path: assign_roots(rows, roots.select("root_ord", "root_path"), path).drop("root_path")
    dirs = docs.where("not is_tab and endswith(path, '/')").groupBy("doc").agg(F.max("path").alias("directory"))
    dirs = rooted(dirs, "directory").join(open_roots.where("not closed").select("root_ord"), "root_ord", "left_semi")
    tabs = docs.where("is_tab").select(F.col("path").alias("tab_path"), "doc").join(dirs, "doc")
    sized = tabs.groupBy("doc").agg(F.count("*").alias("tabs"))
    letter, was = F.left("status", F.lit(1)), F.coalesce("previous_path", "path")
    mine = changes.select("ord", "status", "path", "previous_path", letter.alias("letter"), was.alias("tab_path")).join(tabs, "tab_path")
    gone = F.col("letter") == "D"
    out = (F.col("letter") == "R") & F.col("previous_path").isNotNull() & ~F.startswith("path", F.col("directory"))
    # where the file is now, without its place in the directory
    place = F.substring(F.col("previous_path"), F.length("directory") + 1, F.length("previous_path"))
    to = F.when(F.endswith("path", place), F.left("path", F.length("path") - F.length(place)))
    mine = mine.where(gone | out).withColumn("gone", gone).withColumn("to", F.when(~gone, to))
    sums = mine.groupBy("doc").agg(F.count_if("gone").alias("n_gone"), F.count_if(~F.col("gone")).alias("n_out"), F.count_if(~F.col("gone") & F.col("to").isNull()).alias("astray"), F.min("to").alias("to"), F.max("to").alias("last_to"), F.min("ord").alias("first")).join(sized, "doc").join(dirs, "doc")
    kept = rooted(sums.where("to is not null").select("to").distinct(), "to").withColumnRenamed("root_ord", "to_root")
    whole = (
        F.when((F.col("n_gone") == F.col("tabs")) & (F.col("n_out") == 0), "deleted")
        .when((F.col("n_gone") == 0) & (F.col("n_out") == F.col("tabs")) & (F.col("astray") == 0) & (F.col("to") == F.col("last_to")) & (F.col("to_root") == F.col("root_ord")), "renamed")
    )
    judged = sums.join(kept, "to", "left").withColumn("whole", whole)
    text, none = F.lit(None).cast("string"), F.lit(None).cast("int")
    columns = ["ord", "seq", "disposition", "kind", "root_ord", "path", "previous_path", "reason"]
    renamed = F.col("whole") == "renamed"
    documents = judged.where("whole is not null").select(F.col("first").alias("ord"), F.lit(-1).alias("seq"), F.lit("root").alias("disposition"), F.col("whole").alias("kind"), "root_ord", F.when(renamed, F.col("to")).otherwise(F.col("directory")).alias("path"), F.when(renamed, F.col("directory")).alias("previous_path"), text.alias("reason"))
    single = mine.select("ord", "status", "path", "tab_path", "doc").join(judged.select("doc", "whole", "root_ord", "directory"), "doc")
    edits = single.where("whole = 'renamed' and status <> 'R100'").select("ord", F.lit(0).alias("seq"), F.lit("root").alias("disposition"), F.lit("modified").alias("kind"), "root_ord", "path", text.alias("previous_path"), text.alias("reason"))
    refused = single.where("whole is null").select("ord", F.lit(-1).alias("seq"), F.lit("refused").alias("disposition"), text.alias("kind"), none.alias("root_ord"), F.col("tab_path").alias("path"), text.alias("previous_path"), F.concat(F.lit("a tab of "), "directory").alias("reason"))
    return documents.select(columns).unionByName(edits).unionByName(refused), mine.select("ord")


def plan_changes(changes: DataFrame, roots: DataFrame, index: DataFrame, index_path: str = ".doclens/index") -> DataFrame:
    """ord, seq, disposition (root, refused, local), kind, root_ord, path, previous_path, reason.

    changes: ord, status (A, M, T, D, R, R100), path, previous_path, has_head (the text starts with front matter),
    own_id (the id its front matter names). roots: root_ord, root_path, source, read_only, suggest. index: path,
    type, read_only, ref. The first rule that a change meets decides; a change can become two rows. What becomes of whole
    directories of tabs is decided before.
    """
    of_tabs, done = tab_directory_plan(changes, roots, index)
    changes = changes.join(done, "ord", "left_anti")
    facts = index.select(F.col("path").alias("_ip"), F.col("type").alias("type"), F.coalesce("read_only", F.lit(False)).alias("export"))
    rows = _with_root(_with_root(changes, roots, "path", "n_"), roots, "previous_path", "p_")
    rows = rows.join(facts.withColumnsRenamed({"_ip": "path", "type": "n_type", "export": "n_export"}), "path", "left")
    rows = rows.join(facts.withColumnsRenamed({"_ip": "previous_path", "type": "p_type", "export": "p_export"}), "previous_path", "left")
    holders = index.where("ref is not null").groupBy(F.col("ref").alias("own_id")).agg(F.min("path").alias("holder"))
    rows = rows.join(holders, "own_id", "left")

    col, no = F.col, F.lit(False)
    letter = F.left("status", F.lit(1))
    yes = lambda c: F.coalesce(c, no)
    edit = lambda kind: letter.isin("M", "T") & (col(kind) == "gdoc")
    document = lambda kind: yes(col(kind).isin("gdoc", "notion-page"))
    markdown = F.endswith("path", F.lit(".md"))
    inside = col("n_root").isNotNull()
    rename_known = (letter == "R") & inside & col("n_root").eqNullSafe(col("p_root")) & col("p_type").isNotNull()
    flips = letter.isin("A", "M", "T") & col("n_type").isNotNull() & markdown & (document("n_type") != col("has_head"))
    adds = (letter == "R") & ~rename_known | letter.isin("A", "M", "T") & (col("n_type").isNull() | flips)
    notion = col("n_source") == "notion"
    refused = (
        F.when((col("path") == index_path) | yes(col("previous_path") == index_path), "the index is not edited")
        .when(yes(col("p_locked")) | yes(col("n_locked")), "read-only root")
        .when(yes(is_sidecar(col("previous_path")) & col("p_root").isNotNull()) | (is_sidecar(col("path")) & inside), "sidecars are read-only")
        .when(yes(col("p_suggest") & ~yes(edit("p_type"))) | yes(col("n_suggest") & ~yes(edit("n_type"))), "suggest root")
        .when((letter == "D") | ~inside, F.lit(None))
        .when(rename_known & yes(col("p_export")) & (col("status") != "R100"), "read-only export")
        .when(letter.isin("A", "M", "T") & yes(col("n_export")), "read-only export")
        .when(flips & yes(col("n_suggest")), "suggest root")
        .when(adds & notion & ~markdown & asset_document(col("path")).isNull(), "no files under a page root")
        .when(adds & notion & markdown & ~col("has_head"), "a page needs front matter")
        .when(adds & markdown & col("has_head") & col("holder").isNotNull(), "id already checked out")
    )
    row = lambda disposition, kind, root, path, old=F.lit(None).cast("string"): F.struct(F.lit(disposition).alias("disposition"), F.lit(kind).alias("kind"), root.alias("root_ord"), path.alias("path"), old.alias("previous_path"))
    none = F.lit(None).cast("int")
    moved_out = (letter == "R") & col("p_root").isNotNull()
    plan = (
        F.when(col("refused").isNotNull(), F.array(row("refused", None, none, col("path"))))
        .when((letter == "D") & ~inside, F.array(row("local", None, none, col("path"))))
        .when(letter == "D", F.array(row("root", "deleted", col("n_root"), col("path"))))
        .when(~inside & moved_out, F.array(row("root", "deleted", col("p_root"), col("previous_path")), row("local", None, none, col("path"))))
        .when(~inside, F.array(row("local", None, none, col("path"))))
        .when(rename_known, F.array(row("root", "renamed", col("n_root"), col("path"), col("previous_path"))))
        .when(adds & moved_out, F.array(row("root", "deleted", col("p_root"), col("previous_path")), row("root", "added", col("n_root"), col("path"))))
        .when(flips, F.array(row("root", "deleted", col("n_root"), col("path")), row("root", "added", col("n_root"), col("path"))))
        .when(adds, F.array(row("root", "added", col("n_root"), col("path"))))
        .otherwise(F.array(row("root", "modified", col("n_root"), col("path"))))
    )
    out = rows.withColumn("refused", refused).withColumn("plan", plan).select("ord", F.col("refused").alias("reason"), F.posexplode("plan").alias("seq", "p"))
    return out.select("ord", "seq", "p.disposition", "p.kind", "p.root_ord", "p.path", "p.previous_path", "reason").unionByName(of_tabs)


def first_refusal(plan: DataFrame) -> DataFrame:
    """The refusal that is told: of tabs before any of a single change, then the first."""
    return plan.where("disposition = 'refused'").orderBy(F.col("seq") >= 0, "ord").limit(1)


def request_order(insert_phase: int = 1) -> list[Column]:
    """Later places first, then by phase; insertions at one place last planned first."""
    return [F.col("index").desc(), F.col("phase"), F.when(F.col("phase") == insert_phase, -F.col("order")).otherwise(F.col("order"))]


def append_chunks(blocks: DataFrame, key: str, order: str, size: int = 100) -> DataFrame:
    """blocks with the number of the append request that carries each."""
    return blocks.withColumn("chunk", F.floor((F.row_number().over(Window.partitionBy(key).orderBy(order)) - 1) / size).cast("int"))


def split_runs(runs: DataFrame, size: int = 2000, text: str = "text") -> DataFrame:
    """Runs longer than a request may hold as pieces of at most `size` UTF-16 units: piece, text.

    Where a cut would fall inside a character of two units, the run's cuts are a unit closer, and such a character goes
    whole to the piece before or behind.
    """

    def pieces(utf16: Column) -> Column:
        n = (F.octet_length(utf16) / 2).cast("int")
        cuts = lambda step: F.transform(F.sequence(F.lit(0), F.greatest(F.floor((n - 1) / step), F.lit(0)).cast("int")), lambda k: k * step)
        split = F.exists(cuts(size), lambda at: low_half(utf16, at))
        cut = lambda step: F.transform(cuts(step), lambda at: utf16_slice(F.col(text), at, F.least(at + step, n)))
        plain = F.octet_length(utf16) == 2 * F.length(text)
        return F.when(plain, F.transform(cuts(size), lambda at: F.substring(F.col(text), at + 1, F.lit(size)))).when(split, cut(size - 1)).otherwise(cut(size))

    return runs.select(*(c for c in runs.columns if c != text), F.posexplode(let(F.encode(text, "UTF-16LE"), pieces)).alias("piece", text))


def cap_runs(runs: DataFrame, key: str, order: str, most: int = 100, size: int = 2000, text: str = "text") -> DataFrame:
    """At most so many runs a block: key, order, text, plain. Beyond, the last one holds the texts of all that are left, as
    far as a run goes, without their styles."""
    turn = F.row_number().over(Window.partitionBy(key).orderBy(order))
    placed = runs.select(key, order, text, turn.alias("_turn"), F.count("*").over(Window.partitionBy(key)).alias("_n"))
    kept = placed.where((F.col("_n") <= most) | (F.col("_turn") < most)).select(key, order, text, F.lit(False).alias("plain"))
    tail = placed.where((F.col("_n") > most) & (F.col("_turn") >= most))
    rest = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_turn", text))), lambda x: x[text]), "")
    joined = tail.groupBy(key).agg(F.min(order).alias(order), rest.alias("_all"))
    return kept.unionByName(joined.select(key, order, utf16_slice(F.col("_all"), F.lit(0), F.least(F.lit(size), (F.octet_length(F.encode("_all", "UTF-16LE")) / 2).cast("int"))).alias(text), F.lit(True).alias("plain")))


def orphaned_links(links: DataFrame, deleted: DataFrame) -> DataFrame:
    """Links (document, target) of documents that stay to assets that go."""
    return links.join(deleted.select(F.col("path").alias("target")), "target", "left_semi").join(deleted.select(F.col("path").alias("document")), "document", "left_anti")


def duplicate_ids(added: DataFrame, index: DataFrame) -> DataFrame:
    return added.join(index.select("ref", F.col("path").alias("held_by")), "ref")


def forward_links(links: DataFrame, added: DataFrame) -> DataFrame:
    """Links between new documents whose target is made later: they need a second pass. added: path, ord."""
    own = added.select(F.col("path").alias("document"), F.col("ord").alias("own_ord"))
    target = added.select(F.col("path").alias("target"), F.col("ord").alias("target_ord"))
    return links.join(own, "document").join(target, "target").where("target_ord > own_ord")


def needed_assets(ops: DataFrame) -> DataFrame:
    """Assets of the blocks that are written: ops (key, op, links)."""
    return ops.where(F.col("op").isin("insert", "move", "update")).select("key", F.explode("links").alias("asset")).distinct()


def parent_of(paths: DataFrame, known: DataFrame) -> DataFrame:
    """The document a new path hangs under: its folder's document, or null for the root."""
    folder = F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)
    return paths.withColumn("_doc", F.concat(folder, F.lit(".md"))).join(known.select(F.col("path").alias("_doc"), F.col("id").alias("parent_id")), "_doc", "left").drop("_doc")


def longest_folder(paths: DataFrame, folders: DataFrame) -> DataFrame:
    """paths with the longest folder (ending in a slash) that holds each, null for none."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.concat(F.array_join(F.slice(parts, 1, n), "/"), F.lit("/")))
    each = paths.where(F.size(parts) > 1).select("path", F.explode(above).alias("folder"))
    held = each.join(folders.select("folder"), "folder", "left_semi").groupBy("path").agg(F.max_by("folder", F.length("folder")).alias("folder"))
    return paths.join(held, "path", "left")


def is_ancestor(commits: DataFrame, ancestor: str, descendant: str) -> bool:
    """Whether a commit is reached from another by parents: commits (commit, parent).

    A job for each doubling of the distance: links between ever farther ancestors are joined with themselves, so that a
    history of any length takes few of them.
    """
    if ancestor == descendant:
        return True
    edges = commits.where("parent is not null").select(F.col("commit").alias("low"), F.col("parent").alias("high")).distinct()
    links, reached = edges, commits.sparkSession.createDataFrame([(descendant,)], "low string")
    seen = 1
    while True:
        step = reached.join(links, "low").select(F.col("high").alias("low"))
        reached = cut(reached.unionByName(step).distinct())
        n = reached.count()
        if not reached.where(F.col("low") == ancestor).isEmpty():
            return True
        if n == seen:
            return False
        seen = n
        links = cut(links.unionByName(links.alias("a").join(links.alias("b"), F.col("a.high") == F.col("b.low")).select("a.low", "b.high")).distinct())


def push_report(actions: DataFrame) -> DataFrame:
    """A line per document, trashed last: path, line. actions: path, action, uploaded, skipped (arrays)."""
    n = F.size("uploaded")
    line = F.concat(F.col("action"), F.lit(" "), F.col("path"), F.when(n > 0, F.concat(F.lit(", "), n.cast("string"), F.lit(" uploaded"))).otherwise(F.lit("")), F.when(F.size("skipped") > 0, F.concat(F.lit("; skipped "), F.array_join("skipped", ", "))).otherwise(F.lit("")))
    return actions.select("path", (F.col("action") == "trashed").alias("last"), line.alias("line")).orderBy("last", "path")


def creation_order(paths: DataFrame, key: str, path: str = "path") -> DataFrame:
    """paths with `turn`: documents are made by path, in the order of code points, whatever the locale; parents precede."""
    return paths.withColumn("turn", F.row_number().over(Window.partitionBy(key).orderBy(path)))


def stale_documents(changes: DataFrame, moved: DataFrame) -> DataFrame:
    """Changes (ord, path) to documents that moved at their source since they were fetched: a push refuses these."""
    return changes.join(moved.select("path").distinct(), "path", "left_semi").withColumn("reason", F.lit("changed since the last fetch"))


def write_report(rows: DataFrame, folder: str) -> bool:
    """A run's report as one JSON file; says whether it could be written, and never fails the run."""
    try:
        rows.coalesce(1).write.mode("overwrite").json(folder)
    except Exception:  # a report is worth less than the run it reports on
        logging.getLogger(__name__).warning("no report in %s", folder, exc_info=True)
        return False
    return True
