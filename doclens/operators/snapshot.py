"""Snapshots of a collection: what changed, what is gone, under which root, by whom, and the trees they make."""

from __future__ import annotations

import uuid
from functools import reduce

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from doclens.functions.paths import is_sidecar, parents, territory_of
from doclens.operators.lineage import cut


def has_changed(found: Column, time: Column, old_time: Column, checksum: Column, old_checksum: Column) -> Column:
    """New, or another time (compared as text), or another checksum where there is one."""
    return found.isNull() | ~time.eqNullSafe(old_time) | (checksum.isNotNull() & ~checksum.eqNullSafe(old_checksum))


def changes_since(current: DataFrame, previous: DataFrame, key: str = "id", time: str = "time", checksum: str = "md5") -> DataFrame:
    """current's rows with `change`: added or modified; unchanged rows are left out. One hash join."""
    old = previous.select(F.col(key).alias("_key"), F.col(time).alias("_time"), F.col(checksum).alias("_sum"))
    joined = current.join(old, current[key] == old["_key"], "left")
    changed = has_changed(F.col("_key"), F.col(time), F.col("_time"), F.col(checksum), F.col("_sum"))
    return joined.where(changed).withColumn("change", F.when(F.col("_key").isNull(), "added").otherwise("modified")).drop("_key", "_time", "_sum")


def gone(current: DataFrame, previous: DataFrame, key: str = "id") -> DataFrame:
    return previous.join(current.select(key), key, "left_anti")


def changes_and_gone(current: DataFrame, previous: DataFrame, columns: list[str], key: str = "id", time: str = "time", checksum: str = "md5") -> DataFrame:
    """Both in one full outer join: key, columns, change."""
    cur, prev = current.alias("c"), previous.alias("p")
    c, p = (lambda x: F.col(f"c.{x}")), (lambda x: F.col(f"p.{x}"))
    joined = cur.join(prev, c(key) == p(key), "full_outer")
    change = F.when(c(key).isNull(), "deleted").when(p(key).isNull(), "added").when(has_changed(p(key), c(time), p(time), c(checksum), p(checksum)), "modified")
    return joined.select(F.coalesce(c(key), p(key)).alias(key), *(F.coalesce(c(x), p(x)).alias(x) for x in columns), change.alias("change")).where("change is not null")


def assign_roots(paths: DataFrame, roots: DataFrame, path: str = "path") -> DataFrame:
    """paths with root_ord and root_path of the first root that claims them, null for none.

    An equality join on the prefixes of a path, so roots need not be few; a root depends on the path alone, so each
    different path is looked up once. roots: root_ord, root_path.
    """
    own = roots.select("root_ord", "root_path", F.explode(F.array_distinct(F.array(territory_of(F.col("root_path")), F.col("root_path")))).alias("_claim"), territory_of(F.col("root_path")).alias("_territory"))
    parts = F.split("_path", "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    claims = paths.select(F.col(path).alias("_path")).distinct().select("_path", F.explode(prefixes).alias("_claim")).join(own, "_claim")
    claims = claims.where((F.col("_claim") == F.col("_territory")) | (F.col("_path") == F.col("_claim")))
    first = claims.groupBy("_path").agg(F.min(F.struct("root_ord", "root_path")).alias("_first"))
    return paths.join(first, paths[path] == first["_path"], "left").select(*paths.columns, F.col("_first.root_ord").alias("root_ord"), F.col("_first.root_path").alias("root_path"))


def carried_over(tree: DataFrame, roots: DataFrame) -> DataFrame:
    """Rows of the tree under no root: they come along untouched."""
    return assign_roots(tree, roots).where("root_ord is null").select(*tree.columns)


def changed_per_root(changes: DataFrame) -> DataFrame:
    return changes.groupBy("root_ord").agg(F.count("*").alias("changed"))


def commit_author(changes: DataFrame, time: str = "time", order: tuple[str, ...] = ("root_ord", "file_ord"), editor: str = "editor") -> DataFrame:
    """The row that gives the commit its author: the latest with an editor, of ties the first in order."""
    least = F.struct(*(F.col(x) for x in order))
    latest = changes.where(F.col(editor).isNotNull())
    best = latest.groupBy(time).agg(F.min_by(F.struct(editor, *order), least).alias("first"))
    return best.orderBy(F.desc(time)).limit(1).select("first.*", time)


def tree_diff(before: DataFrame, after: DataFrame) -> DataFrame:
    """Paths whose blob differs, and paths that are gone."""
    a, b = before.select("path", F.col("sha").alias("old_sha")), after.select("path", F.col("sha").alias("new_sha"))
    return a.join(b, "path", "full_outer").where(~F.col("old_sha").eqNullSafe(F.col("new_sha")))


def same_tree(before: DataFrame, after: DataFrame) -> bool:
    return tree_diff(before, after).isEmpty()


def commit_message(first: bool, changed: DataFrame, suggested: DataFrame | None = None) -> DataFrame:
    """One row: n, kind (index, suggested, comments, add, update) of the changed document paths. suggested: documents
    that the push before this fetch wrote suggestions to."""
    verb = "add" if first else "update"
    wrote = F.lit(suggested is not None and not suggested.isEmpty())
    kind = F.when(F.count("*") == 0, "index").when(wrote, "suggested").when(F.lit(not first) & F.bool_and(is_sidecar(F.col("path"))), "comments").otherwise(verb)
    return changed.agg(F.count("*").alias("n"), kind.alias("kind"))


def overlay(*layers: DataFrame, key: str = "path") -> DataFrame:
    """Layers written over each other, the last wins; map-side combined."""
    all_rows = None
    for n, layer in enumerate(layers):
        layer = layer.withColumn("_layer", F.lit(n))
        all_rows = layer if all_rows is None else all_rows.unionByName(layer)
    rest = [c for c in layers[0].columns if c != key]
    top = all_rows.groupBy(key).agg(F.max_by(F.struct(*rest), "_layer").alias("_top"))
    return top.select(key, "_top.*")


def exact_renames(before: DataFrame, after: DataFrame) -> DataFrame:
    """Deleted paths met by added paths with the same blob; of several the k-th by path takes the k-th."""
    turn = F.row_number().over(Window.partitionBy("sha").orderBy("path"))
    removed = before.join(after.select("path"), "path", "left_anti").select("sha", F.col("path").alias("previous_path"), turn.alias("turn"))
    added = after.join(before.select("path"), "path", "left_anti").select("sha", "path", turn.alias("turn"))
    return removed.join(added, ["sha", "turn"]).select("previous_path", "path", "sha")


def rename_scores(removed: DataFrame, added: DataFrame, least: float = 0.5) -> DataFrame:
    """previous_path, path, score of removed and added files (path, text) whose shared lines are at least `least` of the
    longer one, by characters, line ends included.

    Two such files share a line among those of either that come first by rarity and hold more than the rest may: only
    these propose pairs, so that a line that many files have proposes none that others do not.
    """
    own = lambda rows, name: rows.select(F.col("path").alias(name), F.explode(F.split("text", "\n")).alias("line")).groupBy(name, "line").agg(F.count("*").alias("n")).withColumn("weight", F.col("n") * (F.length("line") + 1))
    old, new = own(removed, "previous_path"), own(added, "path")
    common = old.groupBy("line").agg(F.count("*").alias("held")).unionByName(new.groupBy("line").agg(F.count("*").alias("held"))).groupBy("line").agg(F.sum("held").alias("held"))
    sizes = lambda rows, name: rows.groupBy(name).agg(F.sum("weight").alias(f"{name}_size"))

    def first(rows: DataFrame, name: str) -> DataFrame:
        by_rarity = Window.partitionBy(name).orderBy("held", "line").rowsBetween(Window.unboundedPreceding, -1)
        ranked = rows.join(common, "line").withColumn("before", F.coalesce(F.sum("weight").over(by_rarity), F.lit(0)))
        return ranked.join(sizes(rows, name), name).where(F.col(f"{name}_size") - F.col("before") >= least * F.col(f"{name}_size")).select(name, "line")

    pairs = first(old, "previous_path").join(first(new, "path"), "line").select("previous_path", "path").distinct()
    shared = pairs.join(old.select("previous_path", "line", "weight"), "previous_path").join(new.select("path", "line", F.col("weight").alias("other")), ["path", "line"])
    summed = shared.groupBy("previous_path", "path").agg(F.sum(F.least("weight", "other")).alias("shared"))
    scored = summed.join(sizes(old, "previous_path"), "previous_path").join(sizes(new, "path"), "path")
    return scored.withColumn("score", F.col("shared") / F.greatest("previous_path_size", "path_size")).where(F.col("score") >= least).select("previous_path", "path", "score")


def similar_renames(removed: DataFrame, added: DataFrame, least: float = 0.5) -> DataFrame:
    """previous_path, path, score: each file in one pair at most, the best scores first, of ties the first by paths.

    Rounds of pairs that are the best for both of their files; an approximation of git's own measure.
    """
    open_, done = cut(rename_scores(removed, added, least)), []
    while not open_.isEmpty():
        rank = lambda one, other: F.row_number().over(Window.partitionBy(one).orderBy(F.desc("score"), "previous_path", "path"))
        best = cut(open_.withColumn("a", rank("previous_path", "path")).withColumn("b", rank("path", "previous_path")).where("a = 1 and b = 1").drop("a", "b"))
        done.append(best)
        open_ = cut(open_.join(best.select("previous_path"), "previous_path", "left_anti").join(best.select("path"), "path", "left_anti"))
    return reduce(DataFrame.unionByName, done, open_.select("previous_path", "path", "score"))


def implied_folders(paths: DataFrame, existing: DataFrame, path: str = "path") -> DataFrame:
    """Folders that new paths need and that do not exist."""
    above = F.transform(F.sequence(F.lit(1), F.size(parents(F.col(path)))), lambda n: F.array_join(F.slice(parents(F.col(path)), 1, n), "/"))
    needed = paths.where(F.size(parents(F.col(path))) > 0).select(F.explode(above).alias("folder")).distinct()
    return needed.join(existing.select("folder"), "folder", "left_anti")


class Moved(RuntimeError):
    """What a push was planned on is not the last snapshot any more."""


def refuse_if_moved(planned_on: int | None, last: int | None) -> None:
    """Optimistic concurrency: a plan holds only while the snapshot it was made on is the last one."""
    if planned_on != last:
        raise Moved(f"planned on snapshot {planned_on}, the last is {last}: fetch first")


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that is not there yet; False where it is. Of several writers one succeeds: by the operating
    system on local disks, by the store's own creation without overwriting elsewhere."""
    jvm = spark._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    fs = target.getFileSystem(spark._jsc.hadoopConfiguration())
    fs.mkdirs(target.getParent())
    if fs.getScheme() == "file":
        try:
            with open(fs.makeQualified(target).toUri().getPath(), "x") as out:
                out.write(text)
        except FileExistsError:
            return False
        return True
    try:
        out = fs.create(target, False)
    except Py4JJavaError as error:
        if "FileAlreadyExists" in error.java_exception.getClass().getName():
            return False
        raise
    out.write(text.encode())
    out.close()
    return True


def finish_commit(spark: SparkSession, folder: str, snapshot_id: int) -> None:
    """Bring the table that a claim names to its place, where its writer did not."""
    jvm = spark._jvm
    at = lambda name: jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    fs = at("").getFileSystem(spark._jsc.hadoopConfiguration())
    staged = spark.read.text(f"{folder}/_claims/{snapshot_id}").first()[0]
    if fs.exists(at(staged)):
        fs.rename(at(staged), at(f"snapshot_id={snapshot_id}"))


def commit_snapshot(previous: DataFrame | None, current: DataFrame, folder: str, snapshot_id: int) -> bool:
    """Write current as snapshot `snapshot_id` of the table in `folder` unless it equals previous; says whether it did.

    The rows are written aside; who then creates the claim of the number has it, and moves them to their place. Others
    find it taken: what they planned on is not the last snapshot any more. A writer that is lost before its claim leaves
    nothing that is read; one lost behind it is finished by whoever tries the number next.
    """
    if previous is not None and same_tree(previous, current):
        return False
    spark = current.sparkSession
    staged = f"_staged-{uuid.uuid4().hex}"
    current.write.parquet(f"{folder}/{staged}")
    won = create_once(spark, f"{folder}/_claims/{snapshot_id}", staged)
    finish_commit(spark, folder, snapshot_id)
    if not won:
        path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{staged}")
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
        raise Moved(f"snapshot {snapshot_id} is taken: fetch first")
    return True


def index_rows(snapshot: DataFrame) -> DataFrame:
    """The index in its fixed order of rows and fields: rows by the UTF-16 units of their paths."""
    fields = ["path", "source", "id", "type", "last_edited_raw", "read_only", "md5", "suggested", "document", "checksum"]
    return snapshot.select(*(f for f in fields if f in snapshot.columns)).orderBy(F.encode("path", "UTF-16BE"))




def root_overlaps(roots: DataFrame) -> DataFrame:
    """root_ord, other_ord: the first earlier root that a root duplicates or overlaps, letter case aside.

    Equality joins with the first root of each path, territory and folder above a root, so that it does not compare all
    pairs, not even of equal paths.
    """
    path = F.lower("root_path")
    keyed = roots.select("root_ord", path.alias("path"), F.regexp_replace(path, "/$", "").alias("bare"), territory_of(path).alias("territory"))
    above = F.transform(F.sequence(F.lit(1), F.size(F.split("bare", "/")) - 1), lambda n: F.array_join(F.slice(F.split("bare", "/"), 1, n), "/"))
    inside = keyed.where(F.size(F.split("bare", "/")) > 1).select("root_ord", F.explode(above).alias("territory"))
    # only the first root of a path or territory, and of what lies in a territory, can be the first that overlaps
    first = lambda rows, key: rows.groupBy(key).agg(F.min("root_ord").alias("other_ord"))
    within = inside.join(first(keyed, "territory"), "territory")
    holds = keyed.select("root_ord", "territory").join(first(inside, "territory"), "territory")
    same = keyed.select("root_ord", "path").join(first(keyed, "path"), "path")
    found = reduce(DataFrame.unionByName, (rows.where("other_ord < root_ord").select("root_ord", "other_ord") for rows in (within, holds, same)))
    return found.groupBy("root_ord").agg(F.min("other_ord").alias("other_ord"))
