"""The verbs over one checkout: roots are added and removed, what changed is listed, pushes are previewed."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from doclens.functions.paths import path_problem, resolve_alias
from doclens.functions.refs import format_ref, parse_literal, parse_url, split_spec
from doclens.operators import plan, snapshot

ROOTS = ["root_ord", "source", "id", "root_path", "read_only", "suggest"]


@dataclass
class Workspace:
    """roots: root_ord, source, id, root_path, read_only, suggest. index: the last snapshot, or None before the first."""

    roots: DataFrame
    index: DataFrame | None = None

    @classmethod
    def create(cls, spark) -> Workspace:
        return cls(spark.createDataFrame([], "root_ord int, source string, id string, root_path string, read_only boolean, suggest boolean"))

    def resolve(self, specs: DataFrame, objects: DataFrame) -> DataFrame:
        """specs (ord, spec, read_only, suggest) -> with source, id, root_path, problem. objects: source, id, title, container, ext."""
        parts = specs.withColumn("s", split_spec(F.col("spec"))).withColumn("l", parse_literal(F.col("s.text"))).withColumn("u", parse_url(F.col("s.text")))
        found = parts.select("ord", "spec", "read_only", "suggest", F.col("s.alias").alias("alias"), F.coalesce("l.source", "u.source").alias("source"), F.coalesce("l.id", "u.id").alias("id"), F.col("l.problem").alias("bad"))
        met = found.join(objects, ["source", "id"], "left").withColumn("a", resolve_alias(F.col("alias"), F.col("title"), F.col("container"), F.col("ext")))
        problem = F.when(F.col("id").isNull(), F.coalesce("bad", F.lit("not a reference"))).when(F.col("title").isNull(), "no such object").otherwise(F.col("a.problem"))
        return met.select("ord", "spec", "source", "id", F.col("a.path").alias("root_path"), "read_only", "suggest", problem.alias("problem"))

    def add(self, specs: DataFrame, objects: DataFrame) -> tuple[Workspace, DataFrame]:
        """The workspace with the roots that can be added, and the problems of all specs; with a problem nothing is added."""
        resolved = self.resolve(specs, objects)
        first = self.roots.agg(F.coalesce(F.max("root_ord") + 1, F.lit(0))).first()[0]
        fresh = resolved.where("problem is null").select((F.col("ord") + first).cast("int").alias("root_ord"), "source", "id", "root_path", "read_only", "suggest")
        joined = self.roots.select(ROOTS).unionByName(fresh)
        clashes = snapshot.root_overlaps(joined).join(fresh, "root_ord", "left_semi").select(F.concat(F.lit("root "), F.col("root_ord").cast("string")).alias("spec"), F.concat(F.lit("overlaps root "), F.col("other_ord").cast("string")).alias("problem"))
        problems = resolved.where("problem is not null").select("spec", "problem").unionByName(clashes)
        return (self if not problems.isEmpty() else Workspace(joined, self.index)), problems

    def remove(self, refs: DataFrame) -> Workspace:
        """Without the roots named by reference or path (column `name`); their files become local."""
        own = self.roots.withColumn("ref", format_ref(F.col("source"), F.col("id")))
        left = own.join(refs.select(F.col("name").alias("ref")), "ref", "left_anti").join(refs.select(F.col("name").alias("root_path")), "root_path", "left_anti")
        return Workspace(left.select(ROOTS), self.index)

    def changes(self, listing: DataFrame, everything: bool = False) -> DataFrame:
        """listing's rows to read: changed since the index, under suggest roots always, all of them if asked. `change` is
        re-read where nobody edited the object: such a row authors no commit."""
        placed = snapshot.assign_roots(listing, self.roots.select("root_ord", "root_path")).drop("root_path")
        if self.index is None:
            return placed.withColumn("change", F.lit("added"))
        moved = snapshot.changes_since(placed, self.index)
        if everything:
            edited = moved.select("id", F.col("change").alias("_edited"))
            return placed.join(edited, "id", "left").withColumn("change", F.coalesce("_edited", F.lit("re-read"))).select(moved.columns)
        always = placed.join(self.roots.where("suggest").select("root_ord"), "root_ord", "left_semi").withColumn("change", F.lit("re-read"))
        return moved.unionByName(always.join(moved.select("id"), "id", "left_anti").select(moved.columns))

    def status(self, listing: DataFrame) -> DataFrame:
        """root_path, changed, gone per root."""
        new = snapshot.changed_per_root(self.changes(listing))
        lost = snapshot.gone(listing, self.index) if self.index is not None else listing.limit(0)
        lost = snapshot.assign_roots(lost.select("path"), self.roots.select("root_ord", "root_path")).groupBy("root_ord").agg(F.count("*").alias("gone"))
        return self.roots.select("root_ord", "root_path").join(new, "root_ord", "left").join(lost, "root_ord", "left").fillna(0, ["changed", "gone"])

    def fetch(self, listing: DataFrame, everything: bool = False) -> tuple[Workspace, DataFrame]:
        """The workspace with the listing as its index, and what was read."""
        return Workspace(self.roots, listing), self.changes(listing, everything)

    def preview(self, changes: DataFrame, index: DataFrame) -> DataFrame:
        """What a push would do; the push itself uses the same plan."""
        return plan.plan_changes(changes, self.roots, index)

    def check(self) -> DataFrame:
        """root_path, problem of roots whose path is not valid."""
        return self.roots.select("root_path", path_problem(F.col("root_path")).alias("problem")).where("problem is not null")
