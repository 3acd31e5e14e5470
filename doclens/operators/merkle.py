"""Trees with hashes of their folders: two are equal if one row is, and a difference reads only folders that differ.

The hash of a folder is the exclusive or of the digests of all files below it (path and blob), so that it is summed up in
tasks before anything is exchanged, whatever the size of a folder. It tells versions of one tree apart; it is no defence
against trees that are made to collide.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from doclens.operators.snapshot import tree_diff

#: Folders of files are dealt over so many directories of a written tree.
SHARDS = 64


def folder_of(path: Column) -> Column:
    """The folder that holds a path; empty at the top."""
    return F.when(F.contains(path, F.lit("/")), F.regexp_replace(path, "(?s)/[^/]*$", "")).otherwise("")


def shard_of(folder: Column) -> Column:
    return F.pmod(F.xxhash64(folder), F.lit(SHARDS)).cast("int")


def folder_hashes(files: DataFrame) -> DataFrame:
    """folder, files, hash, own_hash of every folder of a tree (path, sha), the empty one included: of all files below it,
    and of those right in it. A null blob is one like others; a path counts once for each of its rows."""
    parts = F.split(F.col("path"), "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    digest = F.sha2(F.to_json(F.struct("path", "sha"), {"ignoreNullFields": "false"}), 256)
    numbers = [F.conv(F.substring(digest, 15 * k + 1, 15), 16, 10).cast("long").alias(f"d{k}") for k in range(4)]
    each = files.select("path", *numbers, folder_of(F.col("path")).alias("_own"), F.explode(above).alias("folder"))
    own = F.col("_own") == F.col("folder")
    sums = [F.bit_xor(f"d{k}").alias(f"d{k}") for k in range(4)] + [F.coalesce(F.bit_xor(F.when(own, F.col(f"d{k}"))), F.lit(0)).alias(f"o{k}") for k in range(4)]
    hexed = lambda letter: F.concat(*(F.lpad(F.hex(f"{letter}{k}"), 15, "0") for k in range(4)))
    return each.groupBy("folder").agg(F.count("*").alias("files"), *sums).select("folder", "files", hexed("d").alias("hash"), hexed("o").alias("own_hash"))


def changed_folders(before: DataFrame, after: DataFrame) -> DataFrame:
    """folder, own: folders (of folder_hashes()) with a file below that differs; own says that one right in it does."""
    a = before.select("folder", F.col("hash").alias("a"), F.col("own_hash").alias("a_own"))
    b = after.select("folder", F.col("hash").alias("b"), F.col("own_hash").alias("b_own"))
    met = a.join(b, "folder", "full_outer").where(~F.col("a").eqNullSafe(F.col("b")))
    empty = F.lit("0" * 60)
    return met.select("folder", (F.coalesce("a_own", empty) != F.coalesce("b_own", empty)).alias("own"))


def write_tree(files: DataFrame, folder: str) -> None:
    """A tree as tables: its files (path, sha), dealt by their folder, and the hashes of its folders."""
    files.select("path", "sha", shard_of(folder_of(F.col("path"))).alias("shard")).repartition("shard").write.partitionBy("shard").parquet(f"{folder}/files")
    folder_hashes(files).write.parquet(f"{folder}/folders")


def same_written_tree(spark: SparkSession, before: str, after: str) -> bool:
    """Whether two written trees are equal: the row of their top."""
    top = [[tuple(r) for r in spark.read.parquet(f"{x}/folders").where("folder = ''").select("files", "hash").collect()] for x in (before, after)]
    return top[0] == top[1]


def written_diff(spark: SparkSession, before: str, after: str) -> DataFrame:
    """path, old_sha, new_sha of what differs between two written trees. Of their files only the directories are read that
    hold a folder of which a file differs."""
    moved = changed_folders(*(spark.read.parquet(f"{x}/folders") for x in (before, after))).where("own").select("folder", shard_of(F.col("folder")).alias("shard"))
    shards = [r["shard"] for r in moved.select("shard").distinct().collect()]  # at most SHARDS numbers

    def files(tree: str) -> DataFrame:
        read = spark.read.schema("path string, sha string, shard int").parquet(f"{tree}/files").where(F.col("shard").isin(shards))
        return read.withColumn("folder", folder_of(F.col("path"))).join(moved.select("folder"), "folder", "left_semi").select("path", "sha")

    return tree_diff(files(before), files(after))
