"""Incremental fetches: a stream of listings against the last snapshot, committed once per batch that changes anything."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from doclens.operators.snapshot import overlay, tree_diff


def numbers(spark, folder: str) -> list[int]:
    """The numbers of the snapshots in a table of snapshots, in order; none before the first. Read off folder names."""
    jvm = spark._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path):
        return []
    names = [x.getPath().getName() for x in fs.listStatus(path) if x.isDirectory()]
    done = lambda n: fs.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("snapshot_id=") and done(n))


def latest(spark, folder: str, before: int | None = None) -> DataFrame | None:
    """The newest snapshot, or the newest of those numbered under `before`; None where there is none."""
    known = [n for n in numbers(spark, folder) if before is None or n < before]
    return spark.read.parquet(f"{folder}/snapshot_id={known[-1]}") if known else None


def fold_listings(listings: DataFrame, folder: str, checkpoint: str, suggest_all: bool = False) -> StreamingQuery:
    """Write each batch of (path, sha, ...) over the last snapshot; a batch that changes nothing writes nothing.

    A row with a null sha says that its path is gone. Snapshots are numbered on from those that the folder has when the
    query's first batch comes; that first number is kept beside the query's checkpoint, so that a batch that runs again,
    also after a restart, replaces its own snapshot and folds over the one before it, while a query with a new
    checkpoint appends.
    """

    def first_number(spark) -> int:
        note = f"{checkpoint}/first-snapshot"
        kept = spark._jvm.org.apache.hadoop.fs.Path(note)
        if not kept.getFileSystem(spark._jsc.hadoopConfiguration()).exists(kept):
            known = numbers(spark, folder)
            spark.createDataFrame([(known[-1] + 1 if known else 0,)], "n long").coalesce(1).write.mode("overwrite").json(note)
        return spark.read.schema("n long").json(note).first()["n"]

    def commit(batch: DataFrame, number: int) -> None:
        spark = batch.sparkSession
        number += first_number(spark)
        before = latest(spark, folder, number)
        after = batch if before is None else overlay(before.select(batch.columns), batch)
        after = after.where("sha is not null")
        if before is not None and not suggest_all and tree_diff(before, after).isEmpty():
            return
        after.write.mode("overwrite").parquet(f"{folder}/snapshot_id={number}")

    return listings.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
