"""Ordered runs: islands of lists, merging of equal styles, interval differences, numbering."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.operators.intervals import TEXT_CELL, subtract


def islands(rows: DataFrame, value: Column, key: str, order: str) -> DataFrame:
    """rows with `island`: a number per run of equal values within the key."""
    w = Window.partitionBy(key).orderBy(order)
    changed = F.when(value.eqNullSafe(F.lag(value).over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("_changed", changed).withColumn("island", F.sum("_changed").over(w)).drop("_changed")


def list_group(type_: Column) -> Column:
    """Bulleted items and to-dos are one list, numbered items another; anything else is its own type."""
    return F.when(type_.isin("bulleted_list_item", "to_do"), "bullets").otherwise(type_)


def merge_runs(runs: DataFrame, styles: list[str], key: str = "doc_id", order: str = "ord") -> DataFrame:
    """Adjacent runs of one style as one: key, island, text and the styles."""
    marked = islands(runs, F.struct(*styles), key, order)
    text = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(order, "text"))), lambda x: x["text"]), "")
    return marked.groupBy(key, "island", *styles).agg(text.alias("text"))


def subtract_intervals(ranges: DataFrame, gaps: DataFrame, key: str = "key", width: int = TEXT_CELL) -> DataFrame:
    """Parts of each range (key, start, end) that no gap (key, start, end) covers, cell by cell; equal ranges are one, empty
    gaps cover nothing."""
    return subtract(ranges, gaps, key, width)


def numbered(rows: DataFrame, key: str, order: str) -> DataFrame:
    """rows with `place`: i/n within the key."""
    w = Window.partitionBy(key)
    return rows.withColumn("place", F.concat(F.row_number().over(w.orderBy(order)).cast("string"), F.lit("/"), F.count("*").over(w).cast("string")))


def with_attributes(blocks: DataFrame, is_attribute: Column, key: str = "doc_id", order: str = "ord", text: str = "text") -> DataFrame:
    """blocks without attribute comments; each with the one right before it in `attribute`."""
    before = Window.partitionBy(key).orderBy(order)
    flagged = blocks.withColumn("_is", F.coalesce(is_attribute, F.lit(False)))
    marked = flagged.withColumn("attribute", F.lag(F.when(F.col("_is"), F.col(text))).over(before))
    return marked.where(~F.col("_is")).drop("_is")


def table_width(rows: DataFrame, key: str, cells: str = "cells") -> DataFrame:
    """key, width: the most cells of a row of each table."""
    return rows.groupBy(key).agg(F.max(F.size(cells)).alias("width"))


def in_columns(rows: DataFrame, key: str, order: str, cells: str = "cells", gap: str = "  ") -> DataFrame:
    """key, order, line: the rows of each table in columns as wide as their widest cell; a row's last cell sets none."""
    each = rows.select(key, order, F.posexplode(cells).alias("at", "cell"), (F.size(cells) - 1).alias("last"))
    wide = each.where("at < last").groupBy(key, "at").agg(F.max(F.length("cell")).alias("width"))
    padded = each.join(wide, [key, "at"], "left").withColumn("cell", F.when(F.col("at") < F.col("last"), F.rpad("cell", F.greatest(F.length("cell"), F.col("width")), F.lit(" "))).otherwise(F.col("cell")))
    line = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", "cell"))), lambda x: x["cell"]), gap)
    return padded.groupBy(key, order).agg(F.rtrim(line).alias("line"))
