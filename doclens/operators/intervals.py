"""Joins of intervals over a grid, so that one long document is the work of many tasks.

Every interval [start, end) of a key is laid on a grid of cells `width` wide; intervals meet in the cells that both lie
in, and each meeting is told once, in the cell where the later of the two starts. Rows grow with the cells that an
interval covers, so the width should be about the length of most intervals, or more.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Offsets, or places of blocks, of a cell.
TEXT_CELL, BLOCK_CELL = 4096, 256


def cell_of(at: Column, width: int) -> Column:
    return F.floor(at / width).cast("long")


def in_cells(rows: DataFrame, start: str, end: str, width: int) -> DataFrame:
    """rows with `_cell`, once for each cell that [start, end) lies in; empty intervals lie in none."""
    some = rows.where(F.col(start) < F.col(end))
    return some.withColumn("_cell", F.explode(F.sequence(cell_of(F.col(start), width), cell_of(F.col(end) - 1, width))))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], width: int, a: tuple[str, str] = ("start", "end"), b: tuple[str, str] = ("run_start", "run_end")) -> DataFrame:
    """Pairs of rows of the same keys whose intervals, named by a and b, overlap; no other column may be in both."""
    met = in_cells(left, *a, width).join(in_cells(right, *b, width), [*keys, "_cell"])
    later = F.greatest(F.col(a[0]), F.col(b[0]))
    return met.where((F.col(a[0]) < F.col(b[1])) & (F.col(b[0]) < F.col(a[1])) & (cell_of(later, width) == F.col("_cell"))).drop("_cell")


def subtract(ranges: DataFrame, gaps: DataFrame, key: str, width: int) -> DataFrame:
    """Parts of each range (key, start, end) that no gap (key, start, end) covers; equal ranges are one.

    Cells are worked on apart. Parts that end and begin at the edge between two cells are one: of each cell only the
    parts at its edges are looked at together.
    """
    span = [key, "from", "to"]
    own = ranges.select(key, F.col("start").alias("from"), F.col("end").alias("to")).distinct()
    low, high = F.col("_cell") * width, (F.col("_cell") + 1) * width
    cells = in_cells(own, "from", "to", width).withColumn("lo", F.greatest("from", low)).withColumn("hi", F.least("to", high))
    holes = in_cells(gaps.select(key, F.col("start").alias("gs"), F.col("end").alias("ge")), "gs", "ge", width)
    met = cells.join(holes, [key, "_cell"], "left").withColumn("_in", F.coalesce((F.col("gs") < F.col("hi")) & (F.col("ge") > F.col("lo")), F.lit(False)))
    each = [*span, "_cell", "lo", "hi"]
    w = Window.partitionBy(*each).orderBy("gs", "ge").rowsBetween(Window.unboundedPreceding, -1)
    seen = F.greatest("lo", F.coalesce(F.max("ge").over(w), F.col("lo")))
    before = met.where("_in").withColumn("start", seen).select(*span, "_cell", "start", F.least("gs", "hi").alias("end"))
    after = met.groupBy(*each).agg(F.greatest("lo", F.coalesce(F.max(F.when(F.col("_in"), F.col("ge"))), F.col("lo"))).alias("start")).select(*span, "_cell", "start", F.col("hi").alias("end"))
    parts = before.unionByName(after).where("start < end")
    at_edge = ((F.col("start") == low) & (F.col("start") > F.col("from"))) | ((F.col("end") == high) & (F.col("end") < F.col("to")))
    inner, edge = parts.where(~at_edge), parts.where(at_edge)
    order = Window.partitionBy(*span).orderBy("start")
    new = F.coalesce(F.col("start") != F.lag("end").over(order), F.lit(True)).cast("int")
    joined = edge.withColumn("_new", new).withColumn("_run", F.sum("_new").over(order)).groupBy(*span, "_run").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    return inner.select(key, "start", "end").unionByName(joined.select(key, "start", "end"))
