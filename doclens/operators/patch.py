"""Patches against live documents: from block operations to the calls a store would get, in the order they go out."""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.text import utf16_len
from doclens.operators.diff import fresh, spread
from doclens.operators.lineage import cut


#: Cells of a table up to which plain lists are quicker than arrays.
SMALL = 400


def longest_increasing(values: Column) -> Column:
    """One of the longest increasing subsequences of an array of numbers: for each length the chain with the least end."""
    kind = "array<struct<last:bigint,chain:array<bigint>>>"

    def step(chains: Column, x: Column) -> Column:
        shorter = F.size(F.filter(chains, lambda c: c["last"] < x))
        before = F.coalesce(F.get(chains, shorter - 1)["chain"], F.array().cast("array<bigint>"))
        longer = F.struct(x.alias("last"), F.concat(before, F.array(x)).alias("chain"))
        return F.concat(F.slice(chains, 1, shorter), F.array(longer), F.slice(chains, shorter + 2, F.greatest(F.size(chains) - shorter - 1, F.lit(0)))).cast(kind)

    chains = F.aggregate(values.cast("array<bigint>"), F.array().cast(kind), step)
    return F.coalesce(F.get(chains, F.size(chains) - 1)["chain"], F.array().cast("array<bigint>"))


def with_survivors(ops: DataFrame) -> DataFrame:
    """ops (key, op_ord, op, base_ord, next_ord) with `stays`: blocks kept or edited that need not move, a longest run of
    these whose old places increase.

    A block that crosses no other is in every such run; only stretches of blocks that cross are looked at as arrays.
    """
    w = Window.partitionBy("key").orderBy("op_ord")
    place = F.when(F.col("op").isin("keep", "update"), F.col("base_ord"))
    # both run with their order: a frame to the end would be added up anew for each row
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    behind = Window.partitionBy("key").orderBy(F.desc("op_ord")).rowsBetween(Window.unboundedPreceding, -1)
    alone = place.isNotNull() & F.coalesce(place > F.max(place).over(before), F.lit(True)) & F.coalesce(place < F.min(place).over(behind), F.lit(True))
    marked = ops.withColumn("_place", place).withColumn("_alone", alone).withColumn("_stretch", F.count_if("_alone").over(w))
    crossed = marked.where("_place is not null and not _alone")
    runs = crossed.groupBy("key", "_stretch").agg(F.transform(F.sort_array(F.collect_list(F.struct("op_ord", "_place"))), lambda x: x["_place"]).alias("places"))
    chosen = runs.select("key", F.explode(longest_increasing(F.col("places"))).alias("_place"), F.lit(True).alias("_chosen"))
    return marked.join(chosen, ["key", "_place"], "left").withColumn("stays", F.col("_alone") | F.coalesce("_chosen", F.lit(False))).drop("_place", "_alone", "_stretch", "_chosen")


def page_calls(ops: DataFrame, live: DataFrame, nxt: DataFrame) -> DataFrame:
    """Calls per document that make its live blocks the next version: key, call (from 0), phase, live_id, after_id,
    next_ords, problem. ops: one level of block_diff(); live: key, ord, type, live_id; nxt: key, ord, type.

    First the updates, then the inserts from the end to the start, then the deletes; so a block that is yet to be deleted
    can still be named as the one to go behind. Blocks that stay keep their places. What is inserted or moved between two
    of them is one insert behind the first; in front of all of them it goes behind the block that is before them now, and
    where none is, the first one that stays is written again with the others. A block that moves is inserted and deleted.

    A document that cannot be patched has one row, `refused`, with its first problem: a live block that is missing, a
    placeholder (type `placeholder...`) that would be edited or moved, a change of type.
    """
    old = fresh(live).select("key", F.col("ord").cast("long").alias("base_ord"), F.col("type").alias("base_type"), "live_id")
    new = fresh(nxt).select("key", F.col("ord").cast("long").alias("next_ord"), F.col("type").alias("next_type"))
    rows = with_survivors(cut(ops.select("key", "op_ord", "op", "base_ord", "next_ord"))).join(old, ["key", "base_ord"], "left").join(new, ["key", "next_ord"], "left")
    w = Window.partitionBy("key").orderBy("op_ord")
    every = Window.partitionBy("key")
    # the first that stays is written again where something new comes before it, and no live block
    first = F.min(F.when(F.col("stays"), F.col("op_ord"))).over(every)
    newest = F.min(F.when(F.col("next_ord").isNotNull() & ~F.col("stays"), F.col("op_ord"))).over(every)
    lowest = old.groupBy("key").agg(F.min("base_ord").alias("_lowest"))
    rows = rows.join(lowest, "key", "left").withColumn("_again", F.coalesce((F.col("op_ord") == first) & (newest < first) & (F.col("base_ord") == F.col("_lowest")), F.lit(False)))
    rows = rows.withColumn("stays", F.col("stays") & ~F.col("_again"))
    fixed = F.startswith(F.col("base_type"), F.lit("placeholder"))
    moved = F.col("op").isin("keep", "update", "move") & ~F.col("stays")
    edited = (F.col("op") == "update") & F.col("stays")
    problem = (
        F.when(F.col("base_ord").isNotNull() & F.col("live_id").isNull(), "the live document has fewer blocks")
        .when(moved & fixed, "a placeholder cannot be moved")
        .when(edited & fixed, "a placeholder cannot be edited")
        .when(edited & (F.col("base_type") != F.col("next_type")), "a block cannot change its type")
    )
    rows = rows.withColumn("_problem", F.min_by(problem, F.when(problem.isNotNull(), F.col("op_ord"))).over(every))
    # an island: what comes in behind the same block that stays
    rows = rows.withColumn("_island", F.count_if("stays").over(w)).withColumn("_behind", F.last(F.when(F.col("stays"), F.col("live_id")), ignorenulls=True).over(w))
    rows = cut(rows)  # what follows reads it six times
    fine = rows.where("_problem is null")
    heads = fine.groupBy("key").agg(F.min(F.when(F.col("stays"), F.col("base_ord"))).alias("_first"))
    front = old.join(heads, "key").where("_first is null or base_ord < _first").groupBy("key").agg(F.max_by("live_id", "base_ord").alias("_front"))
    no_id, no_ords = F.lit(None).cast("string"), F.array().cast("array<long>")
    updates = fine.where((F.col("op") == "update") & F.col("stays")).select("key", F.lit(0).alias("_phase"), F.col("op_ord").alias("_turn"), F.lit("update").alias("phase"), "live_id", no_id.alias("after_id"), F.array("next_ord").alias("next_ords"))
    gone = fine.where((F.col("op") == "delete") | moved).select("key", F.lit(2).alias("_phase"), F.col("op_ord").alias("_turn"), F.lit("delete").alias("phase"), "live_id", no_id.alias("after_id"), no_ords.alias("next_ords"))
    put = fine.where(F.col("next_ord").isNotNull() & ~F.col("stays")).groupBy("key", "_island", "_behind").agg(F.transform(F.sort_array(F.collect_list(F.struct("op_ord", "next_ord"))), lambda x: x["next_ord"]).alias("next_ords"))
    inserts = put.join(front, "key", "left").select("key", F.lit(1).alias("_phase"), (-F.col("_island")).alias("_turn"), F.lit("insert").alias("phase"), no_id.alias("live_id"), F.coalesce("_behind", "_front").alias("after_id"), "next_ords")
    numbered = updates.unionByName(inserts).unionByName(gone).withColumn("call", (F.row_number().over(Window.partitionBy("key").orderBy("_phase", "_turn")) - 1).cast("int"))
    refused = rows.where("_problem is not null").groupBy("key").agg(F.first("_problem").alias("problem")).select("key", F.lit(0).alias("call"), F.lit("refused").alias("phase"), no_id.alias("live_id"), no_id.alias("after_id"), no_ords.alias("next_ords"), "problem")
    return numbered.select("key", "call", "phase", "live_id", "after_id", "next_ords", F.lit(None).cast("string").alias("problem")).unionByName(refused)


def replayed(calls: DataFrame, live: DataFrame, nxt: DataFrame) -> DataFrame:
    """key, place (from 0), text: the live blocks after the calls. live: key, ord, live_id, text; nxt: key, ord, text."""
    old = fresh(live).select("key", F.col("ord").cast("long").alias("ord"), "live_id", "text")
    new = fresh(nxt).select("key", F.col("ord").cast("long").alias("next_ord"), F.col("text").alias("next_text"))
    calls = cut(calls)
    gone = calls.where("phase = 'delete'").select("key", "live_id")
    edits = calls.where("phase = 'update'").select("key", "live_id", F.get("next_ords", F.lit(0)).alias("next_ord")).join(new, ["key", "next_ord"])
    stay = old.join(gone, ["key", "live_id"], "left_anti").join(edits.select("key", "live_id", "next_text"), ["key", "live_id"], "left")
    stay = stay.select("key", "ord", F.lit(-1).alias("turn"), F.coalesce("next_text", "text").alias("text"))
    put = calls.where("phase = 'insert'").select("key", "after_id", F.posexplode("next_ords").alias("turn", "next_ord")).join(new, ["key", "next_ord"])
    place = old.select("key", F.col("live_id").alias("after_id"), "ord")
    put = put.join(place, ["key", "after_id"], "left").select("key", "ord", "turn", F.col("next_text").alias("text"))
    spot = F.row_number().over(Window.partitionBy("key").orderBy(F.col("ord").asc_nulls_first(), "turn")) - 1
    return stay.unionByName(put).select("key", spot.alias("place"), "text")


def few_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """The same as common_pairs() for short lists, by plain lists."""
    if not a or not b:
        return []
    rows = [[0] * (len(b) + 1)]
    for x in reversed(a):
        below, row, best = rows[-1], [0] * (len(b) + 1), 0
        for j in range(len(b) - 1, -1, -1):
            best = row[j] = max(best, below[j + 1] + 1 if x == b[j] else below[j])
        rows.append(row)
    rows.reverse()
    out, i, j = [], 0, 0
    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        elif rows[i + 1][j] >= rows[i][j + 1]:
            i += 1
        else:
            j += 1
    return out


def common_pairs(a: list, b: list) -> list[tuple[int, int]]:
    """Positions of a longest common subsequence; of several, the one that passes over a's blocks first.

    Lengths are kept for one row of the table in `band` only; the rows between are computed again, band by band, on the
    way down. So memory grows with the longer list times the root of the other, and there is no limit to either.
    """
    head = next((n for n, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    out = [(n, n) for n in range(head)]  # equal heads are always paired
    a, b = a[head:], b[head:]
    if len(a) * len(b) <= SMALL:
        return out + [(head + i, head + j) for i, j in few_pairs(a, b)]
    names = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    left, right = (np.array([names[x] for x in side], np.int64) for side in (a, b))
    band = max(1, math.isqrt(len(a)))

    def above(below: np.ndarray, i: int) -> np.ndarray:
        """Lengths of what is common to a[i:] and b[j:], for each j, from those of a[i + 1:]."""
        row = np.zeros_like(below)
        best = np.maximum(below[:-1], np.where(right == left[i], below[1:] + 1, 0))
        row[:-1] = np.maximum.accumulate(best[::-1])[::-1]
        return row

    row, kept = np.zeros(len(b) + 1, np.int32), {}
    for i in range(len(a), -1, -1):
        row = row if i == len(a) else above(row, i)
        if i % band == 0 or i == len(a):
            kept[i] = row
    i = j = 0
    while i < len(a) and j < len(b):
        end = min((i // band + 1) * band, len(a))
        rows = {end: kept[end]}
        for k in range(end - 1, i - 1, -1):
            rows[k] = above(rows[k + 1], k)
        while i < end and j < len(b):
            if left[i] == right[j]:
                out.append((head + i, head + j))
                i, j = i + 1, j + 1
            elif rows[i + 1][j] >= rows[i][j + 1]:
                i += 1
            else:
                j += 1
    return out


def align(base: list[str], live: list[str]) -> list[tuple[int, int]]:
    """Pairs of positions: blocks that are the same, and between two of these what lies in gaps of equal length."""
    out, i, j = [], -1, -1
    for n, m in [*common_pairs(base, live), (len(base), len(live))]:
        if n - i == m - j:
            out += [(i + k, j + k) for k in range(1, n - i)]
        out.append((n, m))
        i, j = n, m
    return out[:-1]


def aligned_blocks(base: DataFrame, live: DataFrame) -> DataFrame:
    """key, base_ord, live_ord: the live block that each base block is, where it is any.

    base, live: key, ord, parent (null at the top), type, text. Blocks of a level are the same if type and text are; see
    align(); they are told apart by a digest of both, so that texts are not dealt or kept. The children of two blocks that are paired are aligned among themselves, level by level; levels that agree
    block by block, as nearly all do, are joined by place, and only the others go to tasks as lists.
    """
    sides = []
    for side, name in ((base, "base"), (live, "live")):
        own = fresh(side)
        digest = F.unhex(F.sha2(F.to_json(F.struct("type", "text")), 256))
        sides.append(own.select("key", F.coalesce(F.col("parent").cast("long"), F.lit(-1)).alias(f"{name}_up"), F.col("ord").cast("long").alias(f"{name}_ord"), digest.alias(f"{name}_id")))
    old, new = sides
    level = ["key", "base_up", "live_up"]
    met = old.select("key").distinct().select("key", F.lit(-1).cast("long").alias("base_up"), F.lit(-1).cast("long").alias("live_up"))
    found = []
    while True:
        w = lambda order: Window.partitionBy(*level).orderBy(order)
        a = old.join(met, ["key", "base_up"]).withColumn("at", F.row_number().over(w("base_ord")))
        b = new.join(met, ["key", "live_up"]).withColumn("at", F.row_number().over(w("live_ord")))
        both = a.join(b, [*level, "at"], "full_outer").withColumn("_odd", F.max((~F.col("base_id").eqNullSafe(F.col("live_id"))).cast("int")).over(Window.partitionBy(*level)) > 0)
        both = cut(both)
        agreed = both.where("not _odd").select("key", "base_ord", "live_ord")
        said = lambda name: F.sort_array(F.collect_list(F.when(F.col(f"{name}_ord").isNotNull(), F.struct("at", F.col(f"{name}_ord").alias("ord"), F.col(f"{name}_id").alias("id"))))).alias(name)
        lists = lambda name: (F.transform(name, lambda x: x["ord"]).alias(f"{name}_ords"), F.transform(name, lambda x: x["id"]).alias(f"{name}_ids"))
        odd = spread(both.where("_odd"), *level).groupBy(*level).agg(said("base"), said("live")).select("key", *lists("base"), *lists("live"))
        paired = cut(agreed.unionByName(odd.mapInArrow(_align_lists, "key long, base_ord long, live_ord long")))
        found.append(paired)
        up = paired.select("key", F.col("base_ord").alias("base_up"), F.col("live_ord").alias("live_up"))
        met = up.join(old.select("key", "base_up").distinct(), ["key", "base_up"], "left_semi").join(new.select("key", "live_up").distinct(), ["key", "live_up"], "left_semi").select(*level)
        if met.isEmpty():
            return reduce(DataFrame.unionByName, found)


def _align_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        own = [batch.column(0).to_pylist(), *(_rows_of(c) for c in batch.columns[1:])]
        columns: tuple[list, list, list] = ([], [], [])
        for key, base_ords, base, live_ords, live in zip(*own, strict=True):
            for i, j in align(base, live):
                columns[0].append(key)
                columns[1].append(base_ords[i])
                columns[2].append(live_ords[j])
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["key", "base_ord", "live_ord"])


def _rows_of(column: pa.ListArray) -> Iterator[list]:
    every = iter(column.flatten().to_pylist())
    return (list(islice(every, n)) for n in column.value_lengths().to_pylist())


def text_requests(edits: DataFrame) -> DataFrame:
    """Requests on a live text from edits (key, index, deleted, inserted, order): from the end to the start, so that no
    index moves; at one place the deletion goes before the insertion."""
    rows = edits.select("key", "index", "order", F.explode(F.array(F.struct(F.lit(0).alias("phase"), F.col("deleted").alias("text")), F.struct(F.lit(1).alias("phase"), F.col("inserted").alias("text")))).alias("x"))
    return rows.select("key", "index", "order", "x.*").where("text <> ''")


def request_json(requests: DataFrame) -> DataFrame:
    """requests of text_requests() with `json`: what the store gets, stamped with their tab and segment where they have one.

    requests: key, index, order, phase (0 deletes, 1 inserts), text, tab, segment.
    """
    place = lambda *fields: F.struct(*fields, F.col("tab").alias("tabId"), F.col("segment").alias("segmentId"))
    span = place(F.col("index").alias("startIndex"), (F.col("index") + utf16_len(F.col("text"))).alias("endIndex"))
    delete = F.to_json(F.struct(F.struct(span.alias("range")).alias("deleteContentRange")))
    insert = F.to_json(F.struct(F.struct(place(F.col("index").alias("index")).alias("location"), F.col("text")).alias("insertText")))
    return requests.withColumn("json", F.when(F.col("phase") == 0, delete).otherwise(insert))


def live_index(offsets: DataFrame, pieces: DataFrame) -> DataFrame:
    """Live document index of each block-text offset: offsets (key, block, offset), pieces (key, block, at, start, length).

    An offset at the end of a piece belongs to the next one, but for the last piece.
    """
    o, p = offsets.alias("o"), pieces.alias("p")
    col = F.col
    met = o.join(p, (col("o.key") == col("p.key")) & (col("o.block") == col("p.block")) & (col("p.at") <= col("o.offset")) & (col("o.offset") <= col("p.at") + col("p.length")))
    return met.groupBy(col("o.key").alias("key"), col("o.block").alias("block"), col("o.offset").alias("offset")).agg(F.max_by(col("p.start") + col("o.offset") - col("p.at"), col("p.at")).alias("index"))
