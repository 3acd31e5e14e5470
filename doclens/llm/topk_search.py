"""Exact top-k search by inner product: columnar branch-and-bound over blocks of dimensions.

Vectors become integers floor(scale * x). Candidates and queries are packed into blocks in vertical layout (one
array per dimension). A query takes the dimensions in the order of its own components, the largest first, a few at a
time: partial products accumulate over the candidates that are left, and what the other dimensions can still add is at
most the product of the remaining norms (remaining mass). Candidates whose upper bound stays below the k-th best score
so far leave, and survivors are compacted before the next dimensions. The k best so far are carried from one block of
candidates to the next.

Every block of queries meets every block of candidates: the stated queries against all rows, in blocks. The candidates
are not exchanged: query blocks of a bounded size together go to every task, which meets its own candidate blocks with
them, and further queries come in further passes. The k best of each task are reduced per query.

A block holds vectors of one length. Vectors of different lengths are compared in the dimensions that both have, as if
the shorter one ended in zeros.

Defined results: vectors that are null or hold null or non-finite components take no part, nor do rows with a null id;
empty vectors score 0 with every row; ties go to the smaller id; repeated rows compete as rows of their own, and a query leaves out its own id; rows
that repeat a query's id ask once, with the smallest of their vectors; scores beyond a long count as the nearest long;
an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.common import Scratch, lean, quoted

BLOCK = "part long, ids binary, columns binary, kind string"
#: Sums of products below this are exact in double precision.
EXACT = float(1 << 53)
LEAST, MOST = -(1 << 63), (1 << 63) - 1


def quantised(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) in double precision; whole numbers, kept as doubles."""
    return np.floor(vectors * float(scale))


def by_length(vectors: pa.ListArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places and rows x length matrix of the vectors of each length."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = vectors.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.cumsum(sizes) - sizes
    for length in np.unique(sizes):
        at = np.flatnonzero(sizes == length)
        yield at, flat.reshape(len(at), length) if len(at) == len(sizes) else flat[starts[at][:, None] + np.arange(length)]


def vertical(matrix: np.ndarray) -> tuple[bytes, str]:
    """Dimension after dimension, in the narrowest type that holds the whole numbers."""
    most = np.abs(matrix).max(initial=0)
    kind = "<i2" if most < 1 << 15 else "<i4" if most < 1 << 31 else "<f8"
    return np.ascontiguousarray(matrix.T).astype(kind).tobytes(), kind


def pack(rows: DataFrame, size: int, scale: int) -> DataFrame:
    """(id, vector, part) rows -> blocks of `size` rows of one length and part at most; a null part is numbered by task."""

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple[int | None, int], list[tuple[np.ndarray, np.ndarray]]] = {}
        task, n = TaskContext.get().partitionId(), 0
        rows_of = lambda parts: sum(len(i) for i, _ in parts)

        def out(key):
            nonlocal n
            parts = held.pop(key)
            n += 1
            columns, kind = vertical(np.concatenate([v for _, v in parts]))
            part = (task << 32) + n if key[0] is None else key[0]
            return pa.record_batch(
                {
                    "part": pa.array([part], pa.int64()),
                    "ids": pa.array([np.concatenate([i for i, _ in parts]).tobytes()], pa.binary()),
                    "columns": pa.array([columns], pa.binary()),
                    "kind": pa.array([kind]),
                }
            )

        def runs(batch):
            """(part, rows) of a batch, whose rows come part after part."""
            parts = batch.column(2)
            if parts.null_count:
                yield None, batch
                return
            numbers = parts.to_numpy(zero_copy_only=False)
            edges = [*np.flatnonzero(np.append(True, numbers[1:] != numbers[:-1])).tolist(), len(numbers)] if len(numbers) else []
            for a, b in zip(edges, edges[1:], strict=False):
                yield int(numbers[a]), batch.slice(a, b - a)

        for batch in batches:
            for part, rows_ in runs(batch):
                yield from (out(key) for key in [k for k in held if k[0] != part])
                own = rows_.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
                for at, matrix in by_length(rows_.column(1)):
                    key = (part, matrix.shape[1])
                    for k in range(0, len(at), size):
                        i, v = own[at[k : k + size]], matrix[k : k + size]
                        if key in held and rows_of(held[key]) + len(i) > size:
                            yield out(key)
                        held.setdefault(key, []).append((i, quantised(v, scale)))
                        if len(held) > 1 and sum(map(rows_of, held.values())) > size:  # blocks of other lengths wait in bounded memory
                            yield from map(out, list(held))
        yield from map(out, list(held))

    return rows.select("id", "v", "part").mapInArrow(lean(blocks), BLOCK)


class QueryBlock:
    """Queries of one length and their k best so far. products: multiplications done, of `possible`."""

    def __init__(self, ids: np.ndarray, columns: np.ndarray, k: int, dim_block: int):
        """columns: dims x queries."""
        self.ids, self.columns, self.k, self.dim_block = ids, columns, k, dim_block
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]
        self.found: list[np.ndarray] = [np.zeros(0, np.int64) for _ in ids]
        self.products = self.possible = 0

    def scan(self, cand_ids: np.ndarray, cands: np.ndarray) -> None:
        """Meet a block of candidates, dims x rows."""
        dims = min(len(self.columns), len(cands))
        queries, cands = self.columns[:dims], cands[:dims]
        if np.abs(queries).max(initial=0) * np.abs(cands).max(initial=0) * dims < EXACT:
            mass = (cands * cands).sum(axis=0)
            for n in range(len(self.ids)):
                self._merge(n, *self._bounded(n, queries[:, n], cand_ids, cands, mass))
        else:
            whole = [[int(x) for x in c] for c in cands.T]
            for n in range(len(self.ids)):
                q, own = [int(x) for x in queries[:, n]], np.flatnonzero(cand_ids != self.ids[n])
                exact = [max(LEAST, min(MOST, sum(a * b for a, b in zip(q, whole[i], strict=True)))) for i in own]
                self._merge(n, np.array(exact, np.int64), cand_ids[own])

    def _bounded(self, n: int, query: np.ndarray, cand_ids: np.ndarray, cands: np.ndarray, mass: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Scores and ids of the candidates that may be among the k best."""
        order = np.argsort(-np.abs(query), kind="stable")
        rest_of_query = np.sqrt(np.append(np.cumsum((query[order] ** 2)[::-1])[::-1], 0.0))
        floor_ = float(self.scores[n][-1]) if len(self.scores[n]) == self.k else -np.inf
        alive = np.flatnonzero(cand_ids != self.ids[n])
        partial, rest, all_ = np.zeros(len(alive)), mass[alive], len(alive) == len(mass)
        self.possible += len(query) * len(alive)
        for at in range(0, len(order), self.dim_block):
            own = order[at : at + self.dim_block]
            block = cands[own] if all_ else cands[own[:, None], alive]
            partial += query[own] @ block
            self.products += block.size
            end = at + len(own)
            if end == len(order) or not len(alive):
                break
            rest = rest - np.einsum("ij,ij->j", block, block)
            bound = np.sqrt(np.maximum(rest, 0)) * rest_of_query[end] * (1 + 1e-9) + 1e-6
            if len(alive) > self.k:
                low = partial - bound
                floor_ = max(floor_, float(np.partition(low, -self.k)[-self.k]))
            keep = partial + bound >= floor_
            kept = int(keep.sum())
            if kept <= 0.8 * len(alive):
                alive, partial, rest, all_ = alive[keep], partial[keep], rest[keep], False
        return partial.astype(np.int64), cand_ids[alive]

    def _merge(self, n: int, scores: np.ndarray, ids: np.ndarray) -> None:
        if len(scores) > 4 * self.k:
            near = scores >= np.partition(scores, -self.k)[-self.k]
            scores, ids = scores[near], ids[near]
        scores, ids = np.append(self.scores[n], scores), np.append(self.found[n], ids)
        order = np.lexsort((ids, -scores.astype(float)))[: self.k] if np.abs(scores.astype(float)).max(initial=0) < EXACT else np.array(sorted(range(len(scores)), key=lambda i: (-int(scores[i]), int(ids[i])))[: self.k], int)
        self.scores[n], self.found[n] = scores[order], ids[order]

    def best(self) -> pa.RecordBatch:
        sizes = [len(s) for s in self.scores]
        columns = (np.repeat(self.ids, sizes), np.concatenate(self.found), np.concatenate(self.scores))
        return pa.record_batch({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "id", "score"), columns, strict=True)})


def one_pass(cands: DataFrame, queries: DataFrame, shares: int, k: int, dim_block: int) -> DataFrame:
    """query_id, id, score: the k best of each task for the queries of a pass. A block of candidates meets the query blocks of
    its share; what a task has found so far bounds what its next blocks can add."""
    asked = cands.sparkSession.sparkContext.broadcast([(bytes(r["ids"]), bytes(r["columns"]), r["kind"]) for r in queries.orderBy("part").collect()])

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = lambda ids, columns, kind: (ids, np.frombuffer(columns, kind).reshape(-1, len(ids)).astype(np.float64))
        asks: dict[int, QueryBlock] = {}
        for batch in batches:
            for row in range(batch.num_rows):
                ids, columns = block(np.frombuffer(batch.column(0)[row].as_buffer(), np.int64), batch.column(1)[row].as_buffer(), batch.column(2)[row].as_py())
                for n in range(batch.column(3)[row].as_py(), len(asked.value), shares):
                    if n not in asks:
                        own = asked.value[n]
                        asks[n] = QueryBlock(*block(np.frombuffer(own[0], np.int64), *own[1:]), k, dim_block)
                    asks[n].scan(ids, columns)
        yield from (a.best() for a in asks.values())

    return cands.mapInArrow(lean(search), "query_id long, id long, score long")


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding", scale: int = 256, query_block: int = 1024, cand_block: int = 4096, group_blocks: int = 16, dim_block: int = 8, pass_bytes: int = 8 << 20) -> DataFrame:
    """query_id, rank (from 1), id, score: for each row of `is_query` its k best other rows.

    group_blocks: blocks of candidates of a task, about, where they are dealt anew. pass_bytes: bytes of query blocks that
    are sent to every task at once; more queries take more passes over the candidates.
    """
    spark = vectors.sparkSession
    scratch = Scratch(spark, "topk")
    as_double = F.col(quoted(vector_col)).cast("array<double>")
    whole = F.forall(as_double, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    valid = vectors.where(F.col(quoted(vector_col)).isNotNull() & F.col(quoted(id_col)).isNotNull()).where(whole)
    rows = lambda df: df.select(F.col(quoted(id_col)).cast("long").alias("id"), as_double.alias("v"))
    cands = scratch.table(pack(rows(valid).withColumn("part", F.lit(None).cast("long")), cand_block, scale), "candidates")
    asked = scratch.table(rows(valid.where(is_query)).groupBy("id").agg(F.min("v").alias("v")), "asked")
    n_queries, n_blocks = asked.count(), cands.count()
    if not n_queries:
        return spark.createDataFrame([], f"query_id long, rank int, {quoted(id_col)} long, score long")
    dealt = asked.repartition(min(-(-n_queries // query_block), 4096), "id").sortWithinPartitions("id")
    queries = scratch.table(pack(dealt.withColumn("part", F.lit(None).cast("long")), query_block, scale), "queries")
    # passes of query blocks that are together small enough to send; the candidates stay where they are
    size = F.octet_length("ids") + F.octet_length("columns")
    runs, held = [[]], 0
    for part, n in sorted(queries.select("part", size.alias("n")).collect()):  # a number per block of queries
        if runs[-1] and held + n > pass_bytes:
            runs.append([])
            held = 0
        runs[-1].append(part)
        held += n
    # where candidates are few, each block of them meets the queries in several tasks
    tasks = 2 * spark.sparkContext.defaultParallelism
    shares = max(1, min(-(-tasks // n_blocks), max(len(r) for r in runs)))
    met = cands.select("ids", "columns", "kind", F.explode(F.sequence(F.lit(0), F.lit(shares - 1))).alias("share"))
    if met.rdd.getNumPartitions() < min(n_blocks * shares, tasks):
        met = scratch.table(met.repartition(max(min(n_blocks * shares, tasks), -(-n_blocks * shares // group_blocks))), "dealt")
    found = [scratch.table(one_pass(met, queries.where(F.col("part").isin(run)), shares, k, dim_block), "best") for run in runs]
    near = reduce(DataFrame.unionByName, found)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    ranked = near.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("id").alias(id_col), "score")
