"""Exact deduplication by a log-structured merge index.

Each task keeps a memtable of digests; when that is full it is flushed as a run, sorted by digest, with a Bloom filter
of its own. An entry with one member that no other run's filter lets through has no partner and stays behind. Compaction
merges sorted runs by levels: runs are dealt to groups of `fan_in`, each group is cut into ranges of digests, and a
task merges one range, keeping the best identifier of each digest; the runs that come out are the next level's, until one
group is left. Digests that only one document has leave the index then, and it gets a filter. Documents probe that
filter; those that it lets through meet their keeper's entry, and a hit counts only after the normalised texts are
compared byte by byte. Documents that share a digest but not the bytes (a collision) are grouped by the bytes.

Defined results: null text equals empty text; all empty or white-space texts are one group; a null id is smaller than
any other; of equal rows (ties in length and id) one stays, the others are dropped; an empty table gives no rows; texts
may be of any length; other columns are left alone.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm import common
from doclens.llm.common import SPACES, Bloom, Scratch, build_bloom, lean, map_rows, quoted, row_chunks, text_buffer, whole

#: filter: on a run's first row, the words of its Bloom filter.
ENTRY = "run string, key long, digest binary, n_points long, id long, members long, filter binary"


def normalised(value: str | None) -> bytes:
    """The bytes that decide equality: UTF-8 without white space."""
    return (value or "").encode().translate(None, SPACES)


def digest_of(value: bytes) -> bytes:
    return hashlib.sha256(value).digest()


def short_key(digest: bytes) -> int:
    """The first eight bytes as a signed long; runs are sorted by digest, which is by this unsigned."""
    return int.from_bytes(digest[:8].ljust(8, b"\0"), "big", signed=True)


def first_of(n_points: int, id_: int | None) -> tuple:
    """The order in which documents of one digest are kept: most code points, then the smallest id, null before any."""
    return (-n_points, id_ is not None, id_ or 0)


class Memtable:
    """Digests seen by one task since its last flush: the best document of each and the number of its members."""

    def __init__(self, limit: int):
        self.limit, self.entries = limit, {}

    def add(self, digest: bytes, n_points: int, id_: int | None) -> None:
        old = self.entries.get(digest)
        if old is None:
            self.entries[digest] = [n_points, id_, 1]
            return
        old[2] += 1
        if first_of(n_points, id_) < first_of(*old[:2]):
            old[:2] = n_points, id_

    def full(self) -> bool:
        return len(self.entries) >= self.limit

    def flush(self, run: str) -> pa.RecordBatch:
        """A run: entries sorted by digest, and its filter. The memtable is empty afterwards."""
        order = sorted(self.entries)
        columns = zip(*(self.entries[d] for d in order), strict=True)
        points, ids, members = (list(c) for c in columns)
        keys = np.array([short_key(d) for d in order], np.int64)
        self.entries = {}
        return pa.record_batch(
            {
                "run": pa.array([run] * len(order), pa.string()),
                "key": pa.array(keys),
                "digest": pa.array(order, pa.binary()),
                "n_points": pa.array(points, pa.int64()),
                "id": pa.array(ids, pa.int64()),
                "members": pa.array(members, pa.int64()),
                "filter": pa.array([Bloom.of(keys).words.tobytes()] + [None] * (len(order) - 1), pa.binary()),
            }
        )


def flush_runs(docs: DataFrame, id_col: str, text_col: str, memtable: int, digest: Callable[[bytes], bytes]) -> DataFrame:
    """Level 0: the runs of all tasks, as rows. A run holds `memtable` digests at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, part, n = Memtable(memtable), TaskContext.get().partitionId(), 0
        for batch in batches:
            for id_, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                table.add(digest(normalised(text)), len(text), id_)
                if table.full():
                    yield table.flush(f"{part}-{n}")
                    n += 1
        if table.entries:
            yield table.flush(f"{part}-{n}")

    return docs.select(id_col, text_col).mapInArrow(lean(run), ENTRY)


def partnered(runs: DataFrame) -> DataFrame:
    """Entries that may have a partner: with members of their own, or let through by another run's filter.

    Filters go to every task, so beyond a size of all of them together every entry may have one.
    """
    filters = runs.where("filter is not null").select("run", "filter")
    size = filters.agg(F.sum(F.octet_length("filter"))).first()[0] or 0
    if size * 8 > common.BLOOM_MOST_KEYS * Bloom.BITS_PER_KEY:
        return runs
    held = {r["run"]: bytes(r["filter"]) for r in filters.collect()}
    shared = runs.sparkSession.sparkContext.broadcast(held)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blooms = {name: Bloom.from_bytes(words) for name, words in shared.value.items()}
        for batch in batches:
            keys = batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
            found = batch.column(5).to_numpy(zero_copy_only=False) > 1
            own = np.array(batch.column(0).to_pylist(), object)
            for name, bloom in blooms.items():
                left = np.flatnonzero(~found & (own != name))
                found[left] = bloom.hit(keys[left])
            yield batch.filter(pa.array(found))

    return runs.mapInArrow(lean(run), ENTRY)


def merge_level(runs: DataFrame, groups: int, ranges: int) -> DataFrame:
    """One level of compaction: the sorted runs of each group merged, a range of digests at a time."""
    order = ["group", "digest", F.desc("n_points"), F.col("id").asc_nulls_first()]
    dealt = runs.withColumn("group", F.expr(f"cast(pmod(xxhash64(run), {groups}) as int)")).select("group", "digest", "key", "n_points", "id", "members")
    sorted_ = dealt.repartitionByRange(groups * ranges, "group", "digest").sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The first entry of each digest is the best; members add up. The last digest waits for the next batch."""
        part, last = TaskContext.get().partitionId(), None

        def out(rows: list[list]):
            g, digest, key, points, id_, members = zip(*rows, strict=True)
            return pa.record_batch(
                {
                    "run": pa.array([f"{x}-{part}" for x in g]),
                    "key": pa.array(key, pa.int64()),
                    "digest": pa.array(digest, pa.binary()),
                    "n_points": pa.array(points, pa.int64()),
                    "id": pa.array(id_, pa.int64()),
                    "members": pa.array(members, pa.int64()),
                    "filter": pa.nulls(len(g), pa.binary()),
                }
            )

        for batch in batches:
            rows: list[list] = [] if last is None else [last]
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[-1][:2] == list(row[:2]):
                    rows[-1][5] += row[5]
                else:
                    rows.append(list(row))
            last = rows.pop() if rows else None
            if rows:
                yield out(rows)
        if last is not None:
            yield out([last])

    return sorted_.mapInArrow(lean(run), ENTRY)


def compact(runs: DataFrame, scratch: Scratch, fan_in: int, range_rows: int) -> DataFrame:
    """One entry per digest with its best identifier, of the digests that have several members."""
    n_runs = runs.where("filter is not null").count()
    own = partnered(runs)
    level, groups = scratch.table(own, "level"), max(1, -(-n_runs // fan_in))
    while True:
        ranges = max(1, -(-level.count() // (groups * range_rows)))
        merged = scratch.table(merge_level(level, groups, ranges), "level")
        scratch.drop(level)
        if groups == 1:
            return merged.where("members > 1").select("key", "digest", F.col("id").alias("best_id"), F.col("n_points").alias("best_points"), "members")
        level, groups = merged, max(1, -(-groups // fan_in))


def prober(shared) -> Callable[[list[bytes]], np.ndarray]:
    """digests -> flags: the filter lets them through; everything passes without a filter. Made on the executor."""
    if shared is None:
        return lambda digests: np.ones(len(digests), bool)
    held = Bloom(shared.value)
    return lambda digests: held.hit(np.array([short_key(d) for d in digests], np.int64).view(np.uint64))


#: Index entries up to which the index itself may be broadcast (about 80 bytes each).
BROADCAST_ENTRIES = 100_000


class Dedup:
    """The compacted index of a table of documents, its filter, and the verified members of groups.

    memtable: digests that a task holds before it flushes a run. fan_in: runs that are merged at once. range_rows:
    entries that a merging task gets, about. salt_rows: members of a group that one task verifies. digest: replaceable
    so that tests can force collisions.
    """

    def __init__(self, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", memtable: int = 100_000, fan_in: int = 1_000, range_rows: int = 200_000, salt_rows: int = 2_000, digest: Callable[[bytes], bytes] = digest_of):
        self.docs, self.id_col, self.text_col, self.digest = docs, id_col, text_col, digest
        self.scratch = Scratch(docs.sparkSession, "dedup")
        self.plain = docs.select(self.own_id().alias("id"), F.col(quoted(text_col)).alias("text"))
        runs = self.scratch.table(flush_runs(self.plain, "id", "text", memtable, digest), "runs")
        index = compact(runs, self.scratch, fan_in, range_rows).withColumn("salts", F.ceil(F.col("members") / F.lit(salt_rows)).cast("int"))
        self.index = self.scratch.table(index, "index")
        self.scratch.drop(runs)
        entries = self.index.count()
        bloom = build_bloom(self.index.select("key"), entries)
        self.shared = docs.sparkSession.sparkContext.broadcast(bloom.words) if bloom else None
        if entries <= BROADCAST_ENTRIES:
            self.index = F.broadcast(self.index)

    def own_id(self):
        return F.col(quoted(self.id_col)).cast("long")

    def probed(self) -> DataFrame:
        """Every document with its digest; those that the filter lets through carry their normalised text."""
        digest, shared = self.digest, self.shared

        def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hit = prober(shared)
            for batch in batches:
                for start, end in row_chunks(text_buffer(batch.column(1))[1]):
                    part = batch.slice(start, end - start)
                    texts = [x or "" for x in part.column(1).to_pylist()]
                    norm = [normalised(x) for x in texts]
                    digests = [digest(x) for x in norm]
                    yield pa.record_batch(
                        {
                            "id": part.column(0),
                            "key": pa.array([short_key(x) for x in digests], pa.int64()),
                            "digest": pa.array(digests, pa.binary()),
                            "sha": pa.array([hashlib.sha256(x).hexdigest() for x in norm], pa.string()),
                            "n_points": pa.array([len(x) for x in texts], pa.int64()),
                            "norm": pa.array([x if h else None for x, h in zip(norm, hit(digests), strict=True)], pa.binary()),
                        }
                    )

        return self.plain.mapInArrow(lean(probe), "id long, key long, digest binary, sha string, n_points long, norm binary")

    def members(self, probed: DataFrame) -> DataFrame:
        """id, sha, r(keep_id, group_size, kept) of the documents that the filter let through."""
        joined = probed.where("norm is not null").join(self.index, ["key", "digest"], "left")
        alone = F.struct(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
        lone = joined.where("members is null").select("id", "sha", alone.alias("r"))
        hits = joined.where("members is not null").withColumn("salt", F.expr("pmod(xxhash64(id, n_points), salts)").cast("int"))
        keeper = hits.where("id <=> best_id and n_points = best_points").dropDuplicates(["key", "digest"]).select("key", "digest", F.col("norm").alias("kept_norm"), "salts")
        keeper = keeper.select("key", "digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
        same = F.col("norm") == F.col("kept_norm")
        checked = hits.join(keeper, ["key", "digest", "salt"]).select("id", "key", "digest", "sha", "n_points", "best_id", "best_points", "members", same.alias("same"), F.when(~same, F.col("norm")).alias("norm"))
        checked = self.scratch.table(checked, "checked")
        clash = checked.where("not same")
        collided = clash.groupBy("key", "digest").agg(F.count("*").alias("other"))
        good = checked.where("same").join(F.broadcast(collided) if collided.limit(1000).count() < 1000 else collided, ["key", "digest"], "left").withColumn("group_size", F.col("members") - F.coalesce("other", F.lit(0)))
        # rows that repeat the keeper's id: one of them stays
        turn = F.row_number().over(Window.partitionBy("id", "key", "digest").orderBy("n_points"))
        best = good.where("id <=> best_id and n_points = best_points").withColumn("kept", turn == 1)
        rest = good.where("not (id <=> best_id and n_points = best_points)").withColumn("kept", F.lit(False))
        verified = best.unionByName(rest).select("id", "sha", F.struct(F.col("best_id").alias("keep_id"), "group_size", "kept").alias("r"))
        by_bytes = clash.groupBy("norm").agg(F.min(F.struct((-F.col("n_points")).alias("less"), "id")).alias("best"), F.count("*").alias("same_bytes"))
        other = clash.join(by_bytes, "norm").withColumn("turn", F.row_number().over(Window.partitionBy("norm", "id").orderBy(F.desc("n_points"))))
        kept = F.col("id").eqNullSafe(F.col("best.id")) & (F.col("turn") == 1)
        other = other.select("id", "sha", F.struct(F.col("best.id").alias("keep_id"), F.col("same_bytes").alias("group_size"), kept.alias("kept")).alias("r"))
        return lone.unionByName(verified).unionByName(other)


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """One row per document: id, keep_id, group_size, kept, text_sha256."""
    dedup = Dedup(docs, id_col, text_col, **settings)
    probed = dedup.scratch.table(dedup.probed(), "probed")
    alone = F.struct(F.col("id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"))
    out = probed.where("norm is null").select("id", "sha", alone.alias("r")).unionByName(dedup.members(probed))
    return out.select(F.col("id").alias(id_col), F.col("r.keep_id").alias("keep_id"), F.col("r.group_size").alias("group_size"), F.col("r.kept").alias("kept"), F.col("sha").alias("text_sha256"))


def keep_first(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs, all columns, that exact_dedup() keeps.

    Rows that the filter does not let through are unique and pass as they are read; only the others are joined.
    """
    dedup = Dedup(docs, id_col, text_col, **settings)
    kept = dedup.scratch.table(dedup.members(dedup.scratch.table(dedup.probed().where("norm is not null"), "probed")).where("r.kept").select(F.col("id").alias("kept_id"), F.col("sha").alias("kept_sha")), "kept")

    def part(let_through: bool) -> DataFrame:
        digest, shared, at = dedup.digest, dedup.shared, docs.columns.index(text_col)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hit = prober(shared)
            for batch in batches:
                column = batch.column(at)
                for start, end in row_chunks(text_buffer(column)[1]):
                    flags = hit([digest(normalised(x)) for x in column.slice(start, end - start).to_pylist()])
                    yield batch.slice(start, end - start).filter(pa.array(flags == let_through))

        return map_rows(docs, run)

    own_text = F.col(quoted(text_col))
    own_print = F.sha2(F.encode(F.translate(F.coalesce(own_text, F.lit("")), SPACES.decode(), ""), "UTF-8"), 256)
    hits = part(True).select(whole(docs.columns).alias("doc"), dedup.own_id().alias("own_id"), own_print.alias("own_sha"), F.length(own_text).alias("points"))
    hits = hits.join(kept, (F.col("own_sha") == F.col("kept_sha")) & F.col("own_id").eqNullSafe(F.col("kept_id")), "left_semi")
    # rows that repeat the keeper's id: the longest of them stays
    turn = F.row_number().over(Window.partitionBy("own_id", "own_sha").orderBy(F.desc("points")))
    return part(False).unionByName(hits.withColumn("turn", turn).where("turn = 1").select("doc.*"))
