"""Best-fit packing of tokenised documents into sequences, bulk-synchronous.

Documents (pieces of at most `capacity` tokens) and gaps (sequences with room left) are tables, range-sorted by size.
A superstep:

1. Gaps are range-sorted; each task numbers its gaps of each size and tells how many it has. These counts, at most
   a row per task and one per size, are all that the driver sees of them.
2. From the counts per size follows what a sweep from the largest size to the smallest would do: a document takes its
   successor, the smallest gap that holds it and that no longer document has taken. Running sums of gaps minus
   documents per size give the level that each gap enters and each document leaves, as brackets pair up.
3. Conflicts are resolved by rank: of the documents of a length, rank r takes the gap r levels below the top. Each task
   finds, for its gaps, the length and rank of the document that comes in, and what is left of the gap.
4. What is left makes the next superstep's gaps. A gap that holds several of the longest document left is as many equal
   slots. A superstep takes the documents from the longest that some gap holds down to 4/5 of its length, so that shorter
   ones find the gaps that these leave, as they would one by one; there are some 20 supersteps, whatever the input.

Where no gap holds any document left, as many sequences open as these must take at least. At the end a join by length
and rank tells every document its place.

Defined results: null text is empty text (one token, the end); null ids come back null; repeated rows are packed each,
which of equal rows goes where is open; an empty table gives no rows; texts of any length are cut into pieces of
`capacity` tokens.
"""

from __future__ import annotations

import re
import sys
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructType
from tokenizers import Tokenizer

from doclens.llm.common import Scratch, lean, quoted

LITTLE = sys.byteorder == "little" and array("I").itemsize == 4

# ---------------------------------------------------------------- tokens


class ChunkCache(dict):
    """White-space-free chunk -> its ids as little-endian 32-bit bytes; emptied when it holds `limit` chunks."""

    #: The pre-tokenizer's pattern in the vocabulary file.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")

    def __init__(self, tokenizer: Tokenizer, limit: int):
        self.tokenize, self.limit, self.old = tokenizer.model.tokenize, limit // 2, {}
        # fixed values, the byte-level alphabet of the vocabulary file: printable Latin-1 bytes stand for themselves, the others follow from U+0100 on
        kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
        self.alphabet = {b: b for b in kept} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in set(kept))}

    def __missing__(self, chunk: str) -> bytes:
        known = self.old.get(chunk)
        if known is not None:
            return self.keep(chunk, known)
        if chunk.isascii():  # its bytes stand for themselves
            ids = [t.id for piece in self.PIECES.findall(chunk) for t in self.tokenize(piece)]
        else:
            ids = [t.id for piece in self.PIECES.findall(chunk) for t in self.tokenize(piece.encode().decode("latin-1").translate(self.alphabet))]
        return self.keep(chunk, array("I", ids).tobytes() if LITTLE else np.array(ids, "<u4").tobytes())

    def keep(self, chunk: str, out: bytes) -> bytes:
        """Half of the chunks that are kept are those seen since the last turn; what is seen again in the next one stays."""
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        self[chunk] = out
        return out


class WordTokens:
    """Ids of a text, the same as the tokenizer's own encode(); by cached chunks where characters are plain Latin."""

    ODD = re.compile("[^\x09-\x0d\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ž–—‘-„…€]")

    def __init__(self, path: str, limit: int = 280_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.cache = ChunkCache(self.tokenizer, limit)

    def ids(self, text: str, window: int = 1 << 20) -> bytes:
        if self.ODD.search(text) or "<|" in text:
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if len(text) <= window:
            return b"".join(map(self.cache.__getitem__, text.lower().split()))
        out, at = bytearray(), 0
        while at < len(text):
            end = at + window
            while end < len(text) and not text[end].isspace():
                end += 1
            out += b"".join(map(self.cache.__getitem__, text[at:end].lower().split()))
            at = end
        return bytes(out)


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer_path: str, end_id: int, capacity: int) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = WordTokens(tokenizer_path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            rows: list[tuple] = []
            for id_, text in zip(batch.column(0), batch.column(1), strict=True):
                ids = tokens.ids(text.as_py() or "") + end
                for n, at in enumerate(range(0, len(ids), capacity * 4)):
                    part = ids[at : at + capacity * 4]
                    rows.append((id_.as_py(), n, at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*rows, strict=True)) or [()] * 5
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(quoted(id_col)).cast("long").alias("doc_id"), F.col(quoted(text_col)).alias("text")).mapInArrow(lean(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


# ---------------------------------------------------------------- range-sorted rows


def range_sorted(rows: DataFrame, key: str, rest: list[str], n_rows: int, grain_rows: int) -> DataFrame:
    """rows sorted over tasks of about `grain_rows` by key and the rest, with `part` (the task) and `local`: the number
    of a row among its task's rows of the same key. The rest splits a key that many rows have over tasks."""
    order = [key, *rest]
    own = rows.repartitionByRange(max(1, -(-n_rows // grain_rows)), *order).sortWithinPartitions(*order)
    at = rows.columns.index(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(at).to_numpy(zero_copy_only=False)
            new = np.append(True, keys[1:] != keys[:-1])
            starts = np.flatnonzero(new)
            local = np.arange(len(keys)) - np.repeat(starts, np.diff(np.append(starts, len(keys))))
            if last is not None and keys[0] == last:
                local[: starts[1] if len(starts) > 1 else len(keys)] += seen
            last, seen = keys[-1], int(local[-1]) + 1
            extra = [pa.array(np.full(len(keys), part, np.int32)), pa.array(local.astype(np.int64))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, "part", "local"])

    return own.mapInArrow(run, StructType([*rows.schema, *StructType().add("part", IntegerType()).add("local", LongType())]))


def counts_of(rows: DataFrame, key: str) -> np.ndarray:
    """(part, key, n) in order; range-sorted rows have at most a row per part and one per value of the key."""
    found = rows.groupBy("part", key).count().collect()
    return np.array(sorted(tuple(r) for r in found), np.int64).reshape(-1, 3)


# ---------------------------------------------------------------- a superstep


class Sweep:
    """What one superstep does, by size. Arrays have an entry for each size up to the capacity.

    unit: the longest document that some gap holds. slots, slot: how many slots of which size a gap of a size has.
    enter: the level below the first slot of a size; stays: slots of a size up to this level find no document.
    top: the highest level when the documents of a length come; taken: how many of them find a slot.
    """

    def __init__(self, left: np.ndarray, gaps: np.ndarray, step: float = 0.0, short: int = 0):
        """left: documents per length that have no place yet; gaps: gaps per size. Documents from `unit` down to `step`
        of it take part, all of them once `unit` is at most `short`."""
        sizes = np.arange(len(left))
        held = np.flatnonzero(left[: int(np.flatnonzero(gaps).max(initial=0)) + 1])
        self.unit = int(held.max(initial=0))
        if not self.unit:
            return
        self.slots = np.where(sizes > 0, np.maximum(sizes // self.unit, 1), 0)
        self.slot = sizes // np.maximum(self.slots, 1)
        offered = np.bincount(self.slot, gaps * self.slots, minlength=len(left)).astype(np.int64)
        least = step * self.unit if self.unit > short else 0
        asked = np.where((sizes <= self.unit) & (sizes >= least), left, 0)
        # from the largest size down: what is open after the documents of a size
        running = np.cumsum((offered - asked)[::-1])
        open_ = (running - np.minimum(0, np.minimum.accumulate(running)))[::-1]
        self.enter = np.append(open_[1:], 0)
        self.top = self.enter + offered
        self.taken = np.minimum(asked, self.top)
        open_[0] = -1  # ends every search
        self.open = [open_]
        while 1 << len(self.open) < 2 * len(open_):
            below = np.maximum(sizes - (1 << (len(self.open) - 1)), 0)
            self.open.append(np.minimum(self.open[-1], self.open[-1][below]))
        self.stays = np.append(0, np.minimum.accumulate(open_[1:]))

    def lengths_of(self, slot: np.ndarray, level: np.ndarray) -> np.ndarray:
        """The longest length up to `slot` whose documents clear the level: the document that takes the slot has it."""
        at = slot.copy()
        for b in range(len(self.open) - 1, -1, -1):
            at -= np.where(self.open[b][at] >= level, 1 << b, 0)
        return at


MOVES = "kind int, sequence long, size int, length int, rank long"


def moves(gaps: DataFrame, sweep: Sweep, bases: dict[tuple[int, int], int], placed: np.ndarray, least: int, capacity: int) -> DataFrame:
    """gaps (sequence, size, part, local) -> rows of kind 0: a document's length and rank, and its sequence with the
    room there is before it comes; rows of kind 1: gaps that are left and hold `least` tokens."""
    shared = gaps.sparkSession.sparkContext.broadcast((sweep, bases, placed))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep, bases, placed = shared.value
        step = max(1, (1 << 17) // int(sweep.slots.max()))  # gaps at once, by the documents that they may take
        for batch in batches:
            for start in range(0, batch.num_rows, step):
                sequence, size, part, local = (c.slice(start, step).to_numpy(zero_copy_only=False).astype(np.int64) for c in batch.columns)
                n, slot = sweep.slots[size], sweep.slot[size]
                both, where = np.unique(np.stack([part, size]), axis=1, return_inverse=True)
                base = np.array([bases[p, s] for p, s in both.T.tolist()], np.int64)[where.ravel()]
                before = sweep.enter[slot] + base + local * n  # the level below the gap's first slot
                hits = np.clip(before + n - np.maximum(before, sweep.stays[slot]), 0, n)
                row = np.repeat(np.arange(len(size)), hits)
                turn = np.arange(len(row)) - np.repeat(np.cumsum(hits) - hits, hits)
                level = (before + n)[row] - turn
                length = sweep.lengths_of(slot[row], level)
                rank = placed[length] + sweep.top[length] - level
                total = np.concatenate([[0], np.cumsum(length)])
                ends = np.cumsum(hits)
                room = size[row] - (total[:-1] - total[(ends - hits)[row]])
                rest = size - (total[ends] - total[ends - hits])
                open_ = rest >= least
                kinds = np.repeat([0, 1], [len(row), open_.sum()])
                blank = np.zeros(open_.sum(), np.int64)
                columns = (kinds, np.append(sequence[row], sequence[open_]), np.append(room, rest[open_]), np.append(length, blank), np.append(rank, blank))
                types = (pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(c).cast(t) for c, t in zip(columns, types, strict=True)], names=[x.split()[0] for x in MOVES.split(", ")])

    return gaps.select("sequence", "size", "part", "local").mapInArrow(lean(run), MOVES)


def bases_of(counts: np.ndarray, sweep: Sweep) -> dict[tuple[int, int], int]:
    """(part, size) -> slots of the same slot size before it."""
    out, before = {}, np.zeros(len(sweep.slot), np.int64)
    for part, size, n in counts.tolist():
        out[part, size] = int(before[sweep.slot[size]])
        before[sweep.slot[size]] += n * sweep.slots[size]
    return out


# ---------------------------------------------------------------- the operator


#: A superstep takes documents down to this part of the longest, so that shorter ones see what these leave; documents of
#: this part of the capacity, or less, come all at once.
STEP, SHORT = 0.8, 1 / 64


def place(left: np.ndarray, capacity: int, scratch: Scratch, grain_rows: int) -> list[DataFrame]:
    """Tables of moves that place all documents, `left` of each length; the ranks of a length count from 0."""
    spark = scratch.spark
    lengths = np.arange(capacity + 1)
    left, placed = left.copy(), np.zeros(capacity + 1, np.int64)
    gaps, counts, sequences, out = None, np.zeros((0, 3), np.int64), 0, []
    while left.any():
        by_size = np.bincount(counts[:, 1], counts[:, 2], minlength=capacity + 1).astype(np.int64)
        sweep = Sweep(left, by_size, STEP, int(SHORT * capacity))
        used = gaps
        if not sweep.unit:
            # no gap holds any: at least so many sequences are needed, by tokens and by documents that cannot share one
            n = max(-(-int(left @ lengths) // capacity), int(left[capacity // 2 + 1 :].sum()))
            fresh = spark.range(sequences, sequences + n).select(F.col("id").alias("sequence"), F.lit(capacity).alias("size"), F.lit(-1).alias("part"), (F.col("id") - sequences).alias("local"))
            used = fresh if gaps is None else gaps.unionByName(fresh)
            counts = np.concatenate([[[-1, capacity, n]], counts])
            sequences += n
            by_size[capacity] += n
            sweep = Sweep(left, by_size, STEP, int(SHORT * capacity))
        left = left - sweep.taken
        least = int(np.flatnonzero(left).min(initial=capacity + 1))
        made = scratch.table(moves(used, sweep, bases_of(counts, sweep), placed, least, capacity), "moves", partition_by="kind")
        placed = placed + sweep.taken
        out.append(made.where("kind = 0"))
        if gaps is not None:
            scratch.drop(gaps)
        if left.any():
            rest = made.where("kind = 1").select("sequence", "size")
            gaps = scratch.table(range_sorted(rest, "size", ["sequence"], sequences, grain_rows), "gaps")
            counts = counts_of(gaps, "size")
    return out


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = 1, capacity: int = 4096, grain_rows: int = 50_000) -> DataFrame:
    """A row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. grain_rows: rows of a sorting task."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "pack")
    cut = scratch.table(pieces(docs, id_col, text_col, tokenizer_path, end_id, capacity), "pieces")
    ranked = scratch.table(range_sorted(cut, "length", ["doc_id", "piece", "start", "ids_crc32"], cut.count(), grain_rows), "documents")
    scratch.drop(cut)
    counts = counts_of(ranked, "length")
    left = np.bincount(counts[:, 1], counts[:, 2], minlength=capacity + 1).astype(np.int64)
    before, bases = np.zeros(capacity + 1, np.int64), []
    for _, length, n in counts.tolist():
        bases.append(before[length])
        before[length] += n
    columns = {"part": pa.array(counts[:, 0], pa.int32()), "length": pa.array(counts[:, 1], pa.int64()), "base": pa.array(np.array(bases, np.int64))}
    # a row per sorting task and one per length: small enough to send to every task
    based = ranked.join(F.broadcast(spark.createDataFrame(pa.table(columns))), ["part", "length"]).withColumn("rank", F.col("base") + F.col("local"))
    out = ["doc_id", "piece", "start", "length", "ids_crc32"]
    tables = place(left, capacity, scratch, grain_rows)
    if not tables:
        return based.select(*out, F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    places = tables[0]
    for more in tables[1:]:
        places = places.unionByName(more)
    places = places.select(F.col("length").cast("long").alias("length"), "rank", F.col("sequence").alias("sequence_id"), (capacity - F.col("size")).cast("long").alias("offset"))
    return based.join(places, ["length", "rank"]).select(*out, "sequence_id", "offset")
