"""Shared pieces: scratch tables, text buffers, hashing, block sums, Bloom filters, folds."""

from __future__ import annotations

import ctypes
import functools
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space of every contract here: blank and U+0009 to U+000D.
SPACES = b" \t\n\x0b\x0c\r"
#: The same as characters, for Spark's translate().
SPACE_CHARS = SPACES.decode()


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a temporary folder of our own serves a session whose executors are threads of this machine; on
    a cluster each executor would write to its own disk, so there it is an error.
    """
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set: tables between steps need a folder that all executors of {master} share")
        found = f"file://{tempfile.mkdtemp(prefix='doclens-')}"
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


#: Bytes of an Arrow batch between the JVM and a Python worker; rows may be long, so their number alone bounds nothing.
BATCH_BYTES = "4m"


def bound_batches(spark: SparkSession) -> None:
    """Bound the bytes of Arrow batches, unless the session has a bound of its own."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    if spark.conf.get(key, None) is None:
        spark.conf.set(key, BATCH_BYTES)


def give_back() -> None:
    """Hand unused memory of this worker back to the system: workers live on, and the next stage needs its own."""
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError):  # another C library
        pass


def lean(run: Callable) -> Callable:
    """run(batches), giving back memory when its partition ends."""

    @functools.wraps(run)
    def wrapped(*args):
        try:
            yield from run(*args)
        finally:
            give_back()

    return wrapped


def map_rows(rows: DataFrame, run: Callable) -> DataFrame:
    """rows through run(batches), which keeps their columns; these may be called anything."""
    plain = rows.toDF(*(f"c{k}" for k in range(len(rows.columns))))
    return plain.mapInArrow(lean(run), plain.schema).toDF(*rows.columns)


def whole(columns: list[str]) -> Column:
    """A row as one struct, whatever its columns are called."""
    return F.struct(*(F.col(quoted(c)) for c in columns))


def quoted(name: str) -> str:
    """A column's name for F.col(), dots and backticks included."""
    return "`" + name.replace("`", "``") + "`"


#: Rows of a small table that one task writes.
SMALL_ROWS = 20_000


class Scratch:
    """Tables written in the shared folder: they cut lineage and survive the loss of executors."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self._n = 0
        bound_batches(spark)

    def path(self, name: str) -> str:
        self._n += 1
        return f"{self.root}/{self._n}-{name}"

    def table(self, df: DataFrame, name: str, partition_by: str | None = None, rows: int | None = None) -> DataFrame:
        """Write df now and give the DataFrame that reads it; its `scratch_path` names the folder.

        rows: how many there are at most, where that is known: a small table needs no file of each shuffle partition.
        """
        if rows is not None and rows < 2_000_000:
            df = df.coalesce(max(1, -(-rows // SMALL_ROWS)))
        path, writer = self.path(name), df.write
        (writer.partitionBy(partition_by) if partition_by else writer).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, *tables: DataFrame | str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(table if isinstance(table, str) else table.scratch_path)
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)


def crc_fold(id_col, modulus: int):
    """crc32 of the id as text, modulo `modulus`; null for a null id."""
    return F.pmod(F.crc32(id_col.cast("string").cast("binary")), F.lit(modulus))


# ---------------------------------------------------------------- text buffers


def text_buffer(column) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of an Arrow string column and int64 offsets of its rows; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    width = np.int64 if pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    if len(column) == 0 or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(offsets, width)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


#: Bytes of text that a task works on at once; arrays of the work are some ten times as large.
CHUNK = 1 << 18


def row_chunks(offsets: np.ndarray, limit: int = CHUNK) -> Iterator[tuple[int, int]]:
    """Cut rows into runs of at most `limit` bytes; a longer row is a run of its own."""
    row, n = 0, len(offsets) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end
        row = end


def lower_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table


LOWER = lower_table()
IS_SPACE = np.zeros(256, bool)
IS_SPACE[list(SPACES)] = True


# ---------------------------------------------------------------- hashing


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finalizer (xor-shift and multiply), in place on a uint64 array."""
    x ^= x >> np.uint64(31)
    x *= np.uint64(0x7FB5D329728EA185)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x81DADEF4BC2DD44D)
    x ^= x >> np.uint64(33)
    return x


_BASE = 0x9E3779B97F4A7C55
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = mix64(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
#: Words beyond this many bytes are hashed one by one: the sums below are a polynomial, for which long words can be made
#: that collide.
LONG_WORD = 64


@functools.cache
def _power_tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, for as many bytes as a chunk has."""
    tables = []
    for base in (_BASE, _INVERSE):
        steps = np.full(CHUNK, base, np.uint64)
        steps[0] = 1
        tables.append(np.cumprod(steps))
    return tuple(tables)


def _word_ends(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each word; words end with their row."""
    solid = ~IS_SPACE[data]
    first = np.zeros(len(data) + 1, bool)
    first[offsets[:-1]] = True
    start, stop = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1] | first[1:-1]
    stop[:-1] &= ~solid[1:] | first[1:-1]
    return np.flatnonzero(start), np.flatnonzero(stop) + 1


def _long_hash(data: np.ndarray, start: int, stop: int) -> int:
    digest = xxhash.xxh64(seed=stop - start)
    for at in range(start, stop, CHUNK):
        digest.update(LOWER[data[at : min(stop, at + CHUNK)]].tobytes())
    return digest.intdigest()


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word `[^\\x20\\x09-\\x0D]+`, A-Z lower-cased, and its row; of CHUNK bytes at most.

    A word's hash is the difference of two prefix sums of byte values times powers of a base, brought to position 0.
    """
    if not len(data):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    start, stop = _word_ends(data, offsets)
    power, inverse = _power_tables()
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[LOWER[data]] * power[: len(data)], out=sums[1:])
    hashed = (sums[stop] - sums[start]) * inverse[start]
    hashed += (stop - start).astype(np.uint64) * np.uint64(0xA24BAED4963EE407)
    hashed = mix64(hashed)
    for k in np.flatnonzero(stop - start > LONG_WORD):
        hashed[k] = _long_hash(data, int(start[k]), int(stop[k]))
    return hashed, np.searchsorted(offsets, start, "right") - 1


def space_cuts(data: np.ndarray, piece: int) -> Iterator[tuple[int, int]]:
    """Cut a text behind white space into pieces of at most `piece` bytes; a longer word is a piece of its own."""
    at, n = 0, len(data)
    while at < n:
        end = min(n, at + piece)
        if end < n:
            gaps = np.flatnonzero(IS_SPACE[data[at:end]])
            if len(gaps):
                end = at + int(gaps[-1]) + 1
            else:  # the word goes on
                while end < n and not IS_SPACE[data[end]]:
                    step = IS_SPACE[data[end : end + piece]]
                    end += int(step.argmax()) if step.any() else len(step)
        yield at, end
        at = end


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """word_hashes() in pieces of bounded size: a longer single row is cut at white space, a longer word hashed in steps."""
    if len(data) <= CHUNK:
        return word_hashes(data, offsets)
    found = []
    for at, end in space_cuts(data, CHUNK):
        if end - at <= CHUNK:
            found.append(word_hashes(data[at:end], np.array([0, end - at]))[0])
        else:
            found.append(np.array([_long_hash(data, at, end)], np.uint64))
    found = np.concatenate(found)
    return found, np.zeros(len(found), np.int64)


# ---------------------------------------------------------------- sums of arrays over partitions


def block_rows(array: np.ndarray, block: int) -> Iterator[pa.RecordBatch]:
    """An array's blocks that hold something, as rows (block, values)."""
    for k in range(0, len(array), block):
        part = array[k : k + block]
        if part.any():
            yield pa.record_batch({"block": pa.array([k // block], pa.int32()), "values": pa.array([part.tobytes()], pa.binary())})


BLOCK_SCHEMA = "block int, values binary"


def sum_blocks(rows: DataFrame, dtype, ceiling: int | None = None) -> DataFrame:
    """Add up the blocks of all tasks; a task holds one block at a time."""

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for value in batch.column("values").to_pylist():
                value = np.frombuffer(value, dtype)
                total = value.copy() if total is None else total + value
        if ceiling is not None:
            np.minimum(total, ceiling, out=total)
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([total.tobytes()], pa.binary())})

    return rows.groupBy("block").applyInArrow(add, BLOCK_SCHEMA)


def gather_blocks(summed: DataFrame, size: int, block: int, dtype) -> np.ndarray:
    """The summed array on the driver, by one job; its size is a parameter, never the data's."""
    out = np.zeros(size, dtype)
    for row in summed.collect():
        value = np.frombuffer(bytes(row["values"]), dtype)
        out[row["block"] * block : row["block"] * block + len(value)] = value
    return out


# ---------------------------------------------------------------- Bloom filter over long keys


class Bloom:
    """A blocked Bloom filter over 64-bit keys: a key's bits are all in one block of 64 kB.

    hit(keys) has false positives at a rate of about 1 % and no false negatives.
    """

    HASHES, BITS_PER_KEY, BLOCK_BITS = 5, 10, 1 << 19

    def __init__(self, words: np.ndarray):
        """words: blocks x 8192 unsigned 64-bit words."""
        self.words = words

    @classmethod
    def blocks_for(cls, n_keys: int) -> int:
        return max(1, -(-n_keys * cls.BITS_PER_KEY // cls.BLOCK_BITS))

    @staticmethod
    def block_of(keys: np.ndarray, blocks: int) -> np.ndarray:
        return (mix64(keys + np.uint64(0x632BE59BD9B4E019)) >> np.uint64(32)) * np.uint64(blocks) >> np.uint64(32)

    @classmethod
    def bits_of(cls, keys: np.ndarray) -> Iterator[np.ndarray]:
        one = mix64(keys ^ np.uint64(0x9FB21C651E98DF25))
        two = mix64(one + np.uint64(0xA24BAED4963EE407)) | np.uint64(1)
        for k in range(cls.HASHES):
            yield (one + np.uint64(k) * two) >> np.uint64(45)

    @classmethod
    def block(cls, keys: np.ndarray) -> np.ndarray:
        """The words of one block with these keys."""
        flags = np.zeros(cls.BLOCK_BITS, bool)
        for at in cls.bits_of(keys):
            flags[at.astype(np.int64)] = True
        return np.packbits(flags, bitorder="little").view(np.uint64)

    @classmethod
    def of(cls, keys: np.ndarray) -> Bloom:
        """The filter of keys that are at hand."""
        keys = keys.astype(np.int64, copy=False).view(np.uint64)
        blocks = cls.blocks_for(len(keys))
        own = cls.block_of(keys, blocks)
        return cls(np.stack([cls.block(keys[own == k]) for k in range(blocks)]))

    @classmethod
    def from_bytes(cls, words: bytes) -> Bloom:
        return cls(np.frombuffer(words, np.uint64).reshape(-1, cls.BLOCK_BITS // 64))

    def hit(self, keys: np.ndarray) -> np.ndarray:
        keys = keys.astype(np.uint64, copy=False)
        row = self.block_of(keys, len(self.words)).astype(np.int64)
        found = np.ones(len(keys), bool)
        for at in self.bits_of(keys):
            found &= (self.words[row, (at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1) != 0
        return found


#: Keys up to which a Bloom filter may be broadcast (40 MB of bits); beyond, callers join instead.
BLOOM_MOST_KEYS = 32_000_000


def build_bloom(keys: DataFrame, n_keys: int) -> Bloom | None:
    """The filter of a one-column DataFrame of longs, or None where it would pass the size bound. Blocks are built apart."""
    if n_keys > BLOOM_MOST_KEYS:
        return None
    blocks = Bloom.blocks_for(n_keys)

    def deal(batches):
        for batch in batches:
            own = batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            yield pa.record_batch({"block": pa.array(Bloom.block_of(own.view(np.uint64), blocks).astype(np.int32)), "key": pa.array(own)})

    def build(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = np.zeros(Bloom.BLOCK_BITS // 64, np.uint64)
        for batch in batches:
            words |= Bloom.block(batch.column(1).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64))
        yield pa.record_batch({"block": pa.array([key[0].as_py()], pa.int32()), "values": pa.array([words.tobytes()], pa.binary())})

    made = keys.mapInArrow(deal, "block int, key long").groupBy("block").applyInArrow(build, BLOCK_SCHEMA)
    size = Bloom.BLOCK_BITS // 64
    return Bloom(gather_blocks(made, blocks * size, size, np.uint64).reshape(blocks, size))


def let_through(bloom: Bloom, keys: pa.Array) -> np.ndarray:
    """Flags of the long keys that the filter lets through; none of null keys."""
    return bloom.hit(keys.fill_null(0).to_numpy(zero_copy_only=False).view(np.uint64)) & keys.is_valid().to_numpy(zero_copy_only=False)


def sieve(rows: DataFrame, key: Column, bloom: Bloom) -> tuple[DataFrame, DataFrame]:
    """rows whose long key the filter lets through, and the others; null keys are among the others."""
    keyed = rows.withColumn("_sieved", key)
    shared = rows.sparkSession.sparkContext.broadcast(bloom.words)

    def part(wanted: bool) -> DataFrame:
        def run(batches):
            held = Bloom(shared.value)
            for batch in batches:
                yield batch.filter(pa.array(let_through(held, batch.column(batch.num_columns - 1)) == wanted))

        return map_rows(keyed, run).drop("_sieved")

    return part(True), part(False)
