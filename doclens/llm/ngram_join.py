"""N-gram Jaccard join by vertical partitioning.

A document's set is its distinct word n-grams, hashed to 64 bits. The global order of n-grams is (level, hash): a table
of a fixed number of cells tells frequent n-grams from others by the logarithm of their count over all documents. The
order is only a hint: any order gives the same result. Sets are cut along that order into fragments.

1. Documents with equal sets form a class; the smallest id represents it. Copies never meet again.
2. Fragments are joined on n-grams that a partner must share: of the first n-grams of a set in the global order a linked
   pair has one in common. The classes that share such an n-gram are its bucket. Each bucket has a hub, the class with
   the fewest n-grams before it; hub pairs are counted first, and what they link is contracted to components.
3. Pairs of a bucket whose classes are still in different components follow (all pairs, if all links are asked for).
   Length and position filters apply to both rounds and lose no link.
4. Counting: the fragments' overlaps of a pair are counted separately, from the rarest fragment on, and summed. A pair
   leaves at the fragment after which its sum cannot reach the threshold any more.

Defined results: null and empty texts and texts without words have an empty set and link with nothing; texts with
fewer words than n have their whole sequence as the only n-gram; rows with a null id link with nothing and have no
component; rows that repeat an id come back each with the size of its own set, and their id has the links of all of them;
an empty table gives no rows; texts may be of any length. Words are told apart by 64-bit hashes, sets by 128 bits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from doclens.llm.common import BLOCK_SCHEMA, Bloom, Scratch, build_bloom, lean, mix64, quoted, row_chunks, sieve, text_buffer, whole, words_of

#: The count table: cells by the top bits of an n-gram's hash, in blocks that one task sums.
BITS, BLOCK_CELLS = 24, 1 << 18
#: Classes of several documents, and pairs, up to which they are sent to every task (about 60 bytes each).
BROADCAST_CLASSES = BROADCAST_PAIRS = 200_000
#: Pairs of one class that one task counts.
SALT_PAIRS = 20_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int) -> Iterator[np.ndarray]:
    """For each row its sorted distinct n-gram hashes."""
    words, rows = words_of(data, offsets)
    n_rows = len(offsets) - 1
    bounds = np.searchsorted(rows, np.arange(n_rows + 1))
    if len(words) >= n:
        grams = words[: len(words) - n + 1].copy()
        for k in range(1, n):
            grams *= np.uint64(0xC2B2AE3D27D4EB4F)
            grams += words[k : len(words) - n + 1 + k]
            mix64(grams)
    for row in range(n_rows):
        a, b = int(bounds[row]), int(bounds[row + 1])
        if b - a >= n:
            yield np.unique(grams[a : b - n + 1])
        elif b > a:
            whole = np.array([b - a], np.uint64)
            for w in words[a:b]:
                whole *= np.uint64(0x9FB21C651E98DF25)
                whole += w
                mix64(whole)
            yield whole
        else:
            yield np.zeros(0, np.uint64)


def set_keys(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that tell equal sets: two independent sums of mixed members."""
    one = mix64(grams + np.uint64(0x165667B19E3779F9))
    two = mix64(grams ^ np.uint64(0x27D4EB2F165667C5)) * np.uint64(0x85EBCA77C2B2AE63)
    return int(one.sum(dtype=np.uint64).astype(np.int64)), int(two.sum(dtype=np.uint64).astype(np.int64))


def each_set(batches, n: int, want=None) -> Iterator[tuple[pa.Array, list[np.ndarray]]]:
    """(ids, sets) for runs of rows of bounded size. want(ids) -> flags of the rows that matter."""
    for batch in batches:
        if want is not None:
            batch = batch.filter(pa.array(want(batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64))))
            if not batch.num_rows:
                continue
        data, offsets = text_buffer(batch.column(1))
        for start, end in row_chunks(offsets):
            own = offsets[start : end + 1] - offsets[start]
            yield batch.column(0).slice(start, end - start), list(shingle_sets(data[offsets[start] : offsets[end]], own, n))


class Order:
    """The global order: a level for each cell, and the share of all n-grams below each level."""

    def __init__(self, levels: np.ndarray, mass: np.ndarray):
        self.levels = levels
        self.share = np.concatenate([[0.0], np.cumsum(mass)]) / max(mass.sum(), 1.0)

    def of(self, grams: np.ndarray) -> np.ndarray:
        return self.levels[(grams >> np.uint64(64 - BITS)).astype(np.int64)]

    def fragment_of(self, grams: np.ndarray, fragments: int) -> np.ndarray:
        """Which of equal cuts of the order, by level then hash, each n-gram is in."""
        levels = self.of(grams).astype(np.int64)
        low, high = self.share[levels], self.share[levels + 1]
        place = low + (high - low) * (grams.astype(float) / 2.0**64)
        return np.minimum((place * fragments).astype(np.int64), fragments - 1)


def count_levels(docs: DataFrame, n: int) -> Order:
    """Counts over all documents of the n-grams of each cell. Tasks tell the cells that they have seen more than once, so
    what they send does not grow with the table; a cell's level is 16 times the logarithm of its count, to base 2."""

    def run(batches):
        cells, seen = np.zeros(1 << BITS, np.uint8), 0
        for _, sets in each_set(batches, n):
            found, times = np.unique(np.concatenate(sets) >> np.uint64(64 - BITS), return_counts=True)
            found = found.astype(np.int64)
            cells[found] = np.minimum(cells[found] + times, 255)
            seen += int(times.sum())
        packer = zstandard.ZstdCompressor(level=3)
        for k in range(0, len(cells), BLOCK_CELLS):
            at = np.flatnonzero(cells[k : k + BLOCK_CELLS] > 1)
            if len(at):
                steps = np.diff(at, prepend=0).astype("<u4")
                values = packer.compress(steps.view(np.uint8).reshape(-1, 4).T.tobytes() + cells[k + at].tobytes())
                yield pa.record_batch({"block": pa.array([k // BLOCK_CELLS], pa.int32()), "values": pa.array([values], pa.binary())})
        yield pa.record_batch({"block": pa.array([-1], pa.int32()), "values": pa.array([seen.to_bytes(8, "little")], pa.binary())})

    def add(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, total, reader, seen = key[0].as_py(), np.zeros(BLOCK_CELLS, np.int64), zstandard.ZstdDecompressor(), 0
        for batch in batches:
            for value in batch.column("values").to_pylist():
                if block < 0:
                    seen += int.from_bytes(value, "little")
                    continue
                raw = np.frombuffer(reader.decompress(value), np.uint8)
                m = len(raw) // 5
                at = np.cumsum(np.ascontiguousarray(raw[: 4 * m].reshape(4, m).T).view("<u4").ravel(), dtype=np.int64)
                total[at] += raw[4 * m :]
        levels = np.minimum(np.round(16 * np.log2(total + 1)), 255).astype(np.uint8)
        mass = np.bincount(levels, total, minlength=256)
        values = seen.to_bytes(8, "little") if block < 0 else zstandard.ZstdCompressor(level=1).compress(levels.tobytes()) + mass.tobytes()
        yield pa.record_batch({"block": pa.array([block], pa.int32()), "values": pa.array([values], pa.binary())})

    summed = docs.mapInArrow(lean(run), BLOCK_SCHEMA).groupBy("block").applyInArrow(add, BLOCK_SCHEMA)
    levels, mass, seen = np.zeros(1 << BITS, np.uint8), np.zeros(256), 0
    for row in summed.collect():
        block, values = row["block"], bytes(row["values"])
        if block < 0:
            seen = int.from_bytes(values, "little")
        else:
            levels[block * BLOCK_CELLS : (block + 1) * BLOCK_CELLS] = np.frombuffer(zstandard.ZstdDecompressor().decompress(values[:-2048]), np.uint8)
            mass += np.frombuffer(values[-2048:])
    mass[0] = max(seen - mass[1:].sum(), 0)
    return Order(levels, mass)


def least_overlap(a: Column, b: Column, num: int, den: int) -> Column:
    """ceil(num * (a + b) / (num + den)): the overlap that makes a Jaccard similarity of num / den."""
    return F.floor((num * (a + b) + (num + den - 1)) / (num + den))


def repeated(heads: DataFrame, n_grams: int) -> tuple[DataFrame, int]:
    """Column `short`: the leading bits of n-grams that more than one prefix has, and how many bits are left out.

    Tasks deal their n-grams to blocks by the first bits and send the next 32 of each; a block's task finds those that
    come twice. Two n-grams with the same bits pass for one, which costs a posting, no more.
    """
    bits = max(4, (max(n_grams, 1) >> 20).bit_length())
    drop = 32 - bits

    def deal(batches):
        held: list[np.ndarray] = []

        def out():
            shorts = np.sort(np.concatenate(held) >> np.uint64(drop))
            held.clear()
            blocks = (shorts >> np.uint64(32)).astype(np.int64)
            cuts = np.flatnonzero(np.diff(blocks, prepend=-1))
            parts = [p.astype("<u4").tobytes() for p in np.split(shorts, cuts[1:])]
            return pa.record_batch({"block": pa.array(blocks[cuts].astype(np.int32)), "values": pa.array(parts, pa.binary())})

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy(zero_copy_only=False).view(np.uint64))
            if sum(map(len, held)) >= 1 << 20:
                yield out()
        if sum(map(len, held)):
            yield out()

    def find(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [np.frombuffer(v, "<u4") for batch in batches for v in batch.column("values").to_pylist()]
        own = np.sort(np.concatenate(parts))
        twice = np.unique(own[1:][own[1:] == own[:-1]]).astype(np.int64)
        yield pa.record_batch({"short": pa.array(twice + (key[0].as_py() << 32), pa.int64())})

    return heads.select("prefix").mapInArrow(lean(deal), BLOCK_SCHEMA).groupBy("block").applyInArrow(find, "short long"), drop


class Join:
    """One run of the join; classes(), links() and components() are its results."""

    def __init__(self, docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text", fragments: int = 4, spanning: bool = True):
        """num / den: the threshold. spanning: only as many links as components need."""
        self.spark = docs.sparkSession
        self.scratch = Scratch(self.spark, "ngram-join")
        self.n, self.num, self.den, self.fragments, self.spanning = n, num, den, fragments, spanning
        self.docs = docs.select(F.col(quoted(id_col)).cast("long").alias("id"), F.col(quoted(text_col)).alias("text"))

    # ---- sets, classes, buckets

    def profiles(self) -> DataFrame:
        """id, size, key1, key2, prefix: the first n-grams of the global order that a partner may share."""
        n, num, den = self.n, self.num, self.den
        self.order = self.spark.sparkContext.broadcast(count_levels(self.docs, self.n))
        shared = self.order

        def run(batches):
            order = shared.value
            for ids, sets in each_set(batches, n):
                keys = [set_keys(s) for s in sets]
                prefixes = []
                for grams in sets:
                    length = len(grams) - (-(-num * len(grams) // den)) + 1 if len(grams) else 0
                    # by level, then hash; sets are sorted by hash, so a stable sort by level is the global order
                    prefixes.append(grams[np.argsort(order.of(grams), kind="stable")[:length]].view(np.int64))
                lengths = np.cumsum([0, *map(len, prefixes)])
                yield pa.record_batch(
                    {
                        "id": ids,
                        "size": pa.array([len(s) for s in sets], pa.int64()),
                        "key1": pa.array([k[0] for k in keys], pa.int64()),
                        "key2": pa.array([k[1] for k in keys], pa.int64()),
                        "prefix": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(prefixes) if prefixes else np.zeros(0, np.int64))),
                    }
                )

        return self.docs.mapInArrow(lean(run), "id long, size long, key1 long, key2 long, prefix array<long>")

    def prepare(self) -> None:
        """Classes and postings. A class is told by its smallest id c and, should rows repeat that id, by its key k."""
        profiles = self.scratch.table(self.profiles(), "profiles")
        keys = ["key1", "key2", "size"]
        many = profiles.where("size > 0 and id is not null").groupBy(*keys).agg(F.min("id").alias("class_id"), F.count("*").alias("n")).where("n > 1").drop("n")
        many = self.scratch.table(many, "many")
        n_many = many.count()
        # only members of classes of several documents meet the table of these
        if n_many <= BROADCAST_CLASSES:
            joined = profiles.join(F.broadcast(many), keys, "left")
        elif (bloom := build_bloom(many.select("key1"), n_many)) is None:
            joined = profiles.join(many, keys, "left")
        else:
            hits, rest = sieve(profiles, F.col("key1"), bloom)
            joined = hits.join(many, keys, "left").unionByName(rest.withColumn("class_id", F.lit(None).cast("long")))
        own = F.when(F.col("id").isNotNull(), F.coalesce("class_id", "id"))
        classes = joined.select("id", "size", own.alias("class_id"), F.col("key1").alias("k"), F.when((own == F.col("id")) & (F.col("size") > 0), F.col("prefix")).alias("prefix"))
        self.classes_table = self.scratch.table(classes, "classes")
        self.scratch.drop(profiles, many)
        heads = self.classes_table.where("prefix is not null").select(F.col("id").alias("c"), "k", "size", "prefix")
        posted = self.posted(heads)
        # a bucket's hub has the fewest n-grams before this one
        hubs = posted.groupBy("gram").agg(F.min(F.struct("pos", F.col("c").alias("hub"), F.col("k").alias("hub_k"), F.col("size").alias("hub_size"))).alias("h"), F.count("*").alias("n")).where("n > 1")
        hubs = hubs.select("gram", "n", "h.hub", "h.hub_k", "h.hub_size", F.col("h.pos").alias("hub_pos"))
        self.postings = self.scratch.table(posted.join(hubs, "gram"), "postings")
        self.scratch.drop(posted)

    def posted(self, heads: DataFrame) -> DataFrame:
        """c, k, size, pos, gram of the n-grams that more than one prefix has; what else passes goes later."""
        n_grams = heads.agg(F.sum(F.col("size") - F.ceil(F.lit(self.num) * F.col("size") / F.lit(self.den)) + 1)).first()[0] or 0
        found, drop = repeated(heads, int(n_grams))
        shared = self.scratch.table(found, "shared")
        bloom = build_bloom(shared, shared.count())
        if bloom is None:
            each = heads.select("c", "k", "size", F.posexplode("prefix").alias("pos", "gram"))
            made = self.scratch.table(each.withColumn("short", F.shiftrightunsigned("gram", drop)).join(shared, "short", "left_semi").drop("short"), "posted")
            self.scratch.drop(shared)
            return made
        words = self.spark.sparkContext.broadcast(bloom.words)

        def run(batches):
            held = Bloom(words.value)
            for batch in batches:
                prefix = batch.column(3)
                grams = prefix.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                lengths = prefix.value_lengths().to_numpy(zero_copy_only=False)
                rows = np.repeat(np.arange(len(prefix)), lengths)
                pos = np.arange(len(grams)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
                keep = np.flatnonzero(held.hit(grams.view(np.uint64) >> np.uint64(drop)))
                at = pa.array(rows[keep])
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in range(3)), pa.array(pos[keep].astype(np.int32)), pa.array(grams[keep])], names=["c", "k", "size", "pos", "gram"])

        made = self.scratch.table(heads.mapInArrow(lean(run), "c long, k long, size long, pos int, gram long"), "posted")
        self.scratch.drop(shared)
        return made

    def _may_link(self, s1: Column, p1: Column, s2: Column, p2: Column) -> Column:
        """Length filter, and position filter: at the first shared n-gram only what follows can still be shared."""
        need = least_overlap(s1, s2, self.num, self.den)
        return (F.least(s1, s2) * self.den >= F.greatest(s1, s2) * self.num) & (F.least(s1 - p1, s2 - p2) >= need)

    # ---- counting overlaps by fragment

    def segments(self, wanted: DataFrame) -> DataFrame:
        """c, k, fragment, after, grams: sets of the wanted ids, cut along the global order; after: n-grams behind."""
        n, fragments, shared = self.n, self.fragments, self.order
        bloom = build_bloom(wanted, wanted.count())
        held_words = self.spark.sparkContext.broadcast(bloom.words) if bloom else None
        docs = self.docs.where("id is not null")
        docs = docs if bloom else docs.join(wanted.withColumnRenamed(wanted.columns[0], "id"), "id", "left_semi").select("id", "text")

        def run(batches):
            want, order = None, shared.value
            if held_words is not None:
                held = Bloom(held_words.value)
                want = lambda ids: held.hit(ids.view(np.uint64))
            for ids, sets in each_set(batches, n, want):
                keys, after, parts = [], [], []
                for grams in sets:
                    piece = order.fragment_of(grams, fragments)
                    left = len(grams)
                    keys.append(set_keys(grams)[0])
                    for f in range(fragments):
                        own = grams[piece == f]
                        left -= len(own)
                        parts.append(own.view(np.int64))
                        after.append(left)
                lengths = np.cumsum([0, *map(len, parts)])
                each = pa.array(np.repeat(np.arange(len(sets)), fragments))
                yield pa.record_batch(
                    {
                        "c": ids.take(each),
                        "k": pa.array(keys, pa.int64()).take(each),
                        "fragment": pa.array(np.tile(np.arange(fragments, dtype=np.int32), len(sets))),
                        "after": pa.array(after, pa.int64()),
                        "grams": pa.ListArray.from_arrays(pa.array(lengths, pa.int32()), pa.array(np.concatenate(parts))),
                    }
                )

        return docs.mapInArrow(lean(run), "c long, k long, fragment int, after long, grams array<long>")

    def fragment_overlap(self, pairs: DataFrame, segments: DataFrame, n_pairs: int) -> DataFrame:
        """pairs with the overlap in one fragment (own), and at most how much can follow (more)."""
        side = lambda c, k, right: F.struct(F.col(c).alias("c"), F.col(k).alias("k"), F.lit(right).alias("right"))
        sides = pairs.withColumn("s", F.explode(F.array(side("a", "ka", False), side("b", "kb", True)))).select(*PAIR, "common", "s.*")
        on = ["c", "k"]
        if n_pairs <= BROADCAST_PAIRS:
            sides = F.broadcast(sides)
        else:
            hot = sides.groupBy(*on).count().where(F.col("count") > SALT_PAIRS).select(*on, F.ceil(F.col("count") / SALT_PAIRS).cast("int").alias("salts"))
            hot = F.broadcast(self.scratch.table(hot, "hot"))  # a row for each SALT_PAIRS pairs at most
            sides = sides.join(hot, on, "left").withColumn("salt", F.coalesce(F.expr("pmod(xxhash64(a, b), salts)"), F.lit(0)).cast("int")).drop("salts")
            segments = segments.join(hot, on, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("salts") - 1, F.lit(0)))))
            on = [*on, "salt"]
        met = segments.join(sides, on)
        # rows that repeat an id repeat its segment
        of = lambda right, x: F.max(F.when(F.col("right") == right, F.col(x)))
        both = met.groupBy(*PAIR, "common").agg(of(False, "grams").alias("ga"), of(True, "grams").alias("gb"), F.least(of(False, "after"), of(True, "after")).alias("more"))
        return both.select(*PAIR, "common", F.size(F.array_intersect("ga", "gb")).cast("long").alias("own"), "more")

    def counted(self, pairs: DataFrame, name: str) -> DataFrame:
        """The pairs that link, with their overlap: fragment after fragment, while the sum can still reach the threshold."""
        n_pairs = pairs.count()
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("c")).distinct()
        segments = self.scratch.table(self.segments(wanted), "segments", partition_by="fragment")
        alive = pairs.select(*PAIR, F.lit(0).cast("long").alias("common"))
        for f in range(self.fragments):
            partial = self.fragment_overlap(alive, segments.where(F.col("fragment") == f).drop("fragment"), n_pairs)
            summed = partial.withColumn("common", F.col("common") + F.col("own"))
            kept = summed.where((F.col("common") + F.col("more")) * (self.num + self.den) >= (F.col("sa") + F.col("sb")) * self.num)
            before, alive = alive, self.scratch.table(kept.select(*PAIR, "common"), name, rows=n_pairs)
            if f:
                self.scratch.drop(before)
            n_pairs = alive.count()
        self.scratch.drop(segments)
        return alive

    def links(self) -> DataFrame:
        """a < b, common: linked classes; with `spanning` enough of them to connect what is connected."""
        if not hasattr(self, "postings"):
            self.prepare()
        p, col = self.postings, F.col

        def ordered(x: list[Column], y: list[Column]) -> list[Column]:
            """The two classes (c, k, size) by id, as a pair."""
            first = x[0] < y[0]
            return [F.when(first, one).otherwise(two).alias(name) for name, one, two in (("a", x[0], y[0]), ("ka", x[1], y[1]), ("b", y[0], x[0]), ("kb", y[1], x[1]), ("sa", x[2], y[2]), ("sb", y[2], x[2]))]

        star = p.where("c <> hub").where(self._may_link(col("size"), col("pos"), col("hub_size"), col("hub_pos")))
        star = self.scratch.table(star.select(*ordered([col("c"), col("k"), col("size")], [col("hub"), col("hub_k"), col("hub_size")])).distinct(), "star")
        linked = self.counted(star, "linked")
        # the only pair of a bucket of two is counted
        rest = p.where("n > 2").select("gram", "c", "k", "size", "pos", "hub")
        if self.spanning:
            labels = self.scratch.table(near_labels(linked.select("a", "b")), "labels")
            rest = rest.join(labels.select(F.col("node").alias("c"), "component"), "c", "left").withColumn("component", F.coalesce("component", "c"))
            split = rest.groupBy("gram").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo < hi").select("gram")
            rest = rest.join(split, "gram", "left_semi")
        else:
            labels, rest = None, rest.withColumn("component", F.col("c"))
        rest = self.scratch.table(rest, "rest")
        one, two = rest.alias("x"), rest.alias("y")
        met = one.join(two, (col("x.gram") == col("y.gram")) & (col("x.c") < col("y.c")) & (col("x.component") != col("y.component")) & (col("x.c") != col("x.hub")) & (col("y.c") != col("y.hub")) & self._may_link(col("x.size"), col("x.pos"), col("y.size"), col("y.pos")))
        more = met.select(*ordered([col("x.c"), col("x.k"), col("x.size")], [col("y.c"), col("y.k"), col("y.size")])).distinct().join(star.select("a", "ka", "b", "kb"), ["a", "ka", "b", "kb"], "left_anti")
        more = self.scratch.table(more.select(*PAIR), "more")
        self.scratch.drop(*(x for x in (p, rest, star, labels) if x is not None))
        del self.postings
        second = self.counted(more, "second")
        self.scratch.drop(more)
        return linked.unionByName(second).select("a", "b", "common")

    def classes(self) -> DataFrame:
        """id, size (of the set), class_id (smallest id with an equal set)."""
        if not hasattr(self, "classes_table"):
            self.prepare()
        return self.classes_table.select("id", "size", "class_id")

    def components(self) -> DataFrame:
        """id, size, class_id, component_id: smallest id reachable by links, itself included; null for a null id."""
        links = self.links().select("a", "b")
        classes = self.classes()
        # an id that several rows have connects their classes
        several = classes.where("id is not null").groupBy("id").agg(F.min("class_id").alias("lo"), F.max("class_id").alias("hi")).where("lo < hi").select("id")
        same_id = classes.join(several, "id", "left_semi").where("id <> class_id").select(F.col("id").alias("a"), F.col("class_id").alias("b")).distinct()
        labels = connected_components(links.unionByName(same_id), self.scratch)
        return classes.join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select("id", "size", "class_id", F.coalesce("component", "class_id").alias("component_id"))


#: A pair of classes: their ids, keys and sizes.
PAIR = ["a", "ka", "b", "kb", "sa", "sb"]


def keep_representatives(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns, but those that a smaller id is connected to; null ids stay.

    Ids that a filter over the dropped ids does not let through pass as they are read; only the others are joined.
    """
    join = Join(docs, n, num, den, id_col, text_col)
    gone = join.scratch.table(join.components().where("component_id <> id").select(F.col("id").alias("gone_id")).distinct(), "gone")
    own = F.col(quoted(id_col)).cast("long")
    without = lambda rows: rows.select(whole(docs.columns).alias("doc"), own.alias("gone_id")).join(gone, "gone_id", "left_anti").select("doc.*")
    bloom = build_bloom(gone, gone.count())
    if bloom is None:
        return without(docs)
    hits, rest = sieve(docs, own, bloom)
    return rest.unionByName(without(hits))


def near_labels(edges: DataFrame) -> DataFrame:
    """node, component: a smaller node within a few links, for pruning: nodes with one label are connected, others may be."""
    sides = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    near = sides.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    # two links away: members of a star meet the smallest of them through its hub
    over = sides.join(near.select(F.col("u").alias("v"), "m"), "v").groupBy("u").agg(F.min("m").alias("m"))
    jump = over.select(F.col("u").alias("m"), F.col("m").alias("mm"))
    return over.join(jump, "m", "left").select(F.col("u").alias("node"), F.coalesce("mm", "m").alias("component"))


def connected_components(edges: DataFrame, scratch: Scratch, most_rounds: int = 100) -> DataFrame:
    """node, component (smallest node reachable), for nodes with an edge; alternating large and small stars."""
    both = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()
    now, before = scratch.table(both, "edges"), None
    for _ in range(most_rounds):
        state = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        # large star: neighbours above a node go to its smallest neighbour or itself
        sides = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = sides.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("u", "m"))
        large = sides.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        # small star: a node and its neighbours below go to the smallest of them; repeated pairs change nothing till here
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").unionByName(down.select("u", F.col("m").alias("v"))).distinct()
        # a row for each pair and for each node above another, so twice as many at most
        old, now = now, scratch.table(small, "edges", rows=2 * state[0])
        scratch.drop(old)
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    labels = now.groupBy("u").agg(F.min("v").alias("v"))
    roots = labels.select(F.col("v").alias("node")).distinct().withColumn("component", F.col("node"))
    return labels.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(roots)
