"""Mixing sources to target weights by a low-discrepancy schedule. DataFrame functions only.

Targets are water-filled: sources share a budget by weight, none above `cap` times its own size, the excess shared
again. The words of a source, its documents in a shuffled order, form one stream that is cut into blocks of equal
token counts. Slot i of the schedule has the golden-ratio point frac(i * phi), which the cumulative weights map to
a source; a source's slots are ranked, and slot r takes block r of the source's stream, from the start again when
the stream ends. The last slot of a source stops at its target. A source that the points give fewer slots than its
target takes has the missing ones after the last point, source after source.

Ranks and running sums are two-level: within buckets of bounded size, and over the table of buckets; no task holds
one source's rows.

Defined results: null text has size 0 and is taken 0 times; null sources are one source, ordered last; a source
without words has target 0; repeated rows are rows of their own; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.common import SPACE_CHARS, Scratch, quoted, whole

#: Fractional part of the golden ratio in units of 2^-32, so that the points are exact in integers.
GOLDEN = 2654435769
ONE = 1 << 32


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+`: white space is made blank, then runs are counted."""
    blank = F.translate(F.coalesce(text, F.lit("")), SPACE_CHARS, " " * len(SPACE_CHARS))
    return F.size(F.filter(F.split(blank, " "), lambda w: w != "")).cast("long")


def targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(null_source, source, source_size) -> the same with weight and target.

    Sorted by cap / weight, the sources at their cap are a prefix; the others share what is left by weight.
    """
    order = Window.orderBy("null_source", "source")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    ranked = sizes.withColumn("weight", weight.cast("double")).withColumn("most", F.col("source_size") * F.lit(float(cap)))
    by_level = Window.orderBy(F.col("most") / F.col("weight"), "null_source", "source")
    before = by_level.rowsBetween(Window.unboundedPreceding, -1)
    all_rows = Window.partitionBy()
    ranked = (
        ranked.withColumn("budget", F.sum("source_size").over(all_rows) * F.lit(float(share)))
        .withColumn("capped", F.coalesce(F.sum("most").over(before), F.lit(0.0)))
        .withColumn("open", F.sum("weight").over(all_rows) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", (F.col("budget") - F.col("capped")) / F.col("open"))
    )
    # the level holds from the first source that stays under its cap on
    final = F.min(F.when(F.col("level") * F.col("weight") <= F.col("most"), F.struct(F.col("most") / F.col("weight"), "null_source", "source", "level"))).over(all_rows)
    target = F.least(F.col("most"), F.coalesce(final["level"] * F.col("weight"), F.col("most")))
    return ranked.select("null_source", "source", "source_size", "weight", target.alias("target"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, block_tokens: int = 2048, least_slots: int = 100_000, bucket_rows: int = 4_000) -> DataFrame:
    """The mix as one row per document row: id, source, size, source_size, target, taken.

    Blocks hold `block_tokens` words, fewer where the schedule would have under `least_slots` slots.
    """
    t = schedule(docs, id_col, text_col, source_col, weights, share, cap, block_tokens, least_slots, bucket_rows)
    pieces, slots = t["pieces"], t["slots"]
    visits = slots.groupBy("sid", "block").agg(F.sum(F.when(F.col("take") == F.col("block_size"), 1).otherwise(0)).alias("full"), F.max(F.when(F.col("take") < F.col("block_size"), F.col("take"))).alias("part"))
    got = pieces.where("size > 0").join(visits, ["sid", "block"], "left")
    cut = F.when(F.col("part").isNotNull(), F.greatest(F.lit(0), F.least("piece_end", "part") - F.col("piece_start")))
    taken = F.sum(F.coalesce(F.col("full") * (F.col("piece_end") - F.col("piece_start")), F.lit(0)) + F.coalesce(cut, F.lit(0))).cast("long")
    worded = got.groupBy("sid", "start", "id", "size").agg(taken.alias("taken"))
    none = pieces.where("size = 0").select("sid", "start", "id", "size", F.lit(0).cast("long").alias("taken"))
    out = worded.unionByName(none).join(t["sources"], "sid")
    return out.select(F.col("id").alias(id_col), F.col("source").alias(source_col), "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **settings) -> DataFrame:
    """The documents of the mix, all columns: a row for each pass of the schedule that takes at least half of the words."""
    taken = mix(docs, id_col, text_col, source_col, **settings).where("size > 0").select(F.col(quoted(id_col)).alias("mix_id"), F.col("size").alias("mix_size"), F.expr("cast(floor(taken / size + 0.5) as int)").alias("mix_copies"))
    # rows that repeat an id and a size are told apart by their turn
    turn = lambda order: F.row_number().over(Window.partitionBy("mix_id", "mix_size").orderBy(order))
    numbered = docs.select(whole(docs.columns).alias("doc"), F.col(quoted(id_col)).alias("mix_id"), word_count(F.col(quoted(text_col))).alias("mix_size"), F.xxhash64(F.col(quoted(text_col))).alias("mark")).withColumn("mix_turn", turn("mark"))
    taken = taken.withColumn("mix_turn", turn("mix_copies"))
    one, two = numbered.alias("d"), taken.alias("t")
    rows = one.join(two, F.col("d.mix_id").eqNullSafe(F.col("t.mix_id")) & (F.col("d.mix_size") == F.col("t.mix_size")) & (F.col("d.mix_turn") == F.col("t.mix_turn")))
    return rows.where("mix_copies > 0").select("doc", F.explode(F.expr("sequence(1, mix_copies)"))).select("doc.*")


def schedule(docs: DataFrame, id_col: str, text_col: str, source_col: str, weights: tuple[int, ...], share: float, cap: float, block_tokens: int, least_slots: int, bucket_rows: int) -> dict[str, DataFrame]:
    """sources (sid, target ...), slots (slot, sid, rank, block, take) in the order of the mix, and pieces of documents by block."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "mix")
    sized = docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(source_col)).isNull().alias("null_source"), F.coalesce(F.col(quoted(source_col)).cast("string"), F.lit("")).alias("source"), word_count(F.col(quoted(text_col))).alias("size"))
    sized = scratch.table(sized, "sized")
    sizes = sized.groupBy("null_source", "source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n_rows"))
    goal = targets(sizes.drop("n_rows"), weights, share, cap)
    sources = goal.join(sizes.select("null_source", "source", "n_rows"), ["null_source", "source"]).withColumn("sid", F.row_number().over(Window.orderBy("null_source", "source")))
    up_to = Window.orderBy("sid")
    total = F.sum("target").over(Window.partitionBy())
    sources = (
        sources.withColumn("total", total)
        .withColumn("block_tokens", F.greatest(F.lit(1), F.least(F.lit(block_tokens), F.floor(F.col("total") / least_slots))).cast("long"))
        .withColumn("high", F.when(F.col("total") > 0, F.sum("target").over(up_to.rowsBetween(Window.unboundedPreceding, 0)) / F.col("total")).otherwise(0.0))
        .withColumn("low", F.when(F.col("total") > 0, F.coalesce(F.sum("target").over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)) / F.col("total")).otherwise(0.0))
        .withColumn("buckets", F.ceil(F.col("n_rows") / bucket_rows))
        .withColumn("blocks", F.ceil(F.col("source_size") / F.col("block_tokens")))
        .withColumn("goal", F.floor("target").cast("long"))
        # slots to the goal: the last block of each pass may be short
        .withColumn("need", F.when(F.col("goal") > 0, F.expr("goal div source_size * blocks + (goal % source_size + block_tokens - 1) div block_tokens")).otherwise(F.lit(0)))
        .withColumn("source", F.when(~F.col("null_source"), F.col("source")))
    )
    sources = scratch.table(sources, "sources")

    # documents laid end to end within their source, in shuffled order
    key = F.xxhash64("id", "size")
    placed = sized.withColumn("source", F.when(~F.col("null_source"), F.col("source"))).join(sources.select("sid", F.col("source").alias("s"), "buckets", "block_tokens"), F.col("source").eqNullSafe(F.col("s")))
    placed = placed.select("sid", "id", "size", "block_tokens", key.alias("key"), F.expr("pmod(xxhash64(id, size, 7), buckets)").cast("int").alias("bucket"))
    sums = placed.groupBy("sid", "bucket").agg(F.sum("size").alias("words"))
    sums = sums.withColumn("base", F.coalesce(F.sum("words").over(Window.partitionBy("sid").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("words")
    inside = Window.partitionBy("sid", "bucket").orderBy("key", "id", "size").rowsBetween(Window.unboundedPreceding, -1)
    laid = placed.withColumn("inner", F.coalesce(F.sum("size").over(inside), F.lit(0))).join(sums, ["sid", "bucket"])
    laid = laid.select("sid", "id", "size", "block_tokens", (F.col("base") + F.col("inner")).alias("start"))
    pieces = laid.withColumn("block", F.explode(F.expr("sequence(start div block_tokens, greatest(start, start + size - 1) div block_tokens)")))
    pieces = pieces.select("sid", "id", "size", "start", "block", F.greatest(F.lit(0), F.col("start") - F.col("block") * F.col("block_tokens")).alias("piece_start"), F.least(F.col("block_tokens"), F.col("start") + F.col("size") - F.col("block") * F.col("block_tokens")).alias("piece_end"))

    # slots: golden-ratio points through the cumulative weights, found by cells of the unit interval
    cells = 1024
    head = sources.agg(F.first("total").alias("total"), F.first("block_tokens").alias("b")).selectExpr("cast(ceil(total / b * 1.02) as bigint) + 64 as n")
    n_slots = (head.first() or [0])[0] or 0
    raw = F.expr(f"(id & {(1 << 31) - 1}) * {GOLDEN} % {ONE} + ((id >> 31) & 1) * {1 << 31}")
    points = spark.range(n_slots).select(F.col("id").alias("slot"), raw.alias("raw"))
    points = points.select("slot", (F.pmod(F.col("raw"), F.lit(ONE)).cast("double") / float(ONE)).alias("point")).withColumn("cell", F.floor(F.col("point") * cells))
    spans = sources.where("high > low").withColumn("cell", F.explode(F.sequence(F.floor(F.col("low") * cells), F.least(F.lit(cells - 1).cast("long"), F.floor(F.col("high") * cells)))))
    drawn = points.join(spans.select("cell", "low", "high", "sid", "source_size", "goal", "block_tokens", "blocks"), "cell").where("point >= low and point < high")
    drawn = drawn.select("slot", "sid", "source_size", "goal", "block_tokens", "blocks", F.expr("slot div 4096").alias("chunk"))
    counts = drawn.groupBy("sid", "chunk").agg(F.count("*").alias("n"))
    counts = counts.withColumn("base", F.coalesce(F.sum("n").over(Window.partitionBy("sid").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    ranked = drawn.withColumn("inner", F.row_number().over(Window.partitionBy("sid", "chunk").orderBy("slot")) - 1).join(counts, ["sid", "chunk"]).withColumn("rank", F.col("base") + F.col("inner"))
    # what the points leave short, after the last of them
    short = sources.join(drawn.groupBy("sid").agg(F.count("*").alias("have")), "sid", "left").withColumn("have", F.coalesce("have", F.lit(0))).where("have < need")
    short = short.withColumn("after", n_slots + F.coalesce(F.sum(F.col("need") - F.col("have")).over(up_to.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    short = short.withColumn("rank", F.explode(F.expr("sequence(have, need - 1)"))).withColumn("slot", F.expr("after + rank - have"))
    own = ["slot", "sid", "source_size", "goal", "block_tokens", "blocks", "rank"]
    ranked = ranked.select(*own).unionByName(short.select(*own))
    ranked = ranked.withColumn("block", F.expr("rank % blocks")).withColumn("done", F.expr("(rank div blocks) * source_size + least(block * block_tokens, source_size)"))
    ranked = ranked.withColumn("block_size", F.expr("least(block_tokens, source_size - block * block_tokens)")).withColumn("take", F.expr("least(block_size, goal - done)")).where("take > 0")
    return {"sources": sources, "pieces": pieces, "slots": ranked.select("slot", "sid", "rank", "block", "block_size", "take")}
