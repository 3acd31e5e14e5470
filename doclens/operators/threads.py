"""Discussion threads: assembly, order, placement by anchor or quote, suggestions, their rendering as sidecars."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.text import decode_entities, minute, quoted, utf16_len, utf16_slice
from doclens.operators.intervals import BLOCK_CELL, TEXT_CELL, overlaps


def open_entries(comments: DataFrame) -> DataFrame:
    """Comments that count: neither resolved, deleted nor empty; texts trimmed, unnamed authors called Someone."""
    live = comments.where(~F.coalesce("resolved", F.lit(False)) & ~F.coalesce("deleted", F.lit(False)) & (F.trim("text") != ""))
    return live.withColumn("text", F.trim("text")).withColumn("author", F.when(F.coalesce("author", F.lit("")) == "", "Someone").otherwise(F.col("author")))


def assemble(comments: DataFrame, key: str = "thread_id", time: str = "time", order: str = "ord") -> DataFrame:
    """A thread per key: created, and entries (time, ord, author, text) by time, of ties in their order."""
    entry = F.struct(F.col(time).alias("time"), F.col(order).alias("ord"), "author", "text")
    return comments.groupBy(key).agg(F.sort_array(F.collect_list(entry)).alias("entries"), F.min_by(F.col(time), F.col(order)).alias("created"))


def thread_order() -> list[Column]:
    """By place, then place within, creation, id; threads without a place last."""
    return [F.col("offset").asc_nulls_last(), F.coalesce("within", F.lit(-1)), F.col("created"), F.col("id")]


def section(id_: Column, kind: Column, quote: Column, offset: Column, heading: Column, entries: Column) -> Column:
    """One thread as its lines of text."""
    place = F.when(offset.isNull(), "in: (not found)").otherwise(F.concat(F.lit("in: "), F.coalesce(heading, F.lit("(top)"))))
    head = F.concat(F.lit("## "), id_, F.lit(" — "), kind, F.lit("\n\n"))
    said = F.transform(entries, lambda e: F.concat(F.lit("**"), e["author"], F.lit("** · "), minute(e["time"]), F.lit("\n"), e["text"], F.lit("\n\n")))
    return F.concat(head, F.coalesce(F.concat(quoted(quote), F.lit("\n\n")), F.lit("")), place, F.lit("\n\n"), F.array_join(said, ""))


def sidecars(threads: DataFrame, document: str, fetched: str) -> DataFrame:
    """A text per document from its threads (offset, within, created, id, and the columns of section())."""
    rank = F.row_number().over(Window.partitionBy(document).orderBy(*thread_order()))
    text = section(*(F.col(x) for x in ("id", "kind", "quote", "offset", "heading", "entries")))
    parts = threads.select(document, rank.alias("_rank"), text.alias("_text")).groupBy(document).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "_text"))), lambda x: x["_text"]), "").alias("_all"))
    head = F.concat(F.lit("---\ndocument: "), F.col(document).cast("string"), F.lit(f"\nfetched: {fetched}\n---\n\n"))
    return parts.select(document, F.concat(head, F.regexp_replace("_all", "\n\n$", "\n")).alias("text"))


def anchored_text(anchors: DataFrame, runs: DataFrame, width: int = TEXT_CELL) -> DataFrame:
    """The text that an anchor's ranges cover and where it starts: an overlap join over cells of `width` units.

    anchors: doc_id, anchor_id, start, end. runs: doc_id, start, end, at, text. All offsets are UTF-16 units; ranges and
    runs without length cover nothing.
    """
    placed = runs.select("doc_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"), F.col("at").alias("run_at"), "text")
    met = overlaps(anchors.select("doc_id", "anchor_id", "start", "end"), placed, ["doc_id"], width)
    low = F.greatest("start", "run_start") - F.col("run_start")
    high = F.least("end", "run_end") - F.col("run_start")
    piece = met.select("doc_id", "anchor_id", F.col("start").alias("from"), F.col("run_start").alias("run"), (F.col("run_at") + low).alias("at"), utf16_slice(F.col("text"), low.cast("int"), high.cast("int")).alias("text"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("from", "run", "text"))), lambda x: x["text"]), "")
    return piece.groupBy("doc_id", "anchor_id").agg(joined.alias("quote"), F.min_by("at", F.struct("from", "run")).alias("at")).where(F.trim("quote") != "")


def text_offsets(runs: DataFrame) -> DataFrame:
    """runs (doc_id, ord, text) with `at`: UTF-16 units before it in its document."""
    before = F.sum(utf16_len(F.col("text"))).over(Window.partitionBy("doc_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("at", F.coalesce(before, F.lit(0)))


def suggestion_spans(blocks: DataFrame, width: int = BLOCK_CELL) -> DataFrame:
    """Per suggestion the blocks from the first to the last it touches, in the order of first appearance; spans and blocks
    meet over cells of `width` blocks.

    blocks: doc_id, ord, before, ids (array of struct(id, within, after)).
    """
    touched = blocks.select("doc_id", "ord", F.explode("ids").alias("x")).select("doc_id", "ord", F.col("x.id").alias("id"), F.col("x.within").alias("within"), F.col("x.after").alias("after"))
    spans = touched.groupBy("doc_id", "id").agg(F.min("ord").alias("first"), F.max("ord").alias("last"), F.min_by("within", "ord").alias("within"))
    long = lambda c: F.col(c).cast("long")
    ranges = spans.withColumn("_lo", long("first")).withColumn("_hi", long("last") + 1)
    places = blocks.select("doc_id", "ord", "before", long("ord").alias("_at"), (long("ord") + 1).alias("_next"))
    inside = overlaps(ranges, places, ["doc_id"], width, ("_lo", "_hi"), ("_at", "_next"))
    texts = inside.join(touched.select("doc_id", "id", "ord", "after"), ["doc_id", "id", "ord"], "left")
    return texts.select("doc_id", "id", "within", "ord", "before", F.coalesce("after", "before").alias("after"))


def accepted_text(runs: Column, suggestion: Column) -> Column:
    """A block's text with one suggestion accepted; other insertions stay out. runs: text, insertions, deletions."""
    kept = F.filter(runs, lambda r: ((F.coalesce(F.size(r["insertions"]), F.lit(0)) <= 0) | F.array_contains(r["insertions"], suggestion)) & ~F.coalesce(F.array_contains(r["deletions"], suggestion), F.lit(False)))
    return F.regexp_replace(F.replace(F.array_join(F.transform(kept, lambda r: r["text"]), ""), F.lit("\x0b"), F.lit("\n")), "\n\\z", "")


def place_by_quote(threads: DataFrame, tabs: DataFrame) -> DataFrame:
    """threads (doc_id, id, quote) with the first tab whose body holds the quote, else tab 0.

    tabs: doc_id, tab_ord, body. Quotes are decoded and trimmed; an empty quote goes to tab 0.
    """
    asked = threads.withColumn("quote", F.trim(decode_entities(F.coalesce("quote", F.lit("")))))
    held = asked.join(tabs, "doc_id").where(F.contains("body", F.col("quote")) & (F.col("quote") != ""))
    first = held.groupBy("doc_id", "id").agg(F.min("tab_ord").alias("tab_ord"))
    return asked.join(first, ["doc_id", "id"], "left").withColumn("found", F.col("tab_ord").isNotNull()).withColumn("tab_ord", F.coalesce("tab_ord", F.lit(0)))


def place_threads(threads: DataFrame, tabs: DataFrame) -> DataFrame:
    """threads (doc_id, id, quote, anchor_tab) with their tab: the anchor's where the document has it, else by quote."""
    placed = place_by_quote(threads, tabs)
    own = tabs.select("doc_id", F.col("tab_ord").alias("anchor_tab"), F.lit(True).alias("_has")).distinct()
    met = placed.join(own, ["doc_id", "anchor_tab"], "left")
    by_anchor = F.coalesce("_has", F.lit(False))
    return met.withColumn("tab_ord", F.when(by_anchor, F.col("anchor_tab")).otherwise(F.col("tab_ord"))).withColumn("found", F.col("found") | by_anchor).drop("_has")


def is_suggested_paragraph(runs: Column) -> Column:
    """A paragraph that is there by suggestion only: it has runs, all of text, each inserted. runs: kind, insertions."""
    return (F.size(runs) > 0) & F.forall(runs, lambda r: (r["kind"] == "text") & (F.coalesce(F.size(r["insertions"]), F.lit(0)) > 0))


def with_discussion(suggestions: DataFrame, discussions: DataFrame) -> DataFrame:
    """Suggestions with what was said about them, where anything was."""
    return suggestions.join(discussions, "id", "left")


def hunks(texts: DataFrame, key: str = "key") -> DataFrame:
    """key, lines: two equally long lists (before, after) rendered: unchanged texts once, a run of changes as its old, then
    its new side; a text's lines each get the sign, an empty text has none."""
    each = texts.select(key, F.posexplode(F.arrays_zip(F.col("before").alias("old"), F.col("after").alias("new"))).alias("at", "x")).select(key, "at", "x.old", "x.new")
    order = Window.partitionBy(key).orderBy("at")
    same = F.col("old").eqNullSafe(F.col("new"))
    starts = (same | F.coalesce(F.lag(same).over(order), F.lit(True))).cast("int")
    placed = each.withColumn("_starts", starts).withColumn("run", F.sum("_starts").over(order))
    side = lambda n, sign, text: F.struct("run", F.lit(n).alias("side"), "at", F.lit(sign).alias("sign"), F.col(text).alias("text"))
    sides = F.when(same, F.array(side(0, " ", "old"))).otherwise(F.array(side(0, "-", "old"), side(1, "+", "new")))
    kept = placed.select(key, F.explode(sides).alias("s")).where(F.col("s.text") != "")
    lines = F.transform(F.sort_array(F.collect_list("s")), lambda s: F.transform(F.split(s["text"], "\n"), lambda x: F.concat(s["sign"], F.lit(" "), x)))
    made = kept.groupBy(key).agg(F.flatten(lines).alias("lines"))
    return texts.select(key).join(made, key, "left").withColumn("lines", F.coalesce("lines", F.array().cast("array<string>")))
