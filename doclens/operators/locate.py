"""Where things are in documents: lines as blocks, headings above, quotes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.functions.text import collapse, occurrences, occurrences_before, utf16_len
from doclens.operators.lineage import cut

#: So many quotes of a document meet each of its blocks as they are; more go through postings of words.
FEW = 16
#: So many quotes that no block holds, at most, choose their documents by a broadcast.
RARE = 100_000


def lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A block per line: id, ord, line, start (UTF-16 units before it)."""
    each = docs.select(id_col, F.posexplode(F.split(text_col, "\n")).alias("ord", "line"))
    before = F.sum(utf16_len(F.col("line")) + 1).over(Window.partitionBy(id_col).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    return each.withColumn("start", F.coalesce(before, F.lit(0)))


def heading_above(blocks: DataFrame, is_heading: Column, key: str = "doc_id", order: str = "ord", text: str = "line") -> DataFrame:
    """blocks with the nearest heading strictly above: a backward as-of lookup."""
    above = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return blocks.withColumn("heading", F.last(F.when(is_heading, F.col(text)), ignorenulls=True).over(above))


def original_at(line: Column, at: Column) -> Column:
    """Where a place in the collapsed and trimmed text of a line lies in the line itself, both in characters.

    White space before the place has as many blanks as the collapsed text; each took one character for as many as it has.
    """
    lead = F.length(F.regexp_extract(line, r"^\s*", 0))
    gaps = F.transform(F.regexp_extract_all(F.regexp_replace(line, r"^\s+", ""), F.lit(r"\s+"), 0), lambda x: F.length(x) - 1)
    plain = F.trim(collapse(line))
    blanks = F.length(F.left(plain, at)) - F.length(F.replace(F.left(plain, at), F.lit(" "), F.lit("")))
    return lead + at + F.aggregate(F.slice(gaps, F.lit(1), blanks), F.lit(0), lambda acc, x: acc + x)


def utf16_at(line: Column, at: Column) -> Column:
    return utf16_len(F.left(line, at))


def nth_place(text: Column, needle: Column, n: Column) -> Column:
    """0-based place of the occurrence behind the first n ones, which do not overlap; it must be there."""
    before = F.aggregate(F.sequence(F.lit(1), n + 1), F.lit(0), lambda acc, k: acc + F.length(F.split_part(text, needle, k)))
    return before + n * F.length(needle)


def candidates(asked: DataFrame, plain: DataFrame, key: str) -> DataFrame:
    """Pairs of quotes and blocks that may hold them, for documents of many quotes.

    A quote of three words or more holds its inner words whole: it meets the blocks that have the longest of these, as a
    rule its rarest, through postings of words. Others meet every block of their document.
    """
    inner = F.slice(F.split("needle", " "), F.lit(2), F.greatest(F.size(F.split("needle", " ")) - 2, F.lit(0)))
    longest = F.array_max(F.transform(inner, lambda w: F.struct(F.length(w).alias("n"), w.alias("w"))))["w"]
    worded = asked.withColumn("word", longest)
    postings = plain.join(worded.where("word is not null").select(key).distinct(), key, "left_semi").select(key, "ord", F.explode(F.array_distinct(F.split("line", " "))).alias("word"))
    by_word = worded.where("word is not null").join(postings, [key, "word"]).drop("word").join(plain, [key, "ord"])
    return by_word.unionByName(worded.where("word is null").drop("word").join(plain, key))


def locate_quotes(blocks: DataFrame, quotes: DataFrame, key: str = "doc_id") -> DataFrame:
    """The block that holds each quote, else the first run of blocks that does.

    blocks: key, ord, line, and heading where it is known. quotes: key, quote_id, quote, and skip (how many occurrences
    of it come before, none by default). White space counts as one blank, at both ends as none; occurrences of a block do
    not overlap. A quote with a skip that is not there so often is not found; one without that no block holds may run
    over several.

    -> key, quote_id, first_ord, last_ord, at (0-based, in the collapsed text of the first block), mark_start and mark_end
    (UTF-16 units in the first block's line, and in the last one's, exclusive), heading (of the first block).
    Empty quotes are not found; a null skip is none.
    """
    skip = F.coalesce(F.col("skip").cast("int"), F.lit(0)) if "skip" in quotes.columns else F.lit(0)
    heading = F.col("heading") if "heading" in blocks.columns else F.lit(None).cast("string")
    asked = quotes.select(key, "quote_id", F.trim(collapse(F.col("quote"))).alias("needle"), skip.alias("skip")).where("needle <> ''")
    asked = cut(asked.withColumn("_asked", F.count("*").over(Window.partitionBy(key))))
    given = blocks.select(key, "ord", F.col("line").alias("raw"), heading.alias("heading"))
    line = F.trim(collapse(F.col("raw")))
    # texts are dealt by key once, as they are
    few = asked.where(F.col("_asked") <= FEW).groupBy(key).agg(F.collect_list(F.struct("quote_id", "needle", "skip")).alias("asks"))
    met = given.join(few, key).withColumn("line", line)
    held = met.select(key, "ord", "line", "raw", "heading", F.explode(F.filter("asks", lambda x: F.contains(F.col("line"), x["needle"]))).alias("x")).select(key, "ord", "line", "raw", "heading", "x.*")
    many = asked.where(F.col("_asked") > FEW).drop("_asked")
    if not many.isEmpty():
        held = held.unionByName(candidates(many, given.withColumn("line", line), key).where(F.contains("line", F.col("needle"))))
    held = held.withColumn("n", occurrences(F.col("line"), F.col("needle")))
    # how many the blocks before hold
    before = F.coalesce(F.sum("n").over(Window.partitionBy(key, "quote_id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("int")
    turn = (F.col("skip") - F.col("before")).cast("int")
    chosen = held.withColumn("before", before).where((F.col("before") <= F.col("skip")) & (turn < F.col("n"))).withColumn("at", nth_place(F.col("line"), F.col("needle"), turn))
    start = utf16_at(F.col("raw"), original_at(F.col("raw"), F.col("at")))
    end = lambda c: utf16_at(F.col("raw"), original_at(F.col("raw"), c - 1) + 1)
    single = chosen.select(key, "quote_id", F.col("ord").alias("first_ord"), F.col("ord").alias("last_ord"), "at", start.alias("mark_start"), end(F.col("at") + F.length("needle")).alias("mark_end"), "heading")
    single = cut(single)
    # what no block holds is searched once in all blocks joined by a blank; a quote without a skip that a block holds is chosen
    rest = asked.where("skip = 0").drop("skip", "_asked").join(single.select(key, "quote_id"), [key, "quote_id"], "left_anti")
    size = rest.count()
    if not size:
        return single
    documents = rest.select(key).distinct()
    wanted = given.join(F.broadcast(documents) if size <= RARE else documents, key, "left_semi").withColumn("line", line).where("line <> ''")
    room = F.sum(F.length("line") + 1).over(Window.partitionBy(key).orderBy("ord").rowsBetween(Window.unboundedPreceding, -1))
    placed = wanted.withColumn("from", F.coalesce(room, F.lit(0)).cast("int"))
    joined = placed.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("ord", "from", "line", "raw", "heading"))).alias("rows")).withColumn("all", F.array_join(F.transform("rows", lambda x: x["line"]), " "))
    hits = rest.join(joined, key).withColumn("found", F.expr("locate(needle, all) - 1")).where("found >= 0").withColumn("stop", F.col("found") + F.length("needle"))
    over = F.filter("rows", lambda x: (x["from"] < F.col("stop")) & (F.col("found") < x["from"] + F.length(x["line"])))
    spanned = hits.select(key, "quote_id", "found", "stop", F.explode(over).alias("x")).select(key, "quote_id", "found", "stop", "x.*")
    each = spanned.withColumn("at", F.col("found") - F.col("from")).withColumn("_first", F.when(F.col("at") >= 0, start)).withColumn("_last", end(F.least(F.col("stop") - F.col("from"), F.length("line"))))
    spans = each.groupBy(key, "quote_id").agg(F.min("ord").alias("first_ord"), F.max("ord").alias("last_ord"), F.min_by("at", "ord").alias("at"), F.min_by("_first", "ord").alias("mark_start"), F.max_by("_last", "ord").alias("mark_end"), F.min_by("heading", "ord").alias("heading"))
    return single.unionByName(spans)


def quote_occurrence(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, skip: how often the quote starts before `at` in the text; (key, text, quote, at)."""
    return texts.select(key, occurrences_before(F.col("text"), F.col("quote"), F.col("at")).alias("skip"))
