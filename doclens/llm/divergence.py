"""Divergence of the sources of each language, by a baseline-corrected inverted index.

A language keeps the terms that at least `least_docs` of its documents hold. A group is a (language, source); its share
p of a kept term is 1 + floor(SCALE * (count + 2) / (N + 2 V)), and two shares differ by f = floor((p - q)^2 / (p + q)).
The value of two groups is the sum of f over all V kept terms. Nearly all terms are missing in nearly all groups, so:

- each pair of groups starts at V times f of the two shares of a count of zero;
- the postings of the index (term, group, count) emit corrections to that, where a count is not zero: one for each
  group that has the term against the zero share of each other group, and one more where two groups have it. The first
  kind depends on the share alone, so a group's terms of equal share are one row with their number.

Every step is exact in whole numbers. Ranks come from windows over what is reported only.

Terms are counted in tasks, with tables that are emptied beyond `flush` entries, so that neither a task nor the shuffle
holds more than partial counts. A term that every document has is one row per task and group.

Defined results: null text, lang and source are ''; a group without terms, or of a language without kept terms (V = 0),
has value 0 against every other source; repeated rows and rows without an id count like any other; empty tables give no
rows; columns that are not asked for are not read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from doclens.llm.common import CHUNK, Scratch, bound_batches, lean, quoted

SCALE = 1_000_000_000
#: Groups up to which their totals are sent to every task; beyond, they are joined.
BROADCAST_GROUPS = 100_000
#: Every byte that no term holds becomes a blank, A-Z becomes lower case.
TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str) -> Iterator[list[bytes]]:
    """Terms `[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+`, A-Z lower-cased, of about CHUNK bytes at a time."""
    data, at = text.encode().translate(TERMS), 0
    while at < len(data):
        end = data.find(b" ", at + CHUNK) if len(data) - at > CHUNK else -1
        end = len(data) if end < 0 else end
        yield data[at:end].split()
        at = end


COUNTED = "lang string, source string, term string, n long, docs long"


def count_terms(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", flush: int = 100_000) -> DataFrame:
    """Partial counts lang, source, term, n, docs: occurrences, and documents of the group that hold the term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counted: dict[tuple[str, str], tuple[Counter, Counter]] = {}
        held = 0

        def told():
            for (lang, source), (n, docs) in counted.items():
                if n:
                    m = len(n)
                    yield pa.record_batch({"lang": pa.array([lang] * m, pa.string()), "source": pa.array([source] * m, pa.string()), "term": pa.array(list(n), pa.binary()).cast(pa.string()), "n": pa.array(list(n.values()), pa.int64()), "docs": pa.array([docs[t] for t in n], pa.int64())})
            counted.clear()

        for batch in batches:
            for lang, source, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                n, docs = counted.setdefault((lang, source), (Counter(), Counter()))
                before, own = len(n), set()
                for found in terms_of(text):
                    n.update(found)
                    own.update(found)
                docs.update(own)
                held += len(n) - before
                if held > flush:
                    yield from told()
                    held = 0
        yield from told()

    bound_batches(docs.sparkSession)
    text = lambda c: F.coalesce(F.col(quoted(c)), F.lit(""))
    return docs.select(text(lang_col).alias("lang"), text(source_col).alias("source"), text(text_col).alias("text")).mapInArrow(lean(run), COUNTED)


def share(count: Column, n: Column, v: Column) -> Column:
    """1 + floor(SCALE * (count + 2) / (n + 2 v)); decimals, as the product passes 64 bits."""
    wide = lambda c: c.cast("decimal(19,0)")
    return F.call_function("div", (wide(count) + F.lit(2)).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)"), wide(n + 2 * v)) + 1


def apart(p: Column, q: Column) -> Column:
    """floor((p - q)^2 / (p + q))."""
    return F.call_function("div", (p - q) * (p - q), p + q)


def divergence(docs: DataFrame, lang_col: str = "lang", source_col: str = "source", text_col: str = "text", least_docs: int = 10, top: int = 10) -> DataFrame:
    """lang, source, part, item, value, rank: in part `pair` each other source of the language with the value of the two;
    in part `term` the `top` kept terms of which the group has more than its language, by f against the language."""
    scratch = Scratch(docs.sparkSession, "divergence")
    text = lambda c: F.coalesce(F.col(quoted(c)), F.lit(""))
    # one exchange by (lang, term) serves all counts: rows of a term are partial counts, a few for each task and group
    counted = count_terms(docs, lang_col, source_col, text_col).repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = Window.partitionBy("lang", "term")
    kept = counted.withColumn("all_docs", F.sum("docs").over(of_term)).where(F.col("all_docs") >= least_docs).withColumn("all_n", F.sum("n").over(of_term))
    postings = scratch.table(kept.select("lang", "term", "source", "n", "all_n"), "postings")
    n_of = postings.groupBy("lang", "source").agg(F.sum("n").alias("n"))
    v_of = postings.groupBy("lang", "term").agg(F.max("all_n").alias("n")).groupBy("lang").agg(F.count("*").alias("v"), F.sum("n").alias("lang_n"))
    named = docs.select(text(lang_col).alias("lang"), text(source_col).alias("source")).distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    totals = named.join(n_of, ["lang", "source"], "left").join(v_of, "lang", "left").select("lang", "source", zero("n"), zero("v"), zero("lang_n"))
    # p0: the share of a count of zero; it is of no use where nothing is kept
    groups = scratch.table(totals.withColumn("p0", F.when(F.col("v") > 0, share(F.lit(0), F.col("n"), F.col("v")))), "groups")
    small = F.broadcast if groups.count() <= BROADCAST_GROUPS else (lambda df: df)
    sized = small(groups.select("lang", "source", F.col("n").alias("group_n"), "v", "lang_n", "p0"))
    # shares of the postings, in the group and in the language
    shared = postings.join(sized, ["lang", "source"])
    shared = shared.select("lang", "term", "source", "p0", share(F.col("n"), F.col("group_n"), F.col("v")).alias("p"), share(F.col("all_n"), F.col("lang_n"), F.col("v")).alias("lang_p"))
    shared = scratch.table(shared, "shares")
    return pair_part(shared, groups, small).unionByName(term_part(shared, top))


def pair_part(shared: DataFrame, groups: DataFrame, small) -> DataFrame:
    """The pairs of groups of each language: baseline, corrections of single postings, corrections of postings that meet."""
    one = groups.select("lang", F.col("source").alias("a"), F.col("p0").alias("a0"), "v")
    two = groups.select("lang", F.col("source").alias("b"), F.col("p0").alias("b0"))
    pairs = one.join(small(two), "lang").where("a <> b")
    base = apart(F.col("a0"), F.col("b0"))
    start = pairs.select("lang", "a", "b", F.coalesce(F.col("v") * base, F.lit(0).cast("long")).alias("value"))
    # a's terms of equal share are one row; both directions of a pair take these corrections
    alike = shared.groupBy("lang", F.col("source").alias("a"), "p", F.col("p0").alias("a0")).agg(F.count("*").alias("terms"))
    lone = alike.join(small(two), "lang").where("a <> b").groupBy("lang", "a", "b").agg(F.sum(F.col("terms") * (apart(F.col("p"), F.col("b0")) - base)).alias("value"))
    lone = lone.unionByName(lone.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    x = shared.select("lang", "term", F.col("source").alias("a"), F.col("p").alias("pa"), F.col("p0").alias("a0"))
    y = shared.select("lang", "term", F.col("source").alias("b"), F.col("p").alias("pb"), F.col("p0").alias("b0"))
    more = apart(F.col("pa"), F.col("pb")) - apart(F.col("pa"), F.col("b0")) - apart(F.col("a0"), F.col("pb")) + base
    met = x.join(y, ["lang", "term"]).where("a < b").groupBy("lang", "a", "b").agg(F.sum(more).alias("value"))
    met = met.unionByName(met.select("lang", F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    summed = start.unionByName(lone).unionByName(met).groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    rank = F.row_number().over(Window.partitionBy("lang", "a").orderBy(F.desc("value"), "b"))
    return summed.select("lang", F.col("a").alias("source"), F.lit("pair").alias("part"), F.col("b").alias("item"), "value", rank.alias("rank"))


def term_part(shared: DataFrame, top: int) -> DataFrame:
    """The first `top` terms of each group; tasks cut their own rows to as many before any are exchanged."""
    over = shared.where("p > lang_p").withColumn("value", apart(F.col("p"), F.col("lang_p")))
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(F.desc("value"), "term"))
    ranked = over.withColumn("rank", rank).where(F.col("rank") <= top)
    return ranked.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), "value", "rank")
