"""Interval joins over a grid against all pairs, one long document over many tasks, quotes against a search block by block."""

import random
import re

from pyspark.sql import functions as F

from doclens.operators import intervals, locate, runs, threads


def spans(rng, n, most, long):
    return [(rng.randrange(4), s, s + rng.choice([0, 1, 2, 5, long])) for s in (rng.randrange(most) for _ in range(n))]


def test_overlaps_are_those_of_all_pairs(spark):
    rng = random.Random(3)
    a, b = spans(rng, 80, 100, 60), spans(rng, 80, 100, 40)
    left = spark.createDataFrame([(k, n, s, e) for n, (k, s, e) in enumerate(a)], "key int, a int, start int, end int")
    right = spark.createDataFrame([(k, n, s, e) for n, (k, s, e) in enumerate(b)], "key int, b int, run_start int, run_end int")
    expected = sorted((i, j) for i, (k, s, e) in enumerate(a) for j, (q, x, y) in enumerate(b) if k == q and s < e and x < y and s < y and x < e)
    for width in (1, 7, 1000):
        assert sorted((r["a"], r["b"]) for r in intervals.overlaps(left, right, ["key"], width).collect()) == expected


def test_subtraction_is_that_of_points(spark):
    rng = random.Random(4)
    ranges, gaps = spans(rng, 25, 60, 45), spans(rng, 30, 70, 20)
    expected = set()
    for k, s, e in set(ranges):
        free = [i for i in range(s, e) if not any(q == k and x <= i < y for q, x, y in gaps)]
        expected |= {(k, s, e, i) for i in free}
    side = lambda rows: spark.createDataFrame(rows, "key int, start long, end long")
    for width in (1, 4, 16, 4096):
        found = runs.subtract_intervals(side(ranges), side(gaps), width=width).collect()
        # parts are as long as they can be: none ends where another of its range begins
        whole = {(k, s, e) for k, s, e in set(ranges) if s < e}
        parts = {}
        for r in found:
            parts.setdefault(r["key"], []).append((r["start"], r["end"]))
        wanted = []
        for k, s, e in whole:
            free = sorted(i for q, x, y, i in expected if (q, x, y) == (k, s, e))
            for n, i in enumerate(free):
                if n == 0 or free[n - 1] != i - 1:
                    start = i
                if n + 1 == len(free) or free[n + 1] != i + 1:
                    wanted.append((k, start, i + 1))
        assert sorted((k, *p) for k, own in parts.items() for p in own) == sorted(wanted)


def test_one_long_document_is_many_tasks(spark):
    """A million units of runs, and gaps, of one document; the joins give each task a share of its cells."""
    n = 200_000
    made = spark.range(n).select(F.lit(1).alias("doc_id"), (F.col("id") * 5).alias("start"), (F.col("id") * 5 + 5).alias("end"), (F.col("id") * 5).alias("at"), F.lit("words").alias("text"))
    anchors = spark.range(0, n * 5, 97).select(F.lit(1).alias("doc_id"), F.col("id").cast("string").alias("anchor_id"), F.col("id").alias("start"), (F.col("id") + 20).alias("end")).where(f"end <= {n * 5}")
    held = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = made.select("doc_id", F.col("start").alias("run_start"), F.col("end").alias("run_end"))
        met = intervals.overlaps(anchors, placed, ["doc_id"], intervals.TEXT_CELL)
        shares = [r["count"] for r in met.groupBy(F.spark_partition_id()).count().collect()]
        assert len(shares) == int(spark.conf.get("spark.sql.shuffle.partitions")) and max(shares) < sum(shares) / 2
        quotes = threads.anchored_text(anchors, made)
        assert quotes.count() == anchors.count() and quotes.where("length(quote) <> 20").count() == 0
        gaps = made.where("start % 25 = 0").select(F.col("doc_id").alias("key"), "start", "end")
        rest = runs.subtract_intervals(spark.createDataFrame([(1, 0, n * 5)], "key int, start long, end long"), gaps)
        assert rest.where("end - start = 20 and start % 25 = 5").count() == rest.count() == n // 5
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", held)


# ---------------------------------------------------------------- quotes


def collapsed(text):
    """A text with single blanks, and where each character was."""
    out = [(m.start(), " " if m[0].isspace() else m[0]) for m in re.finditer(r"\s+|\S", text)]
    while out and out[0][1] == " ":
        out.pop(0)
    while out and out[-1][1] == " ":
        out.pop()
    return "".join(c for _, c in out), [i for i, _ in out]


def units(text):
    return len(text.encode("utf-16-le")) // 2


def searched(lines, quote, skip):
    needle, left = collapsed(quote)[0], skip
    if not needle:
        return None
    for n, line in enumerate(lines):
        plain, at = collapsed(line)
        places, start = [], plain.find(needle)
        while start >= 0:
            places.append(start)
            start = plain.find(needle, start + len(needle))
        if left < len(places):
            p = places[left]
            return n, n, p, units(line[: at[p]]), units(line[: at[p + len(needle) - 1] + 1])
        left -= len(places)
    if skip:
        return None
    whole = [(n, k, c) for n, line in enumerate(lines) for k, c in enumerate(" " + collapsed(line)[0]) if collapsed(line)[0]][1:]
    found = "".join(c for *_, c in whole).find(needle)
    if found < 0:
        return None
    (a, i, _), (b, j, _) = whole[found], whole[found + len(needle) - 1]
    return a, b, i - 1, units(lines[a][: collapsed(lines[a])[1][i - 1]]), units(lines[b][: collapsed(lines[b])[1][j - 1] + 1])


def test_quotes_as_block_by_block(spark):
    rng = random.Random(8)
    words = ["a", "aa", "ab", "b", "💡", "word", "aaa"]
    text = lambda n: "".join(rng.choice(words) + rng.choice([" ", "  ", "\t ", ""]) for _ in range(rng.randrange(n)))
    docs = {d: [rng.choice(["", " "]) + text(9) for _ in range(rng.randrange(1, 7))] for d in range(120)}
    asked = []
    for d, lines in docs.items():
        whole = " ".join(lines)
        for q in range(6):
            start = rng.randrange(max(1, len(whole)))
            asked.append((d, q, whole[start : start + rng.choice([1, 2, 4, 9, 15])] if q else rng.choice(["", " ", "nowhere", "aa"]), rng.choice([None, 0, 0, 1, 2])))
    blocks = spark.createDataFrame([(d, n, line, f"h{d}-{n}") for d, lines in docs.items() for n, line in enumerate(lines)], "doc_id int, ord int, line string, heading string")
    found = locate.locate_quotes(blocks, spark.createDataFrame(asked, "doc_id int, quote_id int, quote string, skip int")).collect()
    assert len({(r["doc_id"], r["quote_id"]) for r in found}) == len(found)
    own = {(r["doc_id"], r["quote_id"]): (r["first_ord"], r["last_ord"], r["at"], r["mark_start"], r["mark_end"]) for r in found}
    assert all(r["heading"] == f"h{r['doc_id']}-{r['first_ord']}" for r in found)
    expected = {(d, q): searched(docs[d], quote, skip or 0) for d, q, quote, skip in asked}
    assert own == {k: v for k, v in expected.items() if v is not None}
    assert any(v[0] < v[1] for v in own.values())


def test_documents_of_few_and_of_many_quotes(spark):
    """quotes meet the blocks of their document without postings of all words, unless a document has many of them."""
    rng = random.Random(9)
    docs = {d: [" ".join(rng.choice("ab cd efg h ij".split()) for _ in range(rng.randrange(9))) for _ in range(6)] for d in range(8)}
    asked = [(d, q, " ".join(rng.choice("ab cd efg h ij".split()) for _ in range(rng.randrange(1, 6))), rng.choice([None, 0, 1])) for d in docs for q in range(locate.FEW * 2 if d % 2 else locate.FEW)]
    blocks = spark.createDataFrame([(d, n, line) for d, lines in docs.items() for n, line in enumerate(lines)], "doc_id int, ord int, line string")
    schema, key = "doc_id int, quote_id int, quote string, skip int", ("doc_id", "quote_id", "first_ord", "last_ord", "at", "mark_start", "mark_end")
    met = locate.locate_quotes(blocks, spark.createDataFrame(asked, schema))
    expected = {(d, q): searched(docs[d], quote, skip or 0) for d, q, quote, skip in asked}
    assert sorted(tuple(r[c] for c in key) for r in met.collect()) == sorted((*k, *v) for k, v in expected.items() if v is not None)
    few = locate.locate_quotes(blocks, spark.createDataFrame([x for x in asked if x[0] % 2 == 0], schema))
    assert "array_distinct" not in few._jdf.queryExecution().optimizedPlan().toString()
