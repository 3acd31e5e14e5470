"""Differences between two versions of documents: token similarity, block and text diff, moves, counts."""

from __future__ import annotations

from collections import Counter
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from doclens.functions.text import utf16_len

#: Least similarity of an edited block, most cells of an alignment table, documents read at once in a task.
ALIKE, MOST_CELLS, SOME = 0.5, 4_000_000, 256
WORDS = regex.compile(r"(?V1w)\b")


def tokens(text: str) -> list[str]:
    """Words, blanks and marks of a text, in order; they join back to it. Dictionary scripts are cut at script bounds."""
    return [t for t in WORDS.split(text) if t]


def units(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-16-le")) // 2


def shares(text: str) -> tuple[int, dict[str, int]]:
    """Units of a text, and of each of its tokens, repeats counted."""
    size = len if text.isascii() else units
    return size(text), {t: n * size(t) for t, n in Counter(tokens(text)).items()}


def shared(a: tuple[int, dict[str, int]], b: tuple[int, dict[str, int]]) -> float:
    small, large = sorted((a[1], b[1]), key=len)
    return sum(min(n, large.get(t, 0)) for t, n in small.items()) / max(a[0], b[0])


def similarity(a: str, b: str) -> float:
    """Shared tokens by length over the longer text, 0 to 1."""
    return 1.0 if a == b else shared(shares(a), shares(b))


def token_similarity(pairs: DataFrame, split: str = r"(?<= )|(?= )") -> DataFrame:
    """key, score for (key, a, b): the same measure by built-ins over a simple tokenizer, as a multiset join."""
    both = pairs.select("key", F.explode(F.array(F.struct(F.lit(0).alias("side"), F.col("a").alias("t")), F.struct(F.lit(1).alias("side"), F.col("b").alias("t")))).alias("x"))
    each = both.select("key", "x.side", F.explode(F.split("x.t", split)).alias("token")).where("token <> ''")
    counts = each.groupBy("key", "token").agg(F.count_if(F.col("side") == 0).alias("na"), F.count_if(F.col("side") == 1).alias("nb"))
    shared = counts.where("na > 0 and nb > 0").groupBy("key").agg(F.sum(F.least("na", "nb") * utf16_len(F.col("token"))).alias("shared"))
    longer = F.greatest(utf16_len(F.col("a")), utf16_len(F.col("b")))
    return pairs.join(shared, "key", "left").select("key", F.when(F.col("a") == F.col("b"), 1.0).otherwise(F.coalesce(F.col("shared"), F.lit(0)) / longer).alias("score"))


def lcs_table(a: list, b: list) -> np.ndarray | None:
    """table[i, j]: longest common subsequence of a[i:] and b[j:]; None beyond the cell limit. Filled a row at a time."""
    if len(a) * len(b) > MOST_CELLS:
        return None
    names = {x: k for k, x in enumerate(dict.fromkeys([*a, *b]))}
    left, right = np.array([names[x] for x in a], np.int64), np.array([names[x] for x in b], np.int64)
    table = np.zeros((len(a) + 1, len(b) + 1), np.int32)
    for i in range(len(a) - 1, -1, -1):
        below = table[i + 1]
        # best without the row, or one more where it matches; then the best to the right
        row = np.maximum(below[:-1], np.where(right == left[i], below[1:] + 1, 0))
        table[i, :-1] = np.maximum.accumulate(row[::-1])[::-1]
    return table


def walk(a: list, b: list) -> list[tuple[str, int, int]]:
    """keep, delete and insert steps with positions; on a tie the deletion comes first."""
    if a == b:
        return [("keep", i, i) for i in range(len(a))]
    table, out, i, j = lcs_table(a, b) if a and b else None, [], 0, 0
    while i < len(a) or j < len(b):
        if i < len(a) and j < len(b) and a[i] == b[j]:
            out.append(("keep", i, j))
            i, j = i + 1, j + 1
        elif j >= len(b) or (i < len(a) and (table is None or table[i + 1, j] >= table[i, j + 1])):
            out.append(("delete", i, j))
            i += 1
        else:
            out.append(("insert", i, j))
            j += 1
    return out


def merge_spans(spans: list[tuple[str, str]]) -> list[tuple[str, str]]:
    out: list[tuple[str, str]] = []
    for kind, text in spans:
        if text and out and out[-1][0] == kind:
            out[-1] = (kind, out[-1][1] + text)
        elif text:
            out.append((kind, text))
    return out


def coalesce_edits(spans: list[tuple[str, str]], join_under: int | None = None) -> list[tuple[str, str]]:
    """Edits with only white space (or fewer than join_under words) kept between them become one delete and one insert."""
    bridge = [
        k == "keep" and (not t.strip() or (join_under is not None and len(t.split()) < join_under)) and 0 < n < len(spans) - 1 and spans[n - 1][0] != "keep" and spans[n + 1][0] != "keep"
        for n, (k, t) in enumerate(spans)
    ]
    out, old, new = [], "", ""
    for n, (kind, text) in enumerate(spans):
        if kind == "keep" and not bridge[n]:
            out += [("delete", old), ("insert", new), (kind, text)]
            old = new = ""
        else:
            old += text if kind != "insert" else ""
            new += text if kind != "delete" else ""
    return merge_spans([*out, ("delete", old), ("insert", new)])


def diff_text(a: str, b: str, join_under: int | None = None) -> list[tuple[str, str]]:
    """Spans (kind, text): common ends first, then the alignment of what is between."""
    x, y = tokens(a), tokens(b)
    head = next((n for n, (p, q) in enumerate(zip(x, y, strict=False)) if p != q), min(len(x), len(y)))
    room = min(len(x), len(y)) - head
    tail = next((n for n in range(room) if x[-1 - n] != y[-1 - n]), room)
    mx, my = x[head : len(x) - tail], y[head : len(y) - tail]
    if not mx or not my or len(mx) * len(my) > MOST_CELLS:
        middle = [*(("delete", t) for t in mx), *(("insert", t) for t in my)]
    else:
        middle = [(k, my[j] if k == "insert" else mx[i]) for k, i, j in walk(mx, my)]
    spans = [*(("keep", t) for t in x[:head]), *middle, *(("keep", t) for t in x[len(x) - tail :])]
    return coalesce_edits(merge_spans(spans), join_under)


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("text", StringType()), StructField("base", IntegerType()), StructField("next", IntegerType())]))


@F.pandas_udf(SPANS)
def text_diff(a: pd.Series, b: pd.Series) -> pd.Series:
    """Spans of two texts with their offsets, in UTF-16 units, in either."""

    def one(x, y):
        if x is None or y is None:
            return None
        base = nxt = 0
        out = []
        for kind, text in diff_text(x, y):
            out.append({"kind": kind, "text": text, "base": base, "next": nxt})
            base += units(text) if kind != "insert" else 0
            nxt += units(text) if kind != "delete" else 0
        return out

    return pd.Series([one(x, y) for x, y in zip(a, b, strict=True)])


def pair_hunk(removed: list[tuple[str, str]], inserted: list[tuple[str, str]]) -> dict[int, int]:
    """inserted position -> removed position of blocks (type, text) that are one block edited.

    Blocks meet through a token that both have, never by type alone; each text is cut into tokens once. Only one block on
    either side is one edited whatever its tokens are, if the type is the same.
    """
    if not removed or not inserted:
        return {}
    if len(removed) == len(inserted) == 1:
        return {0: 0} if removed[0][0] == inserted[0][0] else {}
    old, new = [shares(x) for _, x in removed], [shares(y) for _, y in inserted]
    holders: dict[tuple[str, str], list[int]] = {}
    for j, ((kind, _), (_, own)) in enumerate(zip(inserted, new, strict=True)):
        for t in own:
            holders.setdefault((kind, t), []).append(j)
    scored = []
    for i, ((kind, text), one) in enumerate(zip(removed, old, strict=True)):
        if not text:  # equals every empty block, and shares no token
            met = {j for j, (u, y) in enumerate(inserted) if u == kind and not y}
        else:
            # half of the longer text is shared, so some token outside any half of this text is; the rarest go first
            met, left = set(), one[0]
            for t in sorted(one[1], key=lambda t: len(holders.get((kind, t), ()))):  # noqa: B023
                if left < ALIKE * one[0]:
                    break
                met.update(holders.get((kind, t), ()))
                left -= one[1][t]
        for j in met:
            two = new[j]
            if min(one[0], two[0]) >= ALIKE * max(one[0], two[0]):
                s = 1.0 if text == inserted[j][1] else shared(one, two)
                if s >= ALIKE:
                    scored.append((-s, abs(i - j), i, j))
    pairs: dict[int, int] = {}
    taken: set[int] = set()
    for _, _, i, j in sorted(scored):
        if j not in pairs and i not in taken:
            pairs[j] = i
            taken.add(i)
    rest_i, rest_j = [i for i in range(len(removed)) if i not in taken], [j for j in range(len(inserted)) if j not in pairs]
    if len(rest_i) == len(rest_j) == 1 and removed[rest_i[0]][0] == inserted[rest_j[0]][0]:
        pairs[rest_j[0]] = rest_i[0]
    return pairs


def diff_level(base: list[tuple[str, str]], nxt: list[tuple[str, str]]) -> list[tuple[str, int | None, int | None]]:
    """Ops (op, base position, next position) over one level of blocks (type, text); moves are found."""
    ops: list[tuple[str, int | None, int | None]] = []
    removed: list[int] = []
    inserted: list[int] = []

    def flush() -> None:
        pairs = pair_hunk([base[i] for i in removed], [nxt[j] for j in inserted])
        stay = set(pairs.values())
        ops.extend(("delete", i, None) for n, i in enumerate(removed) if n not in stay)
        ops.extend(("update", removed[pairs[n]], j) if n in pairs else ("insert", None, j) for n, j in enumerate(inserted))
        removed.clear()
        inserted.clear()

    for kind, i, j in walk(base, nxt):
        if kind == "keep":
            flush()
            ops.append(("keep", i, j))
        else:
            (removed if kind == "delete" else inserted).append(i if kind == "delete" else j)
    flush()
    last = {base[i]: n for n, (op, i, _) in enumerate(ops) if op == "delete"}
    dropped = set()
    for n, (op, _, j) in enumerate(ops):
        if op == "insert" and nxt[j] in last:
            at = last.pop(nxt[j])
            dropped.add(at)
            ops[n] = ("move", ops[at][1], j)
    return [op for n, op in enumerate(ops) if n not in dropped]


OPS = "key long, op_ord long, op string, base_ord long, next_ord long, depth int"


def diff_tree(base: list[dict], nxt: list[dict]) -> list[tuple[str, int | None, int | None, int]]:
    """Ops (op, base ord, next ord, depth) over blocks (ord, parent, type, text), in document order.

    Levels are compared one by one: the children of blocks that stay or are edited follow them; what is inserted,
    deleted or moved takes its children along.
    """

    def children(blocks: list[dict]) -> dict[int | None, list[dict]]:
        out: dict[int | None, list[dict]] = {}
        for x in sorted(blocks, key=lambda x: x["ord"]):
            out.setdefault(x["parent"], []).append(x)
        return out

    def level(a: list[dict], b: list[dict]) -> list[tuple[str, dict | None, dict | None]]:
        ops = diff_level([(x["type"], x["text"]) for x in a], [(x["type"], x["text"]) for x in b])
        return [(op, None if i is None else a[i], None if j is None else b[j]) for op, i, j in ops]

    old, new, out = children(base), children(nxt), []
    waiting = [iter(level(old.get(None, []), new.get(None, [])))]
    while waiting:
        step = next(waiting[-1], None)
        if step is None:
            waiting.pop()
            continue
        op, x, y = step
        out.append((op, x and x["ord"], y and y["ord"], len(waiting) - 1))
        if op in ("keep", "update"):
            below = old.get(x["ord"], []), new.get(y["ord"], [])
            if any(below):
                waiting.append(iter(level(*below)))
    return out


def diff_documents(docs: DataFrame) -> DataFrame:
    """Ops of documents (key, base, next), the versions as arrays of blocks (ord, parent, type, text); where both come
    from one row, nothing is shuffled."""

    def blocks(column: pa.ListArray) -> list[list[dict]]:
        """The blocks of each row, field by field; a null has none."""
        rows, sizes = column.flatten(), column.value_lengths().fill_null(0).to_pylist()
        names = [rows.type.field(i).name for i in range(rows.type.num_fields)]
        every = (dict(zip(names, x, strict=True)) for x in zip(*(f.to_pylist() for f in rows.flatten()), strict=True))
        return [list(islice(every, n)) for n in sizes]

    def run(batches):
        for batch in (whole.slice(at, SOME) for whole in batches for at in range(0, whole.num_rows, SOME)):
            for key, base, nxt in zip(batch.column(0).to_pylist(), blocks(batch.column(1)), blocks(batch.column(2)), strict=True):
                ops = diff_tree(base, nxt)
                columns = list(zip(*ops, strict=True)) or [()] * 4
                kinds = (pa.string(), pa.int64(), pa.int64(), pa.int32())
                own = [pa.array([key] * len(ops), pa.int64()), pa.array(range(len(ops)), pa.int64()), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))]
                yield pa.RecordBatch.from_arrays(own, names=[x.split()[0] for x in OPS.split(", ")])

    return docs.select("key", "base", "next").mapInArrow(run, OPS)


def fresh(df: DataFrame) -> DataFrame:
    """The same columns under attributes of their own: cogrouped sides may come from one table."""
    return df.select(*(F.col(c).alias(c) for c in df.columns))


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys over as many tasks as the session shuffles into; adaptive execution does not merge them, as the
    work of a row is much more than its bytes tell."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def block_diff(base: DataFrame, nxt: DataFrame) -> DataFrame:
    """Ops of two versions of blocks as rows (key, ord, type, text, and parent where they are nested)."""

    def gathered(rows: DataFrame, name: str) -> DataFrame:
        parent = F.col("parent").cast("int") if "parent" in rows.columns else F.lit(None).cast("int")
        block = F.struct(F.col("ord").cast("int").alias("ord"), parent.alias("parent"), "type", "text")
        return spread(rows, "key").groupBy("key").agg(F.collect_list(block).alias(name))

    both = gathered(fresh(base), "base").join(gathered(fresh(nxt), "next"), "key", "full_outer")
    return diff_documents(both)


def op_counts(ops: DataFrame, key: str = "key") -> DataFrame:
    """kept, updated, inserted, deleted per document; a move counts as inserted and deleted."""
    n = lambda *kinds: F.count_if(F.col("op").isin(*kinds))
    return ops.groupBy(key).agg(n("keep").alias("kept"), n("update").alias("updated"), n("insert", "move").alias("inserted"), n("delete", "move").alias("deleted"))


def moved_blocks(deleted: DataFrame, inserted: DataFrame, keys: list[str]) -> DataFrame:
    """keys, from_ord, to_ord: the last deletion and the first insertion of the same block."""
    return deleted.groupBy(*keys).agg(F.max("ord").alias("from_ord")).join(inserted.groupBy(*keys).agg(F.min("ord").alias("to_ord")), keys)


def coalesce_spans(spans: DataFrame, key: str = "key") -> DataFrame:
    """The same joining of edits by windows, for spans as rows (key, ord, kind, text): key, island, deleted, inserted, kept."""
    w = Window.partitionBy(key).orderBy("ord")
    edit = F.col("kind") != "keep"
    bridge = ~edit & (F.trim("text") == "") & (F.lag("kind").over(w) != "keep") & (F.lead("kind").over(w) != "keep")
    flagged = spans.withColumn("_in", edit | F.coalesce(bridge, F.lit(False)))
    marked = flagged.withColumn("_new", (~F.col("_in") | ~F.coalesce(F.lag("_in").over(w), F.lit(False))).cast("int"))
    grouped = marked.withColumn("island", F.sum("_new").over(w))
    side = lambda cond: F.array_join(F.transform(F.sort_array(F.collect_list(F.when(cond, F.struct("ord", "text")))), lambda x: x["text"]), "")
    return grouped.groupBy(key, "island").agg(side(F.col("_in") & (F.col("kind") != "insert")).alias("deleted"), side(F.col("_in") & (F.col("kind") != "delete")).alias("inserted"), side(~F.col("_in")).alias("kept"))


def style_changes(base: Column, nxt: Column, keys: list[str]) -> Column:
    """Map of the style keys whose values differ, with the new value."""
    pairs = [F.when(~base[k].eqNullSafe(nxt[k]), F.struct(F.lit(k).alias("key"), nxt[k].cast("string").alias("value"))) for k in keys]
    return F.map_from_entries(F.array_compact(F.array(*pairs)))
