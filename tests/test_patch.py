"""Inline runs and patches: round trips, and replaying of planned calls."""

import itertools
import random
import re
import tracemalloc

import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from pyspark.sql import functions as F

from doclens.operators import diff, patch, richtext
from doclens.operators.richtext import from_markdown, inline_diff, joined, merge, run, text_of, to_markdown
from doclens.plans import queries

RUNS = st.lists(st.builds(run, st.sampled_from(["a", "b c", "word ", "x*y", "_", "é"]), bold=st.booleans(), link=st.sampled_from([None, None, "http://x"])), max_size=5)


@settings(max_examples=150, deadline=None)
@given(RUNS)
def test_markdown_keeps_the_text(runs):
    assert text_of(from_markdown(to_markdown(runs))) == text_of(runs)


def test_markdown_styles():
    runs = [run("plain "), run("bold", bold=True), run(" and "), run("link", link="http://x"), run(" c", code=True)]
    assert to_markdown(runs) == "plain **bold** and [link](http://x) `c`"
    assert [(r["text"], r["bold"], r["link"], r["code"]) for r in from_markdown("plain **bold** [l](u) `c*`")] == [("plain ", False, None, False), ("bold", True, None, False), (" ", False, None, False), ("l", False, "u", False), (" ", False, None, False), ("c*", False, None, True)]
    assert text_of(from_markdown("a * b ** c")) == "a * b ** c"


@settings(max_examples=100, deadline=None)
@given(RUNS, RUNS)
def test_merge_gives_the_next_text(base, nxt):
    assert text_of(merge(base, base, nxt)) == text_of(nxt)
    assert merge(base, base, base) == joined(base)


def test_merge_keeps_and_inherits():
    live = [run("one ", color="red"), run("two", bold=True)]
    out = merge(live, [run("one "), run("two", bold=True)], [run("one "), run("two three", bold=True)])
    assert [(r["text"], r["bold"], r["color"]) for r in out] == [("one ", False, "red"), ("two three", True, "default")]
    assert inline_diff([run("a b")], [run("a "), run("b", bold=True)])[1] == [(2, 1, {"bold": True})]
    assert merge([run("other")], [run("a")], [run("b", italic=True)]) == [run("b", italic=True)]


def test_style_changes_are_given_away_in_pieces():
    """a batch of many rows does not hold the changes of all of them, and a long text counts its units once."""
    words = [f"w{k}" for k in range(80)]
    base, nxt = (pa.array([" ".join(f"**{w}**" if k % n == 0 else w for k, w in enumerate(words))] * 4000 + [None]) for n in (3, 4))
    tracemalloc.start()
    sizes = [len(piece) for piece in richtext.style_changes.func(iter([(base, nxt)]))]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(sizes) == 4001 and max(sizes) < 1000 and peak < 30 * 2**20
    long = " ".join(["💡", *words] * 50)
    found = richtext.changes_of(long, long.replace("w7 ", "**w7** "))
    assert [(c["at"], c["length"]) for c in found] == [(diff.units(long[:at]), 2) for at in range(len(long)) if long.startswith("w7 ", at)]


def test_a_change_ends_with_its_span():
    """what is kept before and behind deleted text is two changes; an escaped backslash does not escape a mark."""
    assert inline_diff([run("one two, three")], [run("one, three", bold=True)])[1] == [(0, 3, {"bold": True}), (3, 7, {"bold": True})]
    for runs in ([run("a\\", bold=True), run(" b")], [run("\\*\\", bold=True)]):
        assert from_markdown(to_markdown(runs)) == runs


TURNS = ["", " ", "one two, three four.\nFive", "two three, four? Five\n\n*six* [x](y)", "zwei  💡 a_b **c** drei\\", "💡 a_b **c** \\ d\\* <u>e</u> ~~f~~ `g`", "one two, three four.\nFive", "* * * **", "é́ ́x naïve — “q”, (1.5)"]


def test_styles_are_of_the_whole_turn_and_the_next(spark, tmp_path):
    """every sign of a turn is read, and it is compared with the turn two behind it, not with itself."""
    bold = lambda text, every: [c.strip() and n % every == 0 for n, w in enumerate(re.split(r"(?<=\s)(?=\S)", text)) for c in w]
    pairs = dict(enumerate((a, b) for a in TURNS for b in TURNS)) | {900: (None, "a"), 901: ("a", None)}
    turns = spark.createDataFrame([(k, 2 * n, "user", t) for k, pair in pairs.items() for n, t in enumerate(pair)], "conv_id long, turn long, role string, text string")
    read = turns.select("text", *(queries.marked(F.col("text"), n).alias(f"m{n}") for n in (3, 4))).collect()
    for r in (r for r in read if r["text"] is not None):
        for n in (3, 4):
            assert [(c, x["bold"]) for x in from_markdown(r[f"m{n}"]) for c in x["text"]] == [(c, bool(x)) for c, x in zip(r["text"], bold(r["text"], n), strict=True)]
    turns.write.parquet(f"{tmp_path}/conversations.parquet")
    found = {r["key"] // 100: r["changes"] for r in queries.inline_diff(spark, str(tmp_path)).collect()}
    assert found.keys() == pairs.keys() and found.pop(900) is found.pop(901) is None
    for k, changes in found.items():
        (a, b), expected, i, j = pairs[k], [], 0, 0
        old, new = bold(a, 3), bold(b, 4)
        for kind, text in diff.diff_text(a, b):
            if kind == "keep":
                signs = [(diff.units(b[: j + n]), c, bool(new[j + n]) if bool(old[i + n]) != bool(new[j + n]) else None) for n, c in enumerate(text)]
                for change, group in itertools.groupby(signs, key=lambda x: x[2]):
                    group = list(group)
                    if change is not None:
                        expected.append((group[0][0], sum(diff.units(c) for _, c, _ in group), {"bold": str(change)}))
            i += len(text) if kind != "insert" else 0
            j += len(text) if kind != "delete" else 0
        assert [tuple(c) for c in changes] == expected
    assert any(found.values())


def replay(live, calls, texts):
    ids = [f"l{k}" for k in range(len(live))]
    content = dict(zip(ids, live, strict=True))
    for c in calls:
        if c["phase"] == "update":
            content[c["live_id"]] = texts[c["next_ords"][0]]
        elif c["phase"] == "delete":
            ids.remove(c["live_id"])
        else:
            at = ids.index(c["after_id"]) + 1 if c["after_id"] is not None else len(ids)
            for k in c["next_ords"]:
                ids.insert(at, f"new{k}")
                content[f"new{k}"] = texts[k]
                at += 1
    return [content[i] for i in ids]


def versions(rng):
    """Pairs of versions: what went wrong once, short alphabets, and blocks that are edited and change places."""
    yield from ((list("aab"), list("baa")), (list("abc"), list("cab")), ([], list("ab")), (list("ab"), []))
    yield ["one two three four", "five six seven eight"], ["five six seven nine", "one two three ten"]
    for _ in range(400):
        yield [rng.choice("abcd") for _ in range(rng.randrange(8))], [rng.choice("abcdx") for _ in range(rng.randrange(8))]
    words = "alpha beta gamma delta epsilon".split()
    for _ in range(200):
        base = [" ".join(rng.choice(words) for _ in range(4)) for _ in range(rng.randrange(7))]
        nxt = [" ".join([*x.split()[:3], rng.choice(words)]) if rng.random() < 0.6 else x for x in base]
        rng.shuffle(nxt)
        yield base, nxt[: rng.randrange(8)]


def test_calls_replay_to_the_next_version(spark):
    cases = list(versions(random.Random(1)))
    ops, live, nxt = [], [], []
    for k, (b, n) in enumerate(cases):
        ops += [(k, i, *op) for i, op in enumerate(diff.diff_level([("p", t) for t in b], [("p", t) for t in n]))]
        live += [(k, i, "p", f"l{i}", t) for i, t in enumerate(b)]
        nxt += [(k, i, "p", t) for i, t in enumerate(n)]
    ops = spark.createDataFrame(ops, "key long, op_ord long, op string, base_ord long, next_ord long")
    live = spark.createDataFrame(live, "key long, ord int, type string, live_id string, text string")
    nxt = spark.createDataFrame(nxt, "key long, ord int, type string, text string")
    calls = patch.page_calls(ops, live, nxt)
    made, replayed = {}, {}
    for c in calls.orderBy("key", "call").collect():
        made.setdefault(c["key"], []).append(c)
    for r in patch.replayed(calls, live, nxt).orderBy("key", "place").collect():
        replayed.setdefault(r["key"], []).append(r["text"])
    for k, (b, n) in enumerate(cases):
        own = made.get(k, [])
        assert [c["call"] for c in own] == list(range(len(own)))
        assert [c["phase"] for c in own] == sorted((c["phase"] for c in own), key=["update", "insert", "delete"].index)
        assert replay(b, own, n) == n == replayed.get(k, [])


def test_a_longest_run_stays(spark):
    rows = [(1, [5, 1, 2, 3, 4]), (2, [3, 2, 1]), (3, []), (4, [1, 2, 9, 3, 8, 4])]
    found = spark.createDataFrame(rows, "k int, v array<long>").select("k", patch.longest_increasing(F.col("v")).alias("v")).collect()
    assert {r["k"]: r["v"] for r in found} == {1: [1, 2, 3, 4], 2: [1], 3: [], 4: [1, 2, 3, 4]}


def test_refusals(spark):
    ops = [(1, 0, "update", 0, 0), (2, 0, "keep", 3, 0), (3, 0, "update", 0, 0), (4, 0, "insert", None, 0), (4, 1, "keep", 0, 1), (5, 0, "keep", 0, 0)]
    live = [(1, 0, "placeholder:x", "i"), (2, 0, "p", "i"), (3, 0, "p", "i"), (4, 0, "placeholder:y", "i"), (5, 0, "placeholder:z", "i")]
    nxt = [(1, 0, "p"), (2, 0, "p"), (3, 0, "h"), (4, 0, "p"), (4, 1, "placeholder:y"), (5, 0, "placeholder:z")]
    found = patch.page_calls(spark.createDataFrame(ops, "key long, op_ord long, op string, base_ord long, next_ord long"), spark.createDataFrame(live, "key long, ord int, type string, live_id string"), spark.createDataFrame(nxt, "key long, ord int, type string")).collect()
    assert {r["key"]: (r["phase"], r["problem"]) for r in found} == {1: ("refused", "a placeholder cannot be edited"), 2: ("refused", "the live document has fewer blocks"), 3: ("refused", "a block cannot change its type"), 4: ("refused", "a placeholder cannot be moved")}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=12), st.lists(st.sampled_from("abc"), max_size=12))
def test_common_pairs_are_those_of_the_whole_table(a, b):
    assert patch.common_pairs(a, b) == [(i, j) for kind, i, j in diff.walk(a, b) if kind == "keep"]


def test_alignment_of_lists():
    assert patch.align(["a", "b", "c"], ["a", "x", "c"]) == [(0, 0), (1, 1), (2, 2)]
    assert patch.align(["a", "b", "c"], ["a", "c"]) == [(0, 0), (2, 1)]
    rng = random.Random(2)
    a = [str(rng.randrange(500)) for _ in range(3000)]
    b = list(a)
    for _ in range(300):
        b.insert(rng.randrange(len(b)), "new")
        b.pop(rng.randrange(len(b)))
    pairs = patch.align(a, b)  # nine million cells
    assert len(pairs) > 2600 and all(i < k and j < n for (i, j), (k, n) in zip(pairs, pairs[1:], strict=False))


def test_aligned_blocks(spark):
    schema = "key long, ord int, parent int, type string, text string"
    base = [(1, 0, None, "p", "a"), (1, 1, 0, "p", "a1"), (1, 2, 0, "p", "a2"), (1, 3, None, "p", "b"), (1, 4, 3, "p", "b1"), (1, 5, None, "p", "c"), (2, 0, None, "p", "x"), (2, 1, 0, "p", "x1"), (2, 2, 1, "p", "x2"), (3, 0, None, "p", "only base")]
    live = [(1, 10, None, "p", "a"), (1, 11, 10, "p", "other"), (1, 12, 10, "p", "a2"), (1, 13, None, "p", "B"), (1, 14, 13, "p", "b1"), (1, 15, None, "p", "c"), (1, 16, None, "h", "c"), (2, 5, None, "p", "x"), (2, 6, 5, "p", "x1"), (2, 7, 6, "p", "x2")]
    found = patch.aligned_blocks(spark.createDataFrame(base, schema), spark.createDataFrame(live, schema)).collect()
    assert sorted(map(tuple, found)) == [(1, 0, 10), (1, 1, 11), (1, 2, 12), (1, 3, 13), (1, 4, 14), (1, 5, 15), (2, 0, 5), (2, 1, 6), (2, 2, 7)]


def test_short_lists_are_aligned_without_arrays(monkeypatch):
    """equal heads and short lists, as nearly all levels are, need no array of numbers."""
    rng, cases = random.Random(4), []
    for _ in range(300):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(12))] for _ in range(2))
        cases.append((a, b, [(i, j) for kind, i, j in diff.walk(a, b) if kind == "keep"]))
    monkeypatch.setattr(patch, "np", None)
    assert all(patch.common_pairs(a, b) == pairs for a, b, pairs in cases)
    same = [str(k) for k in range(5000)]
    assert len(patch.align(same, [*same, "new"])) == 5000


def test_no_frame_runs_to_the_end(spark):
    """a frame of following rows is added up anew for each row of a document."""
    ops = spark.createDataFrame([(1, 0, "keep", 1, 0), (1, 1, "keep", 0, 1)], "key long, op_ord long, op string, base_ord long, next_ord long")
    assert "unboundedfollowing$()))" not in patch.with_survivors(ops)._jdf.queryExecution().optimizedPlan().toString().replace("specifiedwindowframe(RowFrame, unboundedpreceding$(), unboundedfollowing$())", "")


def test_text_requests(spark):
    rng = random.Random(5)
    text = "abcdefghij" * 3
    at = sorted(rng.sample(range(0, 30, 3), 5))
    edits = [(1, i, text[i : i + 2], "XY", n) for n, i in enumerate(at)]
    made = patch.text_requests(spark.createDataFrame(edits, "key int, index int, deleted string, inserted string, order int"))
    from doclens.operators.plan import request_order

    out = text
    for r in made.orderBy(*request_order()).collect():
        out = out[: r["index"]] + (out[r["index"] + len(r["text"]) :] if r["phase"] == 0 else r["text"] + out[r["index"] :])
    expected = list(text)
    for i in at:
        expected[i : i + 2] = "XY"
    assert out == "".join(expected)


def test_runs_udf(spark):
    row = spark.createDataFrame([("a **b**",), (None,)], "m string").select(richtext.markdown_runs("m").alias("r")).collect()
    assert [(x["text"], x["bold"]) for x in row[0]["r"]] == [("a ", False), ("b", True)]
    assert row[1]["r"] is None
