"""Operators on small literal tables, and invariants of the differences."""

import json
import random
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from doclens.functions import paths
from doclens.operators import blocks, diff, naming, plan, runs, snapshot, threads, tree
from doclens.plans import queries
from doclens.sources import readers
from doclens.streaming.incremental import fold_listings, latest, numbers

WORDS = st.lists(st.sampled_from(["a", "b", "c", "💡", "Two.", "e\u0301"]), max_size=12).map(" ".join)


@settings(max_examples=100, deadline=None)
@given(WORDS, WORDS)
def test_text_diff_replays(a, b):
    spans = diff.diff_text(a, b)
    assert "".join(t for k, t in spans if k != "insert") == a
    assert "".join(t for k, t in spans if k != "delete") == b
    assert all(t for _, t in spans)
    assert all(x[0] != y[0] for x, y in zip(spans, spans[1:], strict=False))
    assert {k for k, _ in diff.diff_text(a, a)} <= {"keep"}


def test_text_diff_coalesces():
    assert diff.diff_text("a b c d", "x y c d") == [("delete", "a b"), ("insert", "x y"), ("keep", " c d")]
    spans = diff.diff_text("a m n b", "x m n y")
    assert [k for k, _ in spans] == ["delete", "insert", "keep", "delete", "insert"]
    assert diff.diff_text("a m n b", "x m n y", join_under=4) == [("delete", "a m n b"), ("insert", "x m n y")]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=10), st.lists(st.sampled_from("abcd"), max_size=10))
def test_block_ops_cover_both_sides(a, b):
    base, nxt = [("p", x) for x in a], [("p", x) for x in b]
    ops = diff.diff_level(base, nxt)
    assert sorted(i for _, i, _ in ops if i is not None) == list(range(len(a)))
    assert [j for _, _, j in ops if j is not None] == list(range(len(b)))
    assert all(base[i] == nxt[j] for o, i, j in ops if o in ("keep", "move"))


def test_block_ops():
    p = lambda *texts: [("p", t) for t in texts]
    assert [o for o, _, _ in diff.diff_level(p("Two."), p("Two, edited."))] == ["update"]
    assert [o for o, _, _ in diff.diff_level(p("one", "two"), p("x y z", "q r s"))] == ["delete", "delete", "insert", "insert"]
    assert diff.diff_level(p("a", "b", "c"), p("b", "c", "a")) == [("keep", 1, 0), ("keep", 2, 1), ("move", 0, 2)]
    assert [o for o, _, _ in diff.diff_level(p("m", "x", "m"), p("x"))].count("delete") == 2
    assert [o for o, _, _ in diff.diff_level([("h", "same text")], [("p", "same text")])] == ["delete", "insert"]
    assert diff.similarity("", "") == 1.0
    assert diff.similarity("ab cd", "cd ab") == 1.0


def test_block_diff_counts(spark):
    rows = lambda texts: spark.createDataFrame([(1, n, "p", t) for n, t in enumerate(texts)], "key long, ord int, type string, text string")
    ops = diff.block_diff(rows(["a b", "c d", "e f"]), rows(["c d", "e g", "a b"]))
    found = diff.op_counts(ops).first().asDict()
    assert found == {"key": 1, "kept": 1, "updated": 1, "inserted": 1, "deleted": 1}


def test_changes_since(spark):
    row = "id int, time string, md5 string"
    cur = spark.createDataFrame([(1, "t1", "a"), (2, "t2", "a"), (3, "t1", "b"), (4, "", None), (5, "t1", None)], row)
    prev = spark.createDataFrame([(1, "t1", "a"), (2, "t1", "a"), (3, "t1", "a"), (5, "t1", "z"), (6, "t1", "a")], row)
    assert {(r["id"], r["change"]) for r in snapshot.changes_since(cur, prev).collect()} == {(2, "modified"), (3, "modified"), (4, "added")}
    assert [r["id"] for r in snapshot.gone(cur, prev).collect()] == [6]


def test_roots_and_author(spark):
    roots = spark.createDataFrame([(1, "specs/auth.md"), (0, "drive/"), (2, "drive/x/")], "root_ord int, root_path string")
    paths = spark.createDataFrame([("specs/auth.md",), ("specs/auth/y.md",), ("drive/x/z.md",), ("drive",), ("free.md",), ("specs/auth",)], "path string")
    found = {r["path"]: r["root_ord"] for r in snapshot.assign_roots(paths, roots).collect()}
    assert found == {"specs/auth.md": 1, "specs/auth/y.md": 1, "drive/x/z.md": 0, "drive": 0, "free.md": None, "specs/auth": 1}
    assert [r["path"] for r in snapshot.carried_over(paths, roots).collect()] == ["free.md"]
    rows = spark.createDataFrame([(1, 0, "late", "t2"), (0, 5, "first", "t2"), (0, 6, "second", "t2"), (0, 0, None, "t9")], "root_ord int, file_ord int, editor string, time string")
    assert snapshot.commit_author(rows).first()["editor"] == "first"
    overlaps = spark.createDataFrame([(0, "a/"), (1, "A/b.md"), (2, "a"), (3, "c.md"), (4, "c/d/"), (5, "e/")], "root_ord int, root_path string")
    assert {(r["root_ord"], r["other_ord"]) for r in snapshot.root_overlaps(overlaps).collect()} == {(1, 0), (2, 1), (4, 3)}


def first_overlaps(roots):
    """The same over all pairs."""
    keyed = [(n, p.lower(), re.sub("/$", "", p.lower()), re.sub(r"^((?:.*/)?[^/]+)\.[^./]*$", r"\1", re.sub("/$", "", p.lower())) if not p.endswith("/") else p[:-1].lower()) for n, p in roots]
    meet = lambda a, b: a[1] == b[1] or b[2].startswith(a[3] + "/") or a[2].startswith(b[3] + "/")
    return {(b[0], min(a[0] for a in keyed if a[0] < b[0] and meet(a, b))) for b in keyed if any(a[0] < b[0] and meet(a, b) for a in keyed)}


def test_root_overlaps_of_all_pairs(spark):
    rng = random.Random(5)
    roots = [(n, "/".join(rng.choice("abCcDdefgh") for _ in range(rng.randint(1, 4))) + rng.choice(["/", "", ".md", ".x.md"])) for n in range(250)]
    found = snapshot.root_overlaps(spark.createDataFrame(roots, "root_ord int, root_path string")).collect()
    assert len(found) == len({r["root_ord"] for r in found})
    assert {tuple(r) for r in found} == first_overlaps(roots)


def test_root_overlap_query_takes_all_documents(spark, tmp_path):
    """Over ids from 0 to 399, in order to see the roots from 90 on."""
    spark.range(400).withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    roots = [(n, f"src{n % 20}" + ("/", f"/d{n % 4}/", f"/d{n % 4}.md")[n % 3]) for n in range(400)]
    expected = first_overlaps(roots)
    assert max(expected)[0] == 399
    assert {tuple(r) for r in queries.root_overlap(spark, str(tmp_path)).collect()} == expected


def test_snapshot_is_written_once(spark, tmp_path):
    one = spark.createDataFrame([("a", "1"), ("b", "2")], "path string, sha string")
    folder = str(tmp_path / "table")
    assert snapshot.commit_snapshot(None, one, folder, 0)
    assert not snapshot.commit_snapshot(latest(spark, folder), one, folder, 1)
    assert snapshot.commit_snapshot(latest(spark, folder), one.where("path = 'a'"), folder, 1)
    assert [r["path"] for r in latest(spark, folder).collect()] == ["a"]


def test_stream_folds_batches(spark, tmp_path):
    source, folder = tmp_path / "in", str(tmp_path / "out")
    schema = "path string, sha string"
    for rows, count in (([("a", "1"), ("b", "1")], 1), ([("a", "1")], 1), ([("a", "2")], 2)):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
        fold_listings(spark.readStream.schema(schema).json(str(source)), folder, str(tmp_path / "check")).awaitTermination()
        assert spark.read.parquet(folder).select("snapshot_id").distinct().count() == count
    assert {tuple(r) for r in latest(spark, folder).collect()} == {("a", "2"), ("b", "1")}


def test_names(spark):
    rows = [("d", 0, "3", "Notes", ".md", None), ("d", 1, "1", "Notes", ".md", None), ("d", 2, "2", "Notes (2)", ".md", None), ("d", 3, "9", "notes", ".md", "notes (7).md"), ("e", 4, "4", "Notes", ".md", "gone.md")]
    found = {r["id"]: r["name"] for r in naming.assign_names(spark.createDataFrame(rows, "folder string, ord int, id string, title string, ext string, kept string")).collect()}
    assert found == {"9": "notes (7).md", "1": "Notes.md", "2": "Notes (2).md", "3": "Notes (3).md", "4": "Notes.md"}


def plain_name(title, ext):
    trim = lambda x: re.sub(rf"^{paths.EDGES}+|{paths.EDGES}+$", "", x)
    stem = re.sub(paths.DEVICES, r"\1-\2", trim(re.sub(paths.FORBIDDEN, "-", title))) or "untitled"
    return (trim(stem.encode()[: max(200 - len(ext.encode()), 0)].decode(errors="ignore")) or "untitled") + ext


def named_one_by_one(rows):
    """Names of one folder, in the order of the contract."""
    nth = lambda title, ext, n: plain_name(title, ext if n == 1 else f" ({n}){ext}")
    taken, names, waiting = set(), {}, []
    for _, _, id_, title, ext, kept in sorted(rows, key=lambda r: r[1]):
        number = re.search(r" \((\d+)\)$", kept[: len(kept) - len(ext)]) if kept and kept.endswith(ext) else None
        gives = kept is not None and (kept == nth(title, ext, 1) or (number is not None and kept == nth(title, ext, int(number[1]))))
        if gives and kept.lower() not in taken:
            names[id_] = kept
            taken.add(kept.lower())
        else:
            waiting.append((id_, title, ext))
    for id_, title, ext in sorted(waiting):
        n = 1
        while nth(title, ext, n).lower() in taken:
            n += 1
        names[id_] = nth(title, ext, n)
        taken.add(names[id_].lower())
    return names


def test_names_as_one_by_one(spark):
    """Families that want each other's names, kept numbers, cut and empty titles, extensions that are part of a title."""
    rng = random.Random(0)
    titles = ["Notes", "notes", "Notes (2)", "Notes (3)", "Notes (2) (2)", "a", "A (2)", "a (1)", "a (0)", "", "...", "CON", "Notes.md", "x" * 197, "x" * 200, "x" * 193 + " (2)", "x" * 193, "é" * 99, "Notes (12)", "b?", "b*"]
    rows = []
    for folder in range(60):
        n, some = rng.randrange(1, 40), rng.sample(titles, rng.randrange(1, 8))
        for o, id_ in enumerate(rng.sample(range(1000), n)):
            title, ext, kept = rng.choice(some), rng.choice([".md", ".md", ".md", ""]), None
            if rng.random() < 0.3:
                kept = plain_name(title, ext if rng.random() < 0.4 else f" ({rng.choice([0, 1, 2, 3, 4, 12])}){ext}")
            if rng.random() < 0.05:
                kept = plain_name(rng.choice(titles), ".md")
            rows.append((str(folder), o, f"{id_:04d}", title, ext, kept))
    found = naming.assign_names(spark.createDataFrame(rows, "folder string, ord int, id string, title string, ext string, kept string")).collect()
    expected = {(str(f), id_): name for f in range(60) for id_, name in named_one_by_one([r for r in rows if r[0] == str(f)]).items()}
    assert len(found) == len(expected) and {(r["folder"], r["id"]): r["name"] for r in found} == expected


def test_names_of_one_large_family(spark):
    """Ten thousand equal titles, every third number kept, and rows whose titles spell some of the numbers."""
    rows = [("d", n, f"{n:06d}", "Notes", ".md", f"Notes ({n + 2}).md" if n % 3 == 0 else None) for n in range(10_000)]
    rows += [("d", 20_000 + n, f"{n * 7:06d}x", f"Notes ({n})", ".md", None) for n in range(2, 400)]
    found = naming.assign_names(spark.createDataFrame(rows, "folder string, ord int, id string, title string, ext string, kept string")).collect()
    assert {r["id"]: r["name"] for r in found} == named_one_by_one(rows)


def test_odd_rows_have_names(spark):
    rows = [("d", 0, None, None, None, None), ("d", 1, "1", None, None, None), (None, 0, "2", "a", ".md", "a.md"), (None, 1, "3", "a", ".md", None), (None, 2, "4", "A", ".md", None)]
    schema = "folder string, ord int, id string, title string, ext string, kept string"
    assert sorted((r["id"] or "", r["name"]) for r in naming.assign_names(spark.createDataFrame(rows, schema)).collect()) == [("", "untitled"), ("1", "untitled (2)"), ("2", "a.md"), ("3", "a (2).md"), ("4", "A (3).md")]
    assert naming.assign_names(spark.createDataFrame([], schema)).collect() == []


def test_walks_order_any_number(spark):
    nodes = spark.createDataFrame([("r", None, 0, "r"), ("a", "r", 12345678902, "a"), ("b", "r", 12345678901, "b"), ("c", "r", -5, "c"), ("d", "r", 7, "d"), ("e", "r", None, "e")], "id string, parent_id string, ord long, name string")
    assert [r["id"] for r in tree.walk(nodes).orderBy("sort").collect()] == ["r", "e", "c", "d", "b", "a"]


def test_tabs_of_ids_with_marks(spark):
    tabs = spark.createDataFrame([("x#1", "t", None, 1, "T"), ("x#1", "u#2", "t", 0, "U"), ("x#2", "t", None, 0, "T"), ("x", "1#t", None, 0, "V")], "doc_id string, tab_id string, parent_tab string, index int, title string")
    assert sorted(tuple(r) for r in tree.tab_order(tabs).collect()) == [("x", "1#t", "V", 0), ("x#1", "t", "T", 0), ("x#1", "u#2", "T/U", 1), ("x#2", "t", "T", 0)]


def test_index_is_in_the_order_of_utf16(spark):
    rows = spark.createDataFrame([("\ue000.md", "1"), ("\U0001f4a1.md", "2"), ("b.md", "3")], "path string, id string")
    assert [r["id"] for r in snapshot.index_rows(rows).collect()] == ["3", "2", "1"]


@pytest.mark.parametrize(
    ("globs", "path", "ignored"),
    [
        (["Archive/**", "!Archive/2024/"], "Archive/2024/x.md", True),
        (["Archive/**", "!Archive/2024/"], "Archive/2023/x.md", True),
        (["*.tmp"], "a/b.tmp", True),
        (["/a.md"], "b/a.md", False),
        (["/a.md"], "a.md", True),
        (["Archive/", "!Archive/x.md"], "Archive/x.md", True),
        (["a?c", "[xy]z"], "q/abc", True),
        (["a?c", "[!xy]z"], "xz", False),
        (["**/deep/*.md"], "p/q/deep/r.md", True),
        ([], "a", False),
    ],
)
def test_globs(spark, globs, path, ignored):
    assert spark.range(1).select(tree.ignored_by_globs(F.lit(path), globs).alias("x")).first()["x"] is ignored


def test_tabs_and_events(spark):
    tabs = spark.createDataFrame([("d", "t.1", None, 1, "B"), ("d", "t.0", None, 0, "A"), ("d", "t.2", "t.0", 0, "A1")], "doc_id string, tab_id string, parent_tab string, index int, title string")
    found = {r["tab_id"]: (r["position"], r["path"]) for r in tree.tab_order(tabs).collect()}
    assert found == {"t.0": (0, "A"), "t.2": (1, "A/A1"), "t.1": (2, "B")}
    f = [{"fileId": "f1"}, {"fileId": "f2"}, {"fileId": "f1"}]
    rows = [("e", "2026-01-01T09:00:00+02:00", "Call", []), ("e", "2026-01-01T09:00:30+02:00", "Call", f), ("e", "2030-01-01T00:00:00Z", "Call", f)]
    made = tree.event_folders(spark.createDataFrame(rows, "event_id string, start string, summary string, attachments array<struct<fileId:string>>"), "2026-06-01T00:00:00Z")
    assert [r["folder"] for r in made.collect()] == ["2026-01-01 0900 Call (2)"]
    assert sorted(r["file_id"] for r in tree.event_files(made).collect()) == ["f1", "f2"]


def test_thread_rendering(spark):
    row = spark.createDataFrame([(1, ["a", "b\nc", "d", ""], ["a", "B", "D", "x"]), (2, [], [])], "key int, before array<string>, after array<string>")
    assert {r["key"]: r["lines"] for r in threads.hunks(row).collect()} == {1: ["  a", "- b", "- c", "- d", "+ B", "+ D", "+ x"], 2: []}
    rows = [("1", 3, None, "c2"), ("2", None, None, "c1"), ("3", 3, 1, "c0"), ("4", 3, None, "c1")]
    ordered = spark.createDataFrame(rows, "id string, offset int, within int, created string").orderBy(*threads.thread_order())
    assert [r["id"] for r in ordered.collect()] == ["4", "1", "3", "2"]
    marked = spark.createDataFrame([([("old ", None, ["s"]), ("new ", ["s"], None), ("other ", ["t"], None), ("rest\n", None, None)],)], "runs array<struct<text:string,insertions:array<string>,deletions:array<string>>>")
    assert marked.select(threads.accepted_text(F.col("runs"), F.lit("s")).alias("t")).first()["t"] == "new rest"


def test_intervals_against_points(spark):
    rng = random.Random(2)
    gaps = [(k, s := rng.randrange(40), s + rng.randrange(1, 8)) for k in range(4) for _ in range(6)]
    ranges = [(k, 3, 37) for k in range(5)]
    schema = "key int, start int, end int"
    found = runs.subtract_intervals(spark.createDataFrame(ranges, schema), spark.createDataFrame(gaps, schema)).collect()
    points = {(r["key"], x) for r in found for x in range(r["start"], r["end"])}
    assert points == {(k, x) for k, s, e in ranges for x in range(s, e) if not any(g == k and a <= x < b for g, a, b in gaps)}
    assert len(points) == sum(r["end"] - r["start"] for r in found)


def test_plan_details(spark):
    commits = spark.createDataFrame([("c", "b"), ("b", "a"), ("a", None), ("x", "a")], "commit string, parent string")
    assert plan.is_ancestor(commits, "a", "c")
    assert not plan.is_ancestor(commits, "b", "x")
    pages = spark.createDataFrame([("a.md", "1"), ("a/b.md", "2")], "path string, id string")
    new = spark.createDataFrame([("a/b/c.md",), ("z.md",)], "path string")
    assert {r["path"]: r["parent_id"] for r in plan.parent_of(new, pages).collect()} == {"a/b/c.md": "2", "z.md": None}
    report = plan.push_report(spark.createDataFrame([("b", "trashed", [], []), ("a", "updated", ["x"], ["y", "z"])], "path string, action string, uploaded array<string>, skipped array<string>"))
    assert [r["line"] for r in report.collect()] == ["updated a, 1 uploaded; skipped y, z", "trashed b"]


DOCUMENT = "---\nid: notion:1\n---\n# Title *x*\n\nOne\ntwo **b**\n\n- a\n  - b\n- [x] c\n1. d\n\n> q\n> r\n\n| h | i |\n|---|---|\n| 1 | `2` |\n\n```py\n# no\n```\n---\n<!-- pagebreak -->\n"


def test_markdown_blocks(spark):
    found = list(blocks.parse(DOCUMENT))
    assert [r[3] for r in found] == ["heading_1", "paragraph", "bulleted_list_item", "bulleted_list_item", "to_do", "numbered_list_item", "quote", "table", "table_row", "table_row", "code", "divider", "pagebreak"]
    assert found[0][5] == "Title x"
    assert found[3][1] == found[2][0]
    assert found[9][5] == "1\t2"
    d = spark.createDataFrame([(1, DOCUMENT), (2, None), (3, "")], "doc_id long, text string")
    assert blocks.markdown_blocks(d).count() == 13
    from doclens.functions.registry import register

    register(spark)
    d.createOrReplaceTempView("md_docs")
    assert spark.sql("SELECT count(*) FROM md_docs, LATERAL markdown_blocks(text)").first()[0] == 13


def test_sources(spark, tmp_path):
    roots, problems = readers.read_manifest("version: 1\nroots:\n  - src: notion:1\n    path: a.md\n  - src: x:1\n    path: b/\n    extra: 1\n    readonly: maybe\n")
    assert problems == ["line 7: unknown key extra", "line 5: readonly is true or false", "line 5: unknown source x"]
    text = readers.write_manifest([{"src": "gdocs:1", "path": "d/", "read_only": True}])
    assert [r["root_path"] for r in readers.manifest_roots(spark, text).collect()] == ["d/"]
    with pytest.raises(ValueError, match="no extension"):
        readers.manifest_roots(spark, readers.write_manifest([{"src": "gdocs:1", "path": "d"}]))
    (tmp_path / "c.json").write_text('[{"id":"1","content":"hi","createdTime":"t","author":{"displayName":"A"},"replies":[{"content":"yo","createdTime":"u","deleted":true}]}]')
    assert [(r["ord"], r["text"], r["deleted"]) for r in readers.comments(spark, str(tmp_path / "c.json")).orderBy("ord").collect()] == [(0, "hi", False), (1, "yo", True)]
    (tmp_path / "b.json").write_text('[{"id":"x","type":"paragraph","has_children":true,"paragraph":{"rich_text":[]}}]')
    assert [(r["type"], r["has_children"]) for r in readers.blocks(spark, str(tmp_path / "b.json")).collect()] == [("paragraph", True)]
    head = spark.range(1).select(readers.front_matter(F.lit(DOCUMENT)).alias("f")).first()["f"]
    assert (head["has"], head["id"], head["body"][:7]) == (True, "notion:1", "# Title")
    assert not spark.range(1).select(readers.front_matter(F.lit("no --- head")).alias("f")).first()["f"]["has"]


def test_event_folders_query_takes_all_users(spark, tmp_path):
    rows = [(n, f"2024-01-{1 + n % 25:02} 10:{n % 7:02}:{n % 60:02}", n % 150, ["call", "Call", "talk"][n % 3]) for n in range(1200)]
    spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.col("ts").cast("timestamp")).write.parquet(f"{tmp_path}/events.parquet")
    found = {r["event_id"]: (r["folder"], r["files"]) for r in queries.event_folders(spark, str(tmp_path)).collect()}
    expected, turns = {}, {}
    for n, ts, user, kind in sorted(rows, key=lambda r: (r[1], r[0])):
        if ts < "2024-01-20":
            name = f"{ts[:10]} {ts[11:13]}{ts[14:16]} {kind}"
            turns[user, name.lower()] = t = turns.get((user, name.lower()), 0) + 1
            if n % 3:
                expected[n] = (name if t == 1 else f"{name} ({t})", n % 3)
    assert found == expected
    assert {rows[n][2] for n in found} - set(range(40))


def test_sidecar_equal_query_compares_whole_texts(spark, tmp_path):
    """Rows alone cannot tell, both sides come from one text: no part of the plan cuts it."""
    rows = [(n, "x" * 100 + f"\nfetched: {n}\n💡" * (n % 3)) for n in range(8)] + [(8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    found = queries.sidecar_equal(spark, str(tmp_path))
    assert {r["doc_id"]: r["same"] for r in found.collect()} == {n: n % 4 != 0 if n < 8 else None for n in range(9)}
    assert "left(" not in found._jdf.queryExecution().analyzed().toString().lower()


def test_anchors_cut_by_utf16_units(spark):
    """Offsets count a character beyond the basic plane twice; a cut inside one leaves it where it starts."""
    runs = spark.createDataFrame([(1, 0, 6, 0, "💡abcd"), (1, 6, 10, 6, "é💡x")], "doc_id long, start int, end int, at int, text string")
    anchors = spark.createDataFrame([(1, "a", 2, 4), (1, "b", 0, 2), (1, "c", 1, 3), (1, "d", 5, 8), (1, "e", 8, 10)], "doc_id long, anchor_id string, start int, end int")
    found = {r["anchor_id"]: (r["quote"], r["at"]) for r in threads.anchored_text(anchors, runs).collect()}
    assert found == {"a": ("ab", 2), "b": ("💡", 0), "c": ("a", 1), "d": ("dé💡", 5), "e": ("x", 8)}


@pytest.mark.parametrize("text", ["", "ab", "abcdefghijk", "💡" * 9, "abc💡" * 5, "abcd💡", "💡abcd💡", "a💡" * 7])
def test_pieces_of_runs_hold_so_many_units(spark, text):
    made = plan.split_runs(spark.createDataFrame([(1, text)], "id long, text string"), 5).orderBy("piece").collect()
    pieces = [r["text"] for r in made]
    units = [len(p.encode("utf-16-le")) // 2 for p in pieces]
    assert "".join(pieces) == text and max(units) <= 5
    raw = text.encode("utf-16-le")
    plain = [raw[k : k + 10] for k in range(0, max(len(raw), 1), 10)]
    if not any(p[-1:] and 0xD8 <= p[-1] <= 0xDB for p in plain):  # no cut inside a character: the plain cuts
        assert pieces == [p.decode("utf-16-le") for p in plain]


def test_deep_trees_and_long_histories(spark):
    n = 130
    nodes = spark.createDataFrame([(str(k), str(k - 1) if k else None, 0, "n") for k in range(n)], "id string, parent_id string, ord int, name string")
    found = {r["id"]: r["depth"] for r in tree.walk(nodes).collect()}
    assert found == {str(k): k for k in range(n)}
    commits = spark.createDataFrame([(f"c{k}", f"c{k - 1}" if k else None) for k in range(n)] + [("side", "c3")], "commit string, parent string")
    assert plan.is_ancestor(commits, "c0", f"c{n - 1}")
    assert not plan.is_ancestor(commits, "side", f"c{n - 1}")
    assert not plan.is_ancestor(commits, "c5", "c4")


def test_roots_of_repeated_and_null_paths(spark):
    paths = spark.createDataFrame([("a/b.md", 1), ("a/b.md", 2), (None, 3), ("z/y.md", 4), ("a.md", 5)], "path string, n int").repartition(3)
    roots = spark.createDataFrame([(0, "a/b.md"), (1, "a/"), (2, "a.md")], "root_ord int, root_path string")
    found = {r["n"]: r["root_ord"] for r in snapshot.assign_roots(paths, roots).collect()}
    assert found == {1: 0, 2: 0, 3: None, 4: None, 5: 2}


def test_a_new_stream_appends_and_a_batch_replaces_its_own(spark, tmp_path):
    source, folder, schema = tmp_path / "in", str(tmp_path / "out"), "path string, sha string"
    run = lambda check: fold_listings(spark.readStream.schema(schema).json(str(source)), folder, str(tmp_path / check)).awaitTermination()
    put = lambda *rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(str(source))
    put(("a", "1"), ("b", "1"))
    run("one")
    put(("a", "2"))
    run("one")
    assert numbers(spark, folder) == [0, 1]
    put(("b", None), ("c", "1"))  # b is gone
    run("two")  # a new checkpoint reads all files again, in one batch
    assert numbers(spark, folder) == [0, 1, 2]
    assert {r["path"] for r in latest(spark, folder).collect()} >= {"a", "c"}
    assert {tuple(r) for r in latest(spark, folder, 2).collect()} == {("a", "2"), ("b", "1")}


@pytest.mark.parametrize("seed", range(6))
def test_hunks_pair_as_all_pairs_would(seed):
    """Against the similarity of every removed with every inserted block."""
    rng = random.Random(seed)
    block = lambda: (rng.choice("pq"), " ".join(rng.choice(["a", "bb", "ccc", "dddd", "e", ""]) for _ in range(rng.randint(0, 6))))
    removed, inserted = [block() for _ in range(rng.randint(0, 14))], [block() for _ in range(rng.randint(0, 14))]
    scored = sorted((-s, abs(i - j), i, j) for i, (t, x) in enumerate(removed) for j, (u, y) in enumerate(inserted) if t == u and (s := diff.similarity(x, y)) >= 0.5)
    pairs = {}
    for _, _, i, j in scored:
        if j not in pairs and i not in pairs.values():
            pairs[j] = i
    left_i, left_j = [i for i in range(len(removed)) if i not in pairs.values()], [j for j in range(len(inserted)) if j not in pairs]
    if len(left_i) == len(left_j) == 1 and removed[left_i[0]][0] == inserted[left_j[0]][0]:
        pairs[left_j[0]] = left_i[0]
    assert diff.pair_hunk(removed, inserted) == pairs


def test_renames_by_likeness(spark):
    """Against the scores of all pairs, and the best of them one by one."""
    rng = random.Random(8)
    words = [f"line {k}" for k in range(25)] + ["common"] * 10
    files = lambda side, n: [(f"{side}{k}", "\n".join(rng.choice(words) for _ in range(rng.randint(1, 12)))) for k in range(n)]
    old, new = files("a", 14), files("b", 12)
    new += [("b90", old[0][1] + "\nmore"), ("b91", old[0][1] + "\nmore still"), ("b92", old[1][1])]

    def score(x, y):
        count = lambda t: {v: t.split("\n").count(v) * (len(v) + 1) for v in t.split("\n")}
        a, b = count(x), count(y)
        return sum(min(n, b.get(v, 0)) for v, n in a.items()) / max(sum(a.values()), sum(b.values()))

    scores = {(p, q): s for p, x in old for q, y in new if (s := score(x, y)) >= 0.5}
    one, two = (spark.createDataFrame(f, "path string, text string") for f in (old, new))
    found = {(r["previous_path"], r["path"]): r["score"] for r in snapshot.rename_scores(one, two).collect()}
    assert found == pytest.approx(scores)
    expected, taken = {}, set()
    for (p, q), s in sorted(scores.items(), key=lambda x: (-x[1], x[0])):
        if p not in taken and q not in taken:
            expected[p, q] = s
            taken |= {p, q}
    assert {(r["previous_path"], r["path"]): r["score"] for r in snapshot.similar_renames(one, two).collect()} == pytest.approx(expected)


def test_nested_blocks(spark):
    """Children are compared under blocks that stay or are edited; what goes or comes takes them along."""
    row = "key long, ord int, parent int, type string, text string"
    base = [(1, 0, None, "p", "one"), (1, 1, 0, "p", "in one"), (1, 2, 0, "p", "second in one"), (1, 3, None, "p", "two words here"), (1, 4, 3, "p", "in two"), (1, 5, None, "q", "gone"), (1, 6, 5, "p", "gone too")]
    nxt = [(1, 0, None, "p", "one"), (1, 1, 0, "p", "second in one"), (1, 2, None, "p", "two words there"), (1, 3, 2, "p", "in two"), (1, 4, 2, "p", "new in two"), (1, 5, None, "h", "fresh"), (1, 6, 5, "p", "under fresh"), (2, 0, None, "p", "alone")]
    ops = diff.block_diff(spark.createDataFrame(base, row), spark.createDataFrame(nxt, row)).orderBy("key", "op_ord").collect()
    assert [(r["key"], r["op"], r["base_ord"], r["next_ord"], r["depth"]) for r in ops] == [(1, "keep", 0, 0, 0), (1, "delete", 1, None, 1), (1, "keep", 2, 1, 1), (1, "delete", 5, None, 0), (1, "update", 3, 2, 0), (1, "keep", 4, 3, 1), (1, "insert", None, 4, 1), (1, "insert", None, 5, 0), (2, "insert", None, 0, 0)]


def test_pushes_on_what_moved(spark, tmp_path):
    with pytest.raises(snapshot.Moved, match="fetch first"):
        snapshot.refuse_if_moved(3, 4)
    snapshot.refuse_if_moved(None, None)
    report = spark.createDataFrame([("a", 1)], "path string, n int")
    assert plan.write_report(report, str(tmp_path / "report"))
    (tmp_path / "file").write_text("x")
    assert not plan.write_report(report, str(tmp_path / "file" / "below"))
    (tmp_path / "tree.txt").write_text("100644 blob " + "a" * 40 + "\tdocs/one two.md\n040000 tree " + "b" * 40 + "\tdocs\n120000 blob " + "c" * 40 + "\tlink\n")
    assert {tuple(r) for r in readers.git_tree(spark, str(tmp_path / "tree.txt")).collect()} == {("docs/one two.md", "a" * 40, "100644"), ("link", "c" * 40, "120000")}
    kinds = lambda changed, said: snapshot.commit_message(False, spark.createDataFrame([(p,) for p in changed], "path string"), spark.createDataFrame([(p,) for p in said], "path string")).first()["kind"]
    assert [kinds(["a.md"], ["b.md"]), kinds([], ["b.md"]), kinds(["a.md"], []), kinds(["a.comments.md"], [])] == ["suggested", "index", "update", "comments"]


def test_block_trees_are_walked_in_order(spark, tmp_path):
    """Listings of a page and of a block in it; a child page is not descended."""
    block = lambda id_, kind, parent, children: {"id": id_, "type": kind, "parent": parent, "has_children": children}
    (tmp_path / "page.json").write_text(json.dumps([block("A-1", "paragraph", {"page_id": "P"}, False), block("A-2", "toggle", {"page_id": "P"}, True), block("A-3", "child_page", {"page_id": "P"}, True)]))
    (tmp_path / "below.json").write_text(json.dumps([block("B-1", "paragraph", {"block_id": "A-2"}, False), block("B-2", "paragraph", {"block_id": "A-2"}, False)]))
    found = readers.block_tree(spark, str(tmp_path))
    assert {r["id"]: (r["parent_id"], r["ord"], r["descend"]) for r in found.collect()} == {"a1": ("p", 0, False), "a2": ("p", 1, True), "a3": ("p", 2, False), "b1": ("a2", 0, False), "b2": ("a2", 1, False)}
    nodes = found.select("id", F.when(F.col("parent_id") != "p", F.col("parent_id")).alias("parent_id"), "ord", F.col("id").alias("name"))
    assert [r["path"] for r in tree.walk(nodes).orderBy("sort").collect()] == ["a1", "a2", "a2/b1", "a2/b2", "a3"]


def test_a_hunk_of_one_block_a_side_needs_no_tokens(monkeypatch):
    """most hunks are one edited block, or blocks of one side only."""
    monkeypatch.setattr(diff, "tokens", lambda text: 1 / 0)
    assert diff.pair_hunk([("p", "a b")], [("p", "c")]) == {0: 0}
    assert diff.pair_hunk([("p", "a b")], [("h", "a b")]) == diff.pair_hunk([("p", "a b"), ("p", "c")], []) == {}
