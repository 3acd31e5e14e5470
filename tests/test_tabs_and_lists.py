"""Directories of tabs, what becomes of them in a plan, ignore lists of several roots."""

import pytest

from doclens.operators import plan, tree

ROOTS = "root_ord int, root_path string, source string, read_only boolean, suggest boolean"
CHANGES = "ord int, status string, path string, previous_path string, has_head boolean, own_id string"
INDEX = "path string, type string, read_only boolean, ref string"


def test_tab_paths(spark):
    tabs = [("d", "t1", None, 0, "Notes", None), ("d", "t2", None, 1, "notes", None), ("d", "t3", "t1", 0, "Notes", None), ("d", "t4", "t1", 1, "Notes", "Notes.md"), ("d", "t5", "t4", 0, "a/b", None), ("e", "t1", None, 0, "", "old.md"), ("e", "", None, 1, "no id", None), ("e", "x", "", 0, "below none", None), ("f#1", "t", None, None, None, None)]
    found = tree.tab_paths(spark.createDataFrame(tabs, "doc_id string, tab_id string, parent_tab string, index int, title string, kept string"), spark.createDataFrame([("d", "D"), ("e", "x/E"), ("f#1", "F")], "doc_id string, directory string"))
    assert {(r["doc_id"], r["tab_id"]): r["path"] for r in found.collect()} == {
        ("d", "t1"): "D/Notes.md",
        ("d", "t2"): "D/notes (2).md",
        ("d", "t3"): "D/Notes/Notes (2).md",
        ("d", "t4"): "D/Notes/Notes.md",
        ("d", "t5"): "D/Notes/Notes/a-b.md",
        ("e", "t1"): "x/E/untitled.md",
        ("f#1", "t"): "F/untitled.md",
    }
    assert tree.tab_paths(spark.createDataFrame([], "doc_id string, tab_id string, parent_tab string, index int, title string, kept string"), spark.createDataFrame([], "doc_id string, directory string")).collect() == []


@pytest.fixture(scope="module")
def roots(spark):
    return spark.createDataFrame([(0, "a/", "gdocs", False, False), (1, "b/", "gdocs", True, None), (2, "c/", "gdocs", None, True)], ROOTS)


@pytest.fixture(scope="module")
def index(spark):
    rows = [("a/D/", "gdoc", False, "gdocs:D"), ("a/D/x.md", "gdoc", False, "gdocs:D#x"), ("a/D/x/y.md", "gdoc", False, "gdocs:D#y"), ("b/E/", "gdoc", False, "gdocs:E"), ("b/E/x.md", "gdoc", False, "gdocs:E#x"), ("c/F/", "gdoc", False, "gdocs:F"), ("c/F/x.md", "gdoc", False, "gdocs:F#x"), ("a/plain.md", "gdoc", False, "gdocs:P"), ("a/G/z.md", "gdoc", False, "gdocs:G#z")]
    return spark.createDataFrame(rows, INDEX)


@pytest.mark.parametrize(
    ("changes", "expected"),
    [
        ([("D", "a/D/x.md", None), ("D", "a/D/x/y.md", None)], {("root", "deleted", 0, "a/D/", None, None)}),
        ([("D", "a/D/x.md", None)], {("refused", None, None, "a/D/x.md", None, "a tab of a/D/")}),
        ([("R100", "a/N/x.md", "a/D/x.md"), ("R080", "a/N/x/y.md", "a/D/x/y.md")], {("root", "renamed", 0, "a/N/", "a/D/", None), ("root", "modified", 0, "a/N/x/y.md", None, None)}),
        ([("R100", "a/N/x.md", "a/D/x.md"), ("R100", "a/M/x/y.md", "a/D/x/y.md")], {("refused", None, None, "a/D/x.md", None, "a tab of a/D/"), ("refused", None, None, "a/D/x/y.md", None, "a tab of a/D/")}),
        ([("R100", "a/N/z.md", "a/D/x.md"), ("R100", "a/N/x/y.md", "a/D/x/y.md")], {("refused", None, None, "a/D/x.md", None, "a tab of a/D/"), ("refused", None, None, "a/D/x/y.md", None, "a tab of a/D/")}),
        ([("R100", "free/x.md", "a/D/x.md"), ("R100", "free/x/y.md", "a/D/x/y.md")], {("refused", None, None, "a/D/x.md", None, "a tab of a/D/"), ("refused", None, None, "a/D/x/y.md", None, "a tab of a/D/")}),
        # inside its directory a tab is renamed like any file; other roots and documents without a directory have their own rules
        ([("R100", "a/D/w.md", "a/D/x.md")], {("root", "renamed", 0, "a/D/w.md", "a/D/x.md", None)}),
        ([("D", "b/E/x.md", None), ("D", "c/F/x.md", None)], {("refused", None, None, "b/E/x.md", None, "read-only root"), ("refused", None, None, "c/F/x.md", None, "suggest root")}),
        ([("D", "a/G/z.md", None), ("M", "a/plain.md", None)], {("root", "deleted", 0, "a/G/z.md", None, None), ("root", "modified", 0, "a/plain.md", None, None)}),
    ],
)
def test_plans_of_tab_directories(spark, roots, index, changes, expected):
    rows = spark.createDataFrame([(n, *c, True, None) for n, c in enumerate(changes)], CHANGES)
    found = plan.plan_changes(rows, roots, index).collect()
    assert {(r["disposition"], r["kind"], r["root_ord"], r["path"], r["previous_path"], r["reason"]) for r in found} == expected and len(found) == len(expected)


def test_a_tab_is_refused_first(spark, roots, index):
    rows = spark.createDataFrame([(0, "M", ".doclens/index", None, False, None), (1, "D", "a/D/x.md", None, None, None)], CHANGES)
    assert plan.first_refusal(plan.plan_changes(rows, roots, index)).first()["reason"] == "a tab of a/D/"


def test_ignore_lists_of_roots(spark):
    lists = [(0, "notion:" + "f" * 32, ["Archive/**", "!Archive/2024/", "!Archive/2024/**", "", "# x"]), (1, "notion:" + "e" * 32, ["Archive/**", "!Archive/2024/**"]), (2, "notion:" + "d" * 32, ["notion:" + "a" * 32, "!**"]), (3, "notion:" + "c" * 32, None), (4, "notion:" + "b" * 32, ["Caf\u00e9/", "[ab].md", "x?/**/z"]), (5, "gdocs:1ABCDEFGHIJKLMNOPQRSTUVWXYZ-7", ["**"])]
    rows = [(0, "Archive/2023/x.md", "n:1", None, True), (0, "Archive/2024/x.md", "n:1", None, False), (1, "Archive/2024/x.md", "n:1", None, True), (2, "Archive/2023/x.md", "n:1", ["n:2"], False), (2, "q.md", "notion:" + "a" * 32, None, True), (2, "q.md", "n:1", ["n:2", "notion:" + "a" * 32], True), (3, "q.md", "n:1", None, False), (4, "Cafe\u0301/deal.md", "n:1", None, True), (4, "b.md", None, None, True), (4, "s/b.md", None, None, True), (4, "xy/k/z", None, None, True), (4, "c.md", None, None, False), (5, "any/x.md", "n:1", None, True), (5, "any", "gdocs:1ABCDEFGHIJKLMNOPQRSTUVWXYZ-7", None, False), (5, ".", "n:1", None, False), (5, None, "n:1", None, False), (9, "no list", "n:1", None, False)]
    found = tree.ignored_paths(spark.createDataFrame([r[:4] for r in rows], "root_ord int, path string, ref string, ancestors array<string>"), spark.createDataFrame(lists, "root_ord int, ref string, ignore array<string>")).collect()
    key = lambda r: (r[0], r[1] or "", r[2] or "", r[3] or [])
    assert [(r["path"], r["ignored"]) for r in sorted(found, key=key)] == [(r[1], r[4]) for r in sorted(rows, key=key)]
