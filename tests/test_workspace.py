"""The verbs, and files of documents."""

from pyspark.sql import functions as F

from doclens.operators import assets
from doclens.plans.workspace import Workspace

A, B = "a" * 20, "b" * 20
SPEC = "ord int, spec string, read_only boolean, suggest boolean"
OBJECT = "source string, id string, title string, container boolean, ext string"


def test_roots_come_and_go(spark):
    objects = spark.createDataFrame([("gdocs", A, "Team", True, ".md"), ("gdocs", B, "Plan", False, ".md")], OBJECT)
    ws, problems = Workspace.create(spark).add(spark.createDataFrame([(0, f"gdocs:{A}=docs", False, False), (1, f"https://docs.google.com/document/d/{B}/edit=notes/", False, True)], SPEC), objects)
    assert problems.isEmpty()
    assert [r["root_path"] for r in ws.roots.orderBy("root_ord").collect()] == ["docs/", "notes/Plan.md"]
    same, problems = ws.add(spark.createDataFrame([(0, f"gdocs:{B}=docs/x.md", None, None)], SPEC), objects)
    assert same is ws
    assert [r["problem"] for r in problems.collect()] == ["overlaps root 0"]
    _, problems = ws.add(spark.createDataFrame([(0, "gdocs:short", None, None), (1, f"gdocs:{'c' * 20}", None, None), (2, "what", None, None)], SPEC), objects)
    assert {r["problem"] for r in problems.collect()} == {"not a file id", "no such object", "not a reference"}
    left = ws.remove(spark.createDataFrame([(f"gdocs:{A}",)], "name string"))
    assert [r["root_path"] for r in left.roots.collect()] == ["notes/Plan.md"]
    assert ws.check().isEmpty()


def test_fetch_and_status(spark):
    roots = spark.createDataFrame([(0, "gdocs", A, "docs/", False, False), (1, "gdocs", B, "sug/", False, True)], "root_ord int, source string, id string, root_path string, read_only boolean, suggest boolean")
    row = "id string, path string, time string, md5 string"
    ws = Workspace(roots)
    one = spark.createDataFrame([("1", "docs/a.md", "t1", None), ("2", "docs/b.md", "t1", None), ("3", "sug/c.md", "t1", None)], row)
    ws, read = ws.fetch(one)
    assert read.count() == 3
    two = spark.createDataFrame([("1", "docs/a.md", "t2", None), ("3", "sug/c.md", "t1", None), ("4", "docs/d.md", "t1", None)], row)
    assert {(r["id"], r["change"]) for r in ws.changes(two).collect()} == {("1", "modified"), ("4", "added"), ("3", "re-read")}
    assert {r["root_path"]: (r["changed"], r["gone"]) for r in ws.status(two).collect()} == {"docs/": (2, 1), "sug/": (1, 0)}
    assert ws.changes(one, everything=True).count() == 3
    # of all that is read again, only what somebody edited says so
    assert {(r["id"], r["change"]) for r in ws.changes(two, everything=True).collect()} == {("1", "modified"), ("3", "re-read"), ("4", "added")}


def test_assets(spark):
    row = "id string, path string, mark string"
    now = spark.createDataFrame([("1", "a", "x"), ("2", "b", "x"), ("3", "c", "y"), ("4", "d", None)], row)
    old = spark.createDataFrame([("1", "a", "x"), ("2", "z", "x"), ("3", "c", "x")], row)
    assert {r["id"] for r in assets.moved_assets(now, old).collect()} == {"2", "3", "4"}
    files = spark.createDataFrame([("notion", 6 << 30, "image/png"), ("gdocs", 1, "text/plain"), ("gdocs", 6 << 20, "image/png"), ("gdocs", 5, "image/png"), ("notion", 0, "a/b")], "source string, size long, mime string")
    assert [r["v"] for r in files.select(assets.upload_verdict(F.col("source"), F.col("size"), F.col("mime")).alias("v")).collect()] == ["too large for a block", "a text document takes images only", "too large for an image", None, "empty file"]
    links = spark.createDataFrame([("x/a.md", "1", "u1"), ("x/a.md", "9", "u9")], "path string, target_id string, url string")
    assert {r["target_id"]: r["href"] for r in assets.resolve_links(links, spark.createDataFrame([("1", "y/b.md")], "id string, path string")).collect()} == {"1": "../y/b.md", "9": "u9"}
    index = spark.createDataFrame([("d1", None, "gdoc", "d.md"), ("i1", "d1", "asset", "d.assets/i"), ("d1#t.1", None, "gdoc", "d/t.md"), ("d2", None, "gdoc", "e.md")], "id string, document string, type string, path string")
    assert {r["path"] for r in assets.carry_over(spark.createDataFrame([("d1",)], "id string"), index).collect()} == {"d.md", "d.assets/i", "d/t.md"}
    made = assets.assets_of(spark.createDataFrame([("d1", "d.assets/new")], "document string, path string"), index, spark.createDataFrame([("d.assets/i",)], "path string"))
    assert [r["assets"] for r in made.collect()] == [["d.assets/new"]]


def test_roots_are_numbered_on(spark):
    """Three additions, one root each: numbers 0, 1, 2."""
    objects = spark.createDataFrame([("gdocs", f"{k}" * 30, f"T{k}", True, None) for k in range(3)], "source string, id string, title string, container boolean, ext string")
    work = Workspace.create(spark)
    for k in range(3):
        specs = spark.createDataFrame([(0, f"gdocs:{str(k) * 30}", False, False)], "ord int, spec string, read_only boolean, suggest boolean")
        work, problems = work.add(specs, objects)
        assert problems.isEmpty()
    assert sorted(r["root_ord"] for r in work.roots.collect()) == [0, 1, 2]
