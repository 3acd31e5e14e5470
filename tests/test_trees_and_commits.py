"""Hashes of folders, differences of written trees, commits of which one wins."""

import random
import shutil
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import functions as F

from doclens.operators import merkle, snapshot
from doclens.streaming.incremental import latest, numbers

TREE = "path string, sha string"


def versions(rng):
    before = {"/".join(rng.choice("abc") for _ in range(rng.randrange(1, 5))) + f"/{n}.md" if n % 9 else f"{n}.md": f"s{n}" for n in range(300)}
    after = {p: (s if rng.random() > 0.02 else f"{s}x") for p, s in before.items() if rng.random() > 0.01}
    return before, after | {"new/deep/file.md": "s"}


def test_folders_differ_where_a_file_does(spark):
    before, after = versions(random.Random(2))
    trees = [spark.createDataFrame(list(x.items()), TREE) for x in (before, after)]
    found = {r["folder"]: r["own"] for r in merkle.changed_folders(*map(merkle.folder_hashes, trees)).collect()}
    moved = {p for p in before.keys() | after.keys() if before.get(p) != after.get(p)}
    above = lambda p: ["/".join(p.split("/")[:k]) for k in range(p.count("/") + 1)]
    assert set(found) == {f for p in moved for f in above(p)}
    assert {f for f, own in found.items() if own} == {above(p)[-1] for p in moved}


def test_hashes_of_odd_trees(spark):
    rows = merkle.folder_hashes(spark.createDataFrame([("a/b.md", None), ("c.md", "1")], TREE)).collect()
    assert sorted((r["folder"], r["files"]) for r in rows) == [("", 2), ("a", 1)]
    one, two = ({r["folder"]: r["own_hash"] for r in merkle.folder_hashes(spark.createDataFrame([("a/b.md", sha)], TREE)).collect()} for sha in (None, ""))
    assert one["a"] != two["a"] and one[""] == two[""] == "0" * 60
    assert merkle.folder_hashes(spark.createDataFrame([], TREE)).collect() == []


def test_a_written_difference_reads_folders_that_differ(spark, tmp_path):
    rng = random.Random(3)
    before, _ = versions(rng)
    after = before | {"a/b/odd.md": "1", "plain.md": "2"}
    paths = [str(tmp_path / x) for x in ("one", "two", "same")]
    for tree, path in zip((before, after, before), paths, strict=True):
        merkle.write_tree(spark.createDataFrame(list(tree.items()), TREE), path)
    assert merkle.same_written_tree(spark, paths[0], paths[2]) and not merkle.same_written_tree(spark, paths[0], paths[1])
    assert merkle.written_diff(spark, paths[0], paths[2]).collect() == []
    # directories that hold neither the top nor a/b are gone, and nobody misses them
    kept = {r[0] for r in spark.createDataFrame([("",), ("a/b",)], "f string").select(merkle.shard_of(F.col("f"))).collect()}
    for path in paths[:2]:
        for shard in Path(path, "files").glob("shard=*"):
            if int(shard.name.split("=")[1]) not in kept:
                shutil.rmtree(shard)
    found = merkle.written_diff(spark, paths[0], paths[1]).collect()
    assert sorted((r["path"], r["old_sha"], r["new_sha"]) for r in found) == [("a/b/odd.md", None, "1"), ("plain.md", None, "2")]


def test_one_of_two_writers_wins(spark, tmp_path):
    folder = str(tmp_path / "table")
    trees = [spark.createDataFrame([(f"{k}.md", "1")], TREE) for k in range(4)]

    def write(tree):
        try:
            return snapshot.commit_snapshot(None, tree, folder, 0)
        except snapshot.Moved:
            return "moved"

    with ThreadPoolExecutor(4) as pool:
        said = list(pool.map(write, trees))
    assert sorted(map(str, said)) == ["True", "moved", "moved", "moved"]
    assert numbers(spark, folder) == [0]
    assert [r["path"] for r in latest(spark, folder).collect()] == [f"{said.index(True)}.md"]
    assert not [p for p in Path(folder).iterdir() if p.name.startswith("_staged")]


def test_a_lost_writer_s_claim_is_finished(spark, tmp_path):
    folder = str(tmp_path / "table")
    tree = spark.createDataFrame([("a.md", "1")], TREE)
    tree.write.parquet(f"{folder}/_staged-lost")
    assert snapshot.create_once(spark, f"{folder}/_claims/0", "_staged-lost")
    assert not snapshot.create_once(spark, f"{folder}/_claims/0", "other")
    try:
        snapshot.commit_snapshot(None, spark.createDataFrame([("b.md", "1")], TREE), folder, 0)
        raise AssertionError
    except snapshot.Moved:
        pass
    assert [r["path"] for r in latest(spark, folder).collect()] == ["a.md"]
    assert snapshot.commit_snapshot(latest(spark, folder), spark.createDataFrame([("b.md", "1")], TREE), folder, 1)
    assert numbers(spark, folder) == [0, 1]
