"""Exact dedup under collisions, and the n-gram join against brute force."""

import itertools
import random
import re

import numpy as np
import pytest

from doclens.llm import common, exact_dedup as dedup_module, ngram_join
from doclens.llm.common import Bloom, Scratch
from doclens.llm.exact_dedup import Memtable, compact, exact_dedup, flush_runs, keep_first, digest_of, partnered
from doclens.llm.ngram_join import Join, connected_components, keep_representatives


def test_memtable_flushes_sorted_runs():
    table = Memtable(2)
    for digest, n, id_ in ((b"b" * 32, 3, 9), (b"a" * 32, 3, 5), (b"b" * 32, 4, 11), (b"b" * 32, 4, 10)):
        table.add(digest, n, id_)
    assert table.full()
    run = table.flush("r").to_pylist()
    assert [r["digest"][:1] for r in run] == [b"a", b"b"]
    assert (run[1]["id"], run[1]["n_points"], run[1]["members"]) == (10, 4, 3)
    assert not table.entries
    assert run[1]["filter"] is None
    assert Bloom.from_bytes(run[0]["filter"]).hit(np.array([r["key"] for r in run], np.int64)).all()


def test_compaction_by_levels(spark):
    """Runs of seven digests, merged three at a time: several levels, the same index; unique entries stay behind."""
    rng = random.Random(5)
    rows = [(i, f"text {rng.randint(0, 150)}" + " " * rng.randint(0, 2)) for i in range(260)]
    d = spark.createDataFrame(rows, "id long, text string").repartition(4)
    scratch = Scratch(spark, "t")
    runs = scratch.table(flush_runs(d, "id", "text", 7, digest_of), "runs")
    assert runs.where("filter is not null").count() > 27
    assert partnered(runs).count() < runs.count()
    groups = {}
    for i, text in rows:
        groups.setdefault(text.replace(" ", ""), []).append((-len(text), i))
    expected = sorted((min(g)[1], -min(g)[0], len(g)) for g in groups.values() if len(g) > 1)
    for fan_in, range_rows in ((3, 20), (1000, 1000)):
        found = compact(runs, scratch, fan_in, range_rows).collect()
        assert sorted((r["best_id"], r["best_points"], r["members"]) for r in found) == expected


def expected_dedup(rows):
    groups = {}
    for id_, text in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", text or ""), []).append((-len(text or ""), id_))
    return {id_: (min(g)[1], len(g), min(g)[1] == id_) for g in groups.values() for _, id_ in g}


@pytest.mark.parametrize(("bits", "small"), [(None, False), (1, False), (0, False), (None, True)])
def test_dedup_verifies_bytes(spark, monkeypatch, bits, small):
    """bits: digests cut to that many bytes, so that different texts collide. small: nothing is sent to every task."""
    if small:
        monkeypatch.setattr(common, "BLOOM_MOST_KEYS", 0)
        monkeypatch.setattr(dedup_module, "BROADCAST_ENTRIES", 0)
    rng = random.Random(4)
    rows = [(i, None if rng.random() < 0.1 else "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 4)))) for i in range(200)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    settings = {} if bits is None else {"digest": lambda b, n=bits: (bytes([len(b) % 2]) if n else b"")}
    found = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup(d, memtable=7, salt_rows=5, **settings).collect()}
    assert found == expected_dedup(rows)
    kept = sorted(r["doc_id"] for r in keep_first(d, memtable=7, salt_rows=5, **settings).collect())
    assert kept == sorted(i for i, (_, _, k) in found.items() if k)


def near_copies(seed, n=120, words=30):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(40)]
    bases = [[rng.choice(vocabulary) for _ in range(rng.randint(1, words))] for _ in range(n // 10)]
    rows = []
    for i in range(n):
        own = list(rng.choice(bases))
        for _ in range(rng.choice((0, 0, 1, 1, 2))):
            own[rng.randrange(len(own))] = rng.choice(vocabulary)
        rows.append((i * 3, rng.choice(("", " ", "A b C d e ")) * (rng.random() < 0.2) + " ".join(own)))
    return [*rows, (1, None), (4, "")]


def brute(rows, n, num):
    sets = {}
    for id_, text in rows:
        w = re.findall("[^\x20\x09-\x0d]+", (text or "").lower())
        sets[id_] = frozenset(zip(*(w[k:] for k in range(n)), strict=False)) if len(w) >= n else frozenset([tuple(w)] if w else [])
    links = {(a, b) for a, b in itertools.combinations(sorted(sets), 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b])}
    parent = {i: i for i in sets}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[max(top(a), top(b))] = min(top(a), top(b))
    return sets, links, {i: top(i) for i in sets}


@pytest.mark.parametrize(("seed", "n", "num"), [(1, 3, 90), (2, 2, 80), (3, 1, 60)])
def test_components_and_links_equal_brute_force(spark, seed, n, num):
    rows = near_copies(seed)
    sets, links, components = brute(rows, n, num)
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    found = Join(d, n, num, 100).components().collect()
    assert {r["id"]: r["component_id"] for r in found} == components
    assert {r["id"]: r["size"] for r in found} == {i: len(s) for i, s in sets.items()}
    every = Join(d, n, num, 100, fragments=3, spanning=False)
    class_of = {r["id"]: r["class_id"] for r in every.classes().collect()}
    got = {(r["a"], r["b"]) for r in every.links().collect()}
    assert got == {tuple(sorted((class_of[a], class_of[b]))) for a, b in links if class_of[a] != class_of[b]}
    kept = {r["doc_id"] for r in keep_representatives(d, n, num, 100).collect()}
    assert kept == {i for i, c in components.items() if i == c}


def test_components_beyond_the_broadcasts(spark, monkeypatch):
    """The same where classes, pairs and filters are too many to be sent to every task, and a class has too many pairs."""
    rows = near_copies(4)
    expected = brute(rows, 2, 80)[2]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for name in ("BROADCAST_CLASSES", "BROADCAST_PAIRS", "SALT_PAIRS"):
        monkeypatch.setattr(ngram_join, name, 2 if name == "SALT_PAIRS" else 0)
    assert {r["id"]: r["component_id"] for r in Join(d, 2, 80, 100).components().collect()} == expected
    monkeypatch.setattr(common, "BLOOM_MOST_KEYS", 0)
    assert {r["id"]: r["component_id"] for r in Join(d, 2, 80, 100).components().collect()} == expected


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + k) for k in range(1, 30)] + [(205, 200)]
    found = {r["node"]: r["component"] for r in connected_components(spark.createDataFrame(edges, "a long, b long"), Scratch(spark, "t")).collect()}
    assert found == {**{i: 0 for i in range(61)}, **{100 + k: 100 for k in range(30)}, 200: 200, 205: 200}
