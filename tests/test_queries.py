"""Every registered query against its SQL on the smallest tables; a query without SQL must give rows."""

import glob
import os
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as driver

SMALL = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(SMALL).exists(), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SMALL}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


def plain(value):
    if isinstance(value, float):
        return round(value, 6)
    if isinstance(value, (list, tuple)):
        return [plain(v) for v in value]
    return value


@pytest.mark.parametrize("name", [n for n in driver.queries() if not n.startswith("op") and n != "pipeline"] + [n for n in driver.oracle_sql() if n.startswith("op")])
def test_query(spark, duck, name):
    found = driver.queries()[name](spark, SMALL)
    rows = found.collect()
    sql = driver.oracle_sql().get(name)
    if sql is None:
        assert rows
        return
    answer = duck.execute(sql)
    columns = [c[0] for c in answer.description]
    assert sorted(columns) == sorted(found.columns)
    expected = sorted(repr(tuple(plain(v) for v in r)) for r in answer.fetchall())
    assert sorted(repr(tuple(plain(r[c]) for c in columns)) for r in rows) == expected


def test_entry(spark):
    assert driver.entry(spark).count() > 0


def once(found, step: str) -> bool:
    return found._jdf.queryExecution().executedPlan().toString().count(step) == 1


def test_nested_ops_are_made_once(spark):
    """both sides' ops, and those of parents, come from one pass over the versions."""
    assert once(driver.queries()["nested_diff_cover"](spark, SMALL), "MapInArrow")


def test_replayed_ops_are_made_once(spark):
    """either version is told by the same ops."""
    assert once(driver.queries()["block_diff_replay"](spark, SMALL), "MapInArrow")
