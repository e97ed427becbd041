"""Every registered query of the library against its SQL on the smallest tables."""

import glob
import os

import duckdb
import pytest

from tidemark.plans import registry

SF = "/root/testdata/sf0.001"


def plain(v):
    return round(v, 6) if isinstance(v, float) else [plain(x) for x in v] if isinstance(v, list | tuple) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM read_parquet('{p}')")
    return con


@pytest.mark.parametrize("name", registry.queries())
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    got = sorted(repr(plain(tuple(r))) for r in df.collect())
    if name not in registry.oracle_sql():
        assert got
        return
    cur = duck.execute(registry.oracle_sql()[name])
    cols = [c[0] for c in cur.description]
    assert sorted(cols) == sorted(df.columns)
    assert got == sorted(repr(plain([r[cols.index(c)] for c in df.columns])) for r in cur.fetchall())


def test_periods_of_all_orders_take_part(spark):
    found = registry.queries()["interval_join_whole"](spark, SF)
    events, orders = spark.read.parquet(f"{SF}/events.parquet").count(), spark.read.parquet(f"{SF}/orders.parquet").count()
    # An event is in three of the periods on average, and a period is 1 to 5 steps long, so no range of ids stays out.
    assert 2.5 * events < found.count() < 3.5 * events
    assert found.selectExpr(f"floor(p * 10 / {orders}) as tenth").distinct().count() == 10 and found.select("p").distinct().count() > orders / 2
