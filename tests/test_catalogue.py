"""Every query of the catalogue against DuckDB on the smallest tables."""

import math
import os

import duckdb
import pytest

from triplane.catalogue import QUERIES, SQL, headline

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for name in os.listdir(FOLDER):
        c.execute(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{FOLDER}/{name}'")
    return c


def plain(x):
    if x is None or isinstance(x, float) and math.isnan(x):
        return "NULL"
    if isinstance(x, bool):
        return str(x)
    return f"{float(x):.9g}" if isinstance(x, (int, float)) or type(x).__name__ == "Decimal" else str(x)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(SQL))
def test_same_rows(spark, duck, name):
    df = QUERIES[name](spark, FOLDER)
    done = duck.execute(SQL[name])
    columns = [d[0] for d in done.description]
    assert sorted(df.columns) == sorted(columns)
    assert table(df.columns, df.collect()) == table(columns, done.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_closures_take_every_customer(spark, duck):
    by = {}
    for o, c, status in duck.execute("SELECT o_orderkey, o_custkey, o_orderstatus FROM orders").fetchall():
        by.setdefault(c, []).append((o, status))
    plus = {(a, b): s for orders in by.values() for a, s in orders for b, _ in orders if a < b}
    ends = {x for pair in plus for x in pair}
    want = {"X6_plus": set(plus), "X6_plus_start": {p for p, s in plus.items() if s == "F"}, "X7_star": set(plus) | {(x, x) for x in ends}}
    for name, pairs in want.items():
        got = [(r["a"], r["b"]) for r in QUERIES[name](spark, FOLDER).collect()]
        assert len(got) == len(pairs) and set(got) == pairs
    assert QUERIES["J6_cartesian"](spark, FOLDER).count() == 5 * 25


def test_orders_return_every_row(spark, duck):
    for name, rows in {"O1_order_desc": "customer", "O5_distinct_ordered": "(SELECT DISTINCT p_brand FROM part)", "O2_order_aggregate": "(SELECT DISTINCT o_custkey FROM orders)"}.items():
        n = duck.execute(f"SELECT count(*) FROM {rows}").fetchone()[0]
        assert sorted(r["pos"] for r in QUERIES[name](spark, FOLDER).collect()) == list(range(1, n + 1))


def test_headline(spark):
    assert headline(spark, FOLDER).count() > 0
