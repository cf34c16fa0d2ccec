"""Every query with SQL against DuckDB on the smallest tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from tessel import catalog

SF = "/root/testdata/sf0.001"
QUERIES, ORACLES = catalog.queries(), catalog.oracle_sql()


def norm(v):
    if isinstance(v, bool) or v is None:
        return v
    if isinstance(v, (float, decimal.Decimal)):
        return None if math.isnan(v) else round(float(v), 4)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return [norm(x) for x in v]
    return v


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        c.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_sql(spark, duck, name):
    df = QUERIES[name](spark, SF)
    got = duck.execute(ORACLES[name])
    names = [x[0] for x in got.description]
    assert sorted(df.columns) == sorted(names)
    want = sorted(repr([norm(r[names.index(c)]) for c in sorted(names)]) for r in got.fetchall())
    assert sorted(repr([norm(r[c]) for c in sorted(names)]) for r in df.collect()) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_top_k_below_lookup(spark, capsys):
    """The page is cut before authors are joined, without a sort of the whole table, and the
    page is what is broadcast; the filter reaches the scan."""
    QUERIES["list_page"](spark, SF).explain()
    plan = capsys.readouterr().out
    assert "TakeOrderedAndProject" in plan and "BuildRight" in plan and "Sort " not in plan
    assert "EqualTo(o_orderstatus,O)" in plan
