"""Every registered query of the plans against its SQL twin on sf0.001."""

import math

import duckdb
import pytest

from novelspark.plans import PLANS

DIR = "/root/testdata/sf0.001"
NAMES = [(plan, name) for plan in PLANS for name in plan.QUERIES]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("documents", "embeddings", "events", "orders", "pages"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


@pytest.mark.parametrize(("plan", "name"), NAMES, ids=[n for _, n in NAMES])
def test_equals_sql(spark, con, plan, name):
    df = plan.QUERIES[name](spark, DIR)
    got = sorted(tuple(map(plain, r)) for r in df.collect())
    if name not in plan.SQL:
        assert got
        return
    cursor = con.execute(plan.SQL[name])
    columns = [c[0] for c in cursor.description]
    assert sorted(columns) == sorted(df.columns)
    at = [columns.index(c) for c in df.columns]
    assert got == sorted(tuple(plain(r[i]) for i in at) for r in cursor.fetchall())
