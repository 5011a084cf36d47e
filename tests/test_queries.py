"""Every query against its SQL on the smallest tables, where they are present."""

import math
import os

import duckdb
import pytest

from tallyforge import plans

DIR = os.environ.get("TALLYFORGE_DATA", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no tables")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in os.listdir(DIR):
        c.sql(f"create view {t.removesuffix('.parquet')} as select * from '{DIR}/{t}'")
    return c


def plain(v):
    return None if isinstance(v, float) and math.isnan(v) else repr(round(v, 9)) if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(plans.QUERIES))
def test_query(spark, con, name):
    df = plans.QUERIES[name](spark, DIR)
    cols = sorted(df.columns)
    got = sorted(tuple(map(plain, r)) for r in df.select(*[f"`{c}`" for c in cols]).collect())
    if name not in plans.ORACLE_SQL:
        assert len(df.columns) > 0
        return
    r = con.sql(plans.ORACLE_SQL[name])
    assert sorted(r.columns) == cols
    assert got == sorted(tuple(plain(row[r.columns.index(c)]) for c in cols) for row in r.fetchall())
