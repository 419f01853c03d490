"""Every registered query of section 2 gives the rows of its SQL, on the smallest tables."""

import datetime as dt
import decimal
import math
import os

import duckdb
import pytest

from assayflow.plans.queries import ORACLES, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    return con


def plain(v):
    """A value of either engine in one spelling."""
    if isinstance(v, list):
        return tuple(map(plain, v))
    if isinstance(v, decimal.Decimal):
        v = float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 6) + 0.0
    return v.replace(tzinfo=None) if isinstance(v, dt.datetime) else v


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the driver's tables are not here")
@pytest.mark.parametrize("name", sorted(QUERIES))
def test_rows(spark, duck, name):
    df, other = QUERIES[name](spark, DATA), duck.execute(ORACLES[name])
    columns = [c[0] for c in other.description]
    assert sorted(df.columns) == sorted(columns)
    own = sorted((tuple(plain(r[c]) for c in columns) for r in df.select(*columns).collect()), key=str)
    assert own == sorted((tuple(map(plain, r)) for r in other.fetchall()), key=str)


def test_all_have_sql():
    assert set(QUERIES) == set(ORACLES)
