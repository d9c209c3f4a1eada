"""Every registered query beside its SQL, on the smallest driver tables."""

import datetime
import decimal
import math
import os

import pytest

import __spark_entry__ as entry

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
NAMES = sorted(entry.oracle_sql())
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="no driver tables here")


@pytest.fixture(scope="module")
def duck():
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float | decimal.Decimal) and not isinstance(v, bool):
        v = float(v)
        return "null" if math.isnan(v) else f"{v:.9g}"
    if isinstance(v, datetime.datetime) and v.time() == datetime.time():
        v = v.date()
    return "null" if v is None else f"{float(v):.9g}" if isinstance(v, int) and not isinstance(v, bool) else str(v)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_its_sql(spark, duck, name):
    got, want = entry.queries()[name](spark, DIR), duck.sql(entry.oracle_sql()[name])
    columns = sorted(got.columns)
    assert columns == sorted(want.columns)
    order = ", ".join(f'"{c}"' for c in columns)
    mine = sorted(tuple(plain(r[c]) for c in columns) for r in got.collect())
    theirs = sorted(tuple(map(plain, r)) for r in want.select(order).fetchall())
    assert mine == theirs


def test_entry(spark):
    assert entry.entry(spark).count() > 0
