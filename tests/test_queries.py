"""Every query with SQL against DuckDB, on the same tables."""

import datetime
import decimal
import math
import os

import duckdb
import pytest

from shelfmark.plans import desired, details, device, filters, matches, names, ordered, reports, saved_rules, streams, upkeep  # noqa: F401
from shelfmark.plans.registry import QUERIES, SQL

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    return c


def plain(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None)
    return v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, name):
    df = QUERIES[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    assert name in SQL
    rel = con.execute(SQL[name])
    names = [d[0] for d in rel.description]
    assert sorted(names) == columns
    at = [names.index(c) for c in columns]
    want = sorted((tuple(plain(r[k]) for k in at) for r in rel.fetchall()), key=str)
    assert len(got) == len(want), (len(got), len(want))
    assert got == want
    kinds = {c: type(v) for r in want for c, v in zip(columns, r, strict=True) if v is not None}
    mine = {c: type(v) for r in got for c, v in zip(columns, r, strict=True) if v is not None}
    assert kinds == mine
