"""Every registered query against its DuckDB oracle on the smallest tables
(the driver runs the same comparison at sf0.01)."""

import datetime as dt
import decimal
import math
import os
from collections import Counter

import duckdb
import pytest

from __spark_entry__ import oracle_sql
from cohortlens.plans.catalog import QUERIES

SF = "/root/testdata/sf0.001"
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 9)
    if isinstance(v, decimal.Decimal):
        return round(float(v), 9)
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{SF}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


ORACLE = oracle_sql()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    if name not in ORACLE:
        pytest.skip("no SQL for this query; see the tests of its operator")
    sdf = QUERIES[name](spark, SF)
    cols = sdf.columns
    rows = sdf.collect()
    rel = duck.sql(ORACLE[name])
    assert sorted(cols) == sorted(rel.columns)
    drows = rel.fetchall()
    order = sorted(cols)
    si = [cols.index(c) for c in order]
    di = [rel.columns.index(c) for c in order]
    sc = Counter(tuple(_norm(r[i]) for i in si) for r in rows)
    dc = Counter(tuple(_norm(r[i]) for i in di) for r in drows)
    assert sc == dc
