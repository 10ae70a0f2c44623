"""Every registered plan that has SQL, against DuckDB on the same tables."""

import datetime
import math
import os

import duckdb
import pytest

from plenum import plans
from plenum.plans.registry import oracle_sql, queries

SF = os.environ.get("PARITY_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, float):
        return float(f"{value:.9g}")
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None)
    return value


@pytest.mark.parametrize("name", sorted(plans.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    mine = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=repr)
    result = duck.sql(oracle_sql()[name])
    assert sorted(result.columns) == columns
    at = [result.columns.index(c) for c in columns]
    other = sorted((tuple(plain(r[i]) for i in at) for r in result.fetchall()), key=repr)
    assert mine == other
    kinds = {"bigint": "BIGINT", "int": "INTEGER", "string": "VARCHAR", "double": "DOUBLE", "boolean": "BOOLEAN"}
    types = dict(zip(result.columns, map(str, result.types), strict=True))
    assert {c: kinds[t] for c, t in df.dtypes} == types
