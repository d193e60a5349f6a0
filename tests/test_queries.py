from __future__ import annotations

import importlib

import duckdb
import pytest

import __spark_entry__ as entry

QUERIES, ORACLE_SQL = {}, {}
for module in map(importlib.import_module, entry.MODULES):
    QUERIES |= module.QUERIES
    ORACLE_SQL |= module.ORACLE_SQL

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations")


def rows_of(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    plain = lambda v: str(int(v)) if isinstance(v, float) and v == int(v) else str(v)
    return sorted(map(tuple, frame.where(frame.notna(), "null").map(plain).values.tolist()))


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_matches_its_sql(spark, sf, name):
    got = QUERIES[name](spark, sf).toPandas()
    assert len(got)
    if name in ORACLE_SQL:
        con = duckdb.connect()
        for table in TABLES:
            con.execute(f"create view {table} as select * from '{sf}/{table}.parquet'")
        want = con.execute(ORACLE_SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows_of(got) == rows_of(want)
