"""The corpus queries that have SQL, against it."""

from __future__ import annotations

import duckdb
import pytest

from eventloom.llm import queries as q

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "conversations"):
        con.sql(f"CREATE VIEW {t} AS FROM '{DIR}/{t}.parquet'")
    df = q.queries()[name](spark, DIR)
    cols = sorted(df.columns)
    want = con.sql(q.oracle_sql()[name])
    at = [want.columns.index(c) for c in cols]
    assert sorted(want.columns) == cols
    assert sorted(tuple(r[c] for c in cols) for r in df.collect()) == sorted(tuple(r[i] for i in at) for r in want.fetchall())
