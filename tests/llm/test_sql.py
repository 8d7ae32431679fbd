"""Queries against their SQL in DuckDB on the smallest tables."""

import duckdb
import pytest

from sigseg.llm import queries as Q

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    db = duckdb.connect()
    for t in ("documents", "embeddings", "conversations"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df, got = Q.QUERIES[name](spark, SF), db.sql(Q.ORACLE_SQL[name])
    assert sorted(df.columns) == sorted(got.columns)
    order = [got.columns.index(c) for c in df.columns]
    assert sorted((tuple(r) for r in df.collect()), key=str) == sorted((tuple(r[i] for i in order) for r in got.fetchall()), key=str)
