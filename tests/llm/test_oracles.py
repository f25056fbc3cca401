"""Queries that SQL can express, against DuckDB on the same tables."""

import duckdb
import pytest

from custlens.llm import queries

from .conftest import SF_CHECK


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_query_equals_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "embeddings"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_CHECK}/{t}.parquet')")
    want = con.sql(queries.oracle_sql()[name])
    columns = sorted(want.columns)
    got = queries.queries()[name](spark, SF_CHECK)
    assert sorted(got.columns) == columns
    assert sorted(map(str, (tuple(r[c] for c in columns) for r in got.collect()))) == sorted(
        map(str, want.project(", ".join(columns)).fetchall()))


def test_every_operator_is_registered_once():
    names = list(queries.queries())
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 14))
