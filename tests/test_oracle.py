"""Differential tests: every registered query against its DuckDB oracle."""

import hashlib
import os

import duckdb
import pytest

import __spark_entry__ as ent
from custlens.functions.normalize import double_columns
from custlens.oracle import all_oracles
from custlens.oracle import double_columns as oracle_doubles
from custlens.registry import registry

from .conftest import SF_CHECK, SF_SMALL

TABLES = ["customer", "nation", "supplier", "orders", "lineitem", "events"]


def _canon(v):
    if v is None:
        return "NULL"
    if isinstance(v, float):
        return repr(v + 0.0)
    return v.isoformat() if hasattr(v, "isoformat") else str(v)


def _digest(rows, cols):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    lines = sorted("|".join(_canon(r[i]) for i in order) for r in rows)
    return hashlib.sha1("\n".join(lines).encode()).hexdigest(), lines


def _duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


QUERIES = sorted(registry())


def test_every_query_has_an_oracle():
    assert set(all_oracles()) == set(QUERIES)
    assert set(QUERIES) <= set(ent.queries()) and set(QUERIES) <= set(ent.oracle_sql()) <= set(ent.queries())


@pytest.mark.parametrize("sf_dir", [SF_SMALL, SF_CHECK], ids=["sf0.001", "sf0.01"])
def test_queries_match_oracles(spark, sf_dir):
    if not os.path.exists(sf_dir):
        pytest.skip("test tables absent")
    con = _duck(sf_dir)
    qs, oracles = registry(), all_oracles()
    failures = []
    for name in QUERIES:
        sdf = qs[name](spark, sf_dir)
        assert sorted(double_columns(sdf)) == sorted(oracle_doubles()[name]), name
        srows, scols = [tuple(r) for r in sdf.collect()], sdf.columns
        cur = con.sql(oracles[name])
        orows, ocols = cur.fetchall(), cur.columns
        hs, ls = _digest(srows, scols)
        ho, lo = _digest(orows, ocols)
        if sorted(scols) != sorted(ocols) or hs != ho:
            failures.append((name, sorted(set(ls) - set(lo))[:2], sorted(set(lo) - set(ls))[:2]))
    assert not failures, failures


def test_entry_smoke(spark):
    df = ent.entry(spark)
    assert df.count() > 0
    assert df.columns == ["customer_id", "customer_name", "customer_segment", "recency_days",
                          "frequency", "monetary_value", "rfm_segment"]
