"""Every registered query of the claim-checking operators against its SQL in DuckDB, on the smallest tables."""

from __future__ import annotations

import glob
import os

import duckdb
import pytest

from evidentia.plans import registry

SF = "/root/testdata/sf0.001"
#: Queries that SQL doesn't express; tests/test_operators.py tests these operators by hand-made rows or brute force.
NO_SQL = {"u2_score_pairs", "u5_two_hop"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for p in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return c


def value(v):
    if v is None or v != v:
        return None
    return round(float(v), 4) if isinstance(v, float) or type(v).__name__ == "Decimal" else str(v)


def test_registered():
    assert set(registry.queries()) - set(registry.oracle_sql()) == NO_SQL
    assert set(registry.oracle_sql()) <= set(registry.queries())


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_equals_sql(spark, con, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = sorted((tuple(value(r[c]) for c in columns) for r in df.collect()), key=repr)
    r = con.sql(registry.oracle_sql()[name])
    assert sorted(r.columns) == columns
    place = [r.columns.index(c) for c in columns]
    assert got == sorted((tuple(value(x[i]) for i in place) for x in r.fetchall()), key=repr)
    assert got


@pytest.mark.parametrize("name", sorted(NO_SQL))
def test_query_without_sql_runs(spark, name):
    df = registry.queries()[name](spark, SF)
    assert len(set(df.columns)) == len(df.columns)
    assert df.count() > 0


def test_score_pairs_takes_every_passage(spark, con):
    got = {r.claim_id for r in registry.queries()["u2_score_pairs"](spark, SF).select("claim_id").distinct().collect()}
    assert got == {r[0] for r in con.sql("select item_id from benchmark where length(text) > 0").fetchall()}
