"""Every registered query of the finding dataflow against its SQL, and the contract of the entry module."""

import os

import duckdb
import pytest

import __spark_entry__ as entry_module
from riskloom.plans import code, cpp, extra, jobs, more, nested, prompts, state
from riskloom.plans import queries as own

DATA = "/root/testdata/sf0.001"
PLANS = (own, more, extra, code, jobs, prompts, cpp, state, nested)
QUERIES = {k: v for p in PLANS for k, v in p.QUERIES.items()}
ORACLES = {k: v for p in PLANS for k, v in p.ORACLES.items()}


def norm(v):
    return round(v, 6) if isinstance(v, float) else str(v) if v is not None and not isinstance(v, int | str | bool) else v


def rows(names, values):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted([names[i] for i in order]), sorted((tuple(norm(r[i]) for i in order) for r in values), key=repr)


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for f in os.listdir(DATA):
        c.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    want = duck.sql(ORACLES[name])
    assert rows(df.columns, df.collect()) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_without_sql(spark, name):
    assert QUERIES[name](spark, DATA).columns


def test_contract(spark):
    assert entry_module.entry(spark).count() > 0
    assert set(entry_module.oracle_sql()) <= set(entry_module.queries())
    assert set(QUERIES) <= set(entry_module.queries())


def test_typed_names_are_common(spark):
    """trace_typed searches over names that many methods share, whatever the table's size."""
    methods, calls, *_ = code._typed_tables(spark, "/root/testdata/sf0.01", common=True)
    assert methods.select("name").distinct().count() == 97 == calls.select("callee").distinct().count()
    assert "p_partkey % 97 AS name" in ORACLES["trace_typed"]
