"""Registered queries against the check SQL on the smoke tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from conftest import SMOKE

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# queries of the optional subpackage have tests of their own
QUERIES, SQL = ({k: v for k, v in x.items() if not k.startswith("op") and k != "pipeline"} for x in (entry.queries(), entry.oracle_sql()))


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SMOKE}/{t}.parquet'")
    return con


def test_registration():
    assert set(SQL) <= set(QUERIES) and len(QUERIES) > 180
    assert set(QUERIES) - set(SQL) == {"I8_isolation_forest", "C1_file_hash"}


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, SMOKE)
    names = sorted(got.columns)
    mine = sorted(repr([r[c] for c in names]) for r in got.collect())
    run = duck.execute(SQL[name])
    there = [c[0] for c in run.description]
    assert sorted(there) == names
    assert mine == sorted(repr([r[there.index(c)] for c in names]) for r in run.fetchall())
