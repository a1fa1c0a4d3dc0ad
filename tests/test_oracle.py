"""Every registered query equals its DuckDB oracle on the sf0.001 tables
(row count, column names, order-insensitive value hash)."""

import pytest

import __spark_entry__ as entry
from compare import digest, duck
from conftest import SF_SMALL
from evolve.queries import QUERIES

NAMES = sorted(QUERIES)


@pytest.fixture(scope="module")
def con():
    return duck(SF_SMALL)


def test_every_query_has_an_oracle():
    missing = [n for n in NAMES if n not in entry.oracle_sql()]
    assert missing == []


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF_SMALL)
    cols = df.columns
    rows = [tuple(r) for r in df.collect()]
    cur = con.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in cur.description]
    d_rows = cur.fetchall()
    assert sorted(cols) == sorted(d_cols)
    assert len(rows) == len(d_rows)
    assert digest(rows, cols) == digest(d_rows, d_cols)


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0


def test_entry_schema_is_stable(spark):
    assert entry.entry(spark).schema == entry.entry(spark).schema
    assert [f.name for f in entry.entry(spark).schema] == ["target_id", "latest_version", "mismatches", "failing"]
