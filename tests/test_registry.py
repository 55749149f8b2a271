"""Every registered query runs at sf0.001 and its oracle SQL runs in DuckDB."""

import duckdb
import pytest

import __spark_entry__ as E
from tempolens.sources.tables import TABLES

from conftest import SF001

NAMES = sorted(E.queries())


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.columns == ["start_sample", "criteria", "diagram_value"]
    assert df.count() > 0


def test_every_oracle_has_a_query():
    assert set(E.oracle_sql()) <= set(E.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query_runs(spark, name):
    df = E.queries()[name](spark, SF001)
    df.limit(5).collect()
    assert len(df.columns) == len(set(df.columns)), "duplicate output columns"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(E.oracle_sql()))
def test_oracle_columns_match(spark, duck, name):
    rel = duck.execute(E.oracle_sql()[name])
    dcols = sorted(d[0] for d in rel.description)
    scols = sorted(E.queries()[name](spark, SF001).columns)
    assert dcols == scols
