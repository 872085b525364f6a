"""Every registered query with an oracle agrees with DuckDB on sf0.001."""

import duckdb
import pytest

from conftest import SF_SMALL

import __spark_entry__ as entry
from tools.oracle_check import TABLES, _rows

QUERIES = entry.queries()
ORACLES = entry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def test_every_query_has_a_callable():
    assert QUERIES and all(callable(q) for q in QUERIES.values())
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_matches_oracle(spark, con, name):
    sdf = QUERIES[name](spark, SF_SMALL)
    srows = [r.asDict(recursive=True) for r in sdf.collect()]
    con.execute(f"CREATE OR REPLACE VIEW oracle_{name} AS {ORACLES[name]}")   # as the driver's check does
    rel = con.sql(f"SELECT * FROM oracle_{name}")
    orows = [dict(zip(rel.columns, r)) for r in rel.fetchall()]
    assert sorted(sdf.columns) == sorted(rel.columns)
    cols = sorted(sdf.columns)
    assert len(srows) == len(orows)
    assert _rows(cols, srows, 6) == _rows(cols, orows, 6)


def test_entry_smoke(spark):
    df = entry.entry(spark)
    assert df.count() > 0
    assert "Percent_Hours_With_No_Rentals" in df.columns
