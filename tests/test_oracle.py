"""Every relational query equals its DuckDB twin (sf0.001), as the driver checks at sf0.01."""

import duckdb
import pytest

import __spark_entry__ as entry
from scripts.check_oracle import TABLES, table_hash
from tests.conftest import SF_SMALL

RELATIONAL = sorted(entry.oracle_sql())


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def test_entry_runs(spark):
    df = entry.entry(spark)
    rows = df.collect()
    assert len(rows) > 0
    assert df.columns == ["screen", "rank", "code", "p_pos_nodrug", "p_pos_drug", "count_outcome_0", "count_outcome_1"]


def test_every_oracle_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", RELATIONAL)
def test_query_matches_oracle(spark, duck, name):
    sdf = entry.queries()[name](spark, SF_SMALL)
    s_rows = [tuple(r) for r in sdf.collect()]
    rel = duck.execute(entry.oracle_sql()[name])
    d_cols = [d[0] for d in rel.description]
    d_rows = rel.fetchall()
    assert sorted(sdf.columns) == sorted(d_cols)
    assert len(s_rows) == len(d_rows)
    assert table_hash(sdf.columns, s_rows)[0] == table_hash(d_cols, d_rows)[0]
