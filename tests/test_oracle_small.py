"""A few registered queries against their DuckDB oracles on sf0.001."""

import duckdb
import pytest

import __spark_entry__ as E

SF = "/root/testdata/sf0.001"
NAMES = ["fields_core", "conn_ranges", "drill_conn", "drill_filter", "search_spans", "ordinals", "failed_connections"]


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in ("events", "documents"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_matches_oracle(spark, con, name):
    df = E.queries()[name](spark, SF)
    cols = sorted(df.columns)
    got = sorted(tuple(str(r[c]) for c in cols) for r in df.collect())
    cur = con.execute(E.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    want = sorted(tuple(str(row[names.index(c)]) for c in cols) for row in cur.fetchall())
    assert sorted(names) == cols
    assert got == want


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.count() >= 0 and "conn_id" in df.columns
