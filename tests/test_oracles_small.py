"""Every registered query against its SQL oracle at sf0.001 (DuckDB)."""

import collections
import os

import pytest

import __spark_entry__ as E

TABLES = ["customer", "orders", "documents", "embeddings", "pages"]
SLOW = {"theme_pipeline", "scatter_data", "pipeline_invariants", "density_cluster", "density_planted", "harvest_states", "harvest_rate"}


@pytest.fixture(scope="module")
def duck(small_dir):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{os.path.join(small_dir, t + '.parquet')}')")
    return con


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return collections.Counter(tuple(r[i] for i in order) for r in rows)


@pytest.mark.parametrize("name", sorted(k for k in E.oracle_sql() if k not in SLOW))
def test_query_matches_oracle(spark, duck, small_dir, name):
    df = E.queries()[name](spark, small_dir)
    cur = duck.execute(E.oracle_sql()[name])
    ocols = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, [tuple(r) for r in df.collect()]) == _rows(ocols, cur.fetchall())


def test_entry_runs(spark):
    out = E.entry(spark)
    assert out.count() > 0
    assert {"cluster", "cluster_name", "dim_x", "dim_y"} <= set(out.columns)
