"""Every registered query that has SQL against DuckDB, on the smallest sample tables."""

import duckdb
import pytest

from tidelog.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf_dir, duck, name):
    df = registry.QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted(repr(tuple(r)) for r in df.select(*cols).collect())
    assert got
    if name in registry.SQL:
        result = duck.execute(registry.SQL[name])
        names = [c[0] for c in result.description]
        assert sorted(names) == cols
        assert got == sorted(repr(tuple(r[names.index(c)] for c in cols)) for r in result.fetchall())


def test_snapshot_plan_pushes_the_key_and_combines_early(spark, sf_dir):
    plan = registry.QUERIES["kv_get"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan and "Window" not in plan
    runs = registry.QUERIES["prefix_scan_page"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "TakeOrderedAndProject" in runs
