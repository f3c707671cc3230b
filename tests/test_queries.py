"""Every query with SQL against DuckDB, on the smallest tables."""

from pathlib import Path

import duckdb
import pytest

from annulus.plans.catalog import oracle_sql, queries

DATA = Path("/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def tables():
    con = duckdb.connect()
    for p in DATA.glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    return con


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_query_equals_sql(spark, tables, name):
    df = queries()[name](spark, str(DATA))
    found = tables.execute(oracle_sql()[name])
    names = [c[0] for c in found.description]
    assert sorted(df.columns) == sorted(names)
    ours = sorted(tuple(str(r[c]) for c in sorted(names)) for r in df.collect())
    at = {c: i for i, c in enumerate(names)}
    theirs = sorted(tuple(str(r[at[c]]) for c in sorted(names)) for r in found.fetchall())
    assert ours == theirs


@pytest.mark.parametrize("name", sorted(set(queries()) - set(oracle_sql()) - {"realign_pipeline"}))
def test_other_queries_give_rows(spark, name):
    assert queries()[name](spark, str(DATA)).count() > 0
