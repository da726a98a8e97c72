"""Every query of the engine against its DuckDB equivalent."""

import math

import duckdb
import pytest

from tarnmill.plans.catalogue import ORACLE_SQL, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else str(x)


def test_all_have_an_equivalent():
    assert set(QUERIES) == set(ORACLE_SQL)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_matches_duckdb(spark, sf_dir, con, name):
    df, want = QUERIES[name](spark, sf_dir), con.sql(ORACLE_SQL[name])
    columns = sorted(df.columns)
    assert sorted(want.columns) == columns
    got = sorted(tuple(plain(x) for x in r) for r in df.select(*[f"`{c}`" for c in columns]).collect())
    assert got == sorted(tuple(plain(x) for x in r) for r in want.select(*[duckdb.ColumnExpression(c) for c in columns]).fetchall())
