"""Every query with SQL gives what DuckDB gives on the same tables."""

import os

import duckdb
import pytest

from tesserae import registry

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        p = f"{DATA}/{t}.parquet"
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{p}{'/*.parquet' if os.path.isdir(p) else ''}'")
    return con


def rows(names, data):
    order = sorted(range(len(names)), key=names.__getitem__)
    show = lambda v: None if v is None else f"{v:.8g}" if isinstance(v, float) else str(v)
    return sorted(str([show(r[i]) for i in order]) for r in data)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_against_sql(spark, duck, name):
    df = registry.queries()[name](spark, DATA)
    want = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in want.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", sorted(registry.queries().keys() - registry.oracle_sql().keys()))
def test_without_sql(spark, name):
    assert registry.queries()[name](spark, DATA).count() > 0
