"""Every registered factor query with SQL gives the same rows as DuckDB."""

import duckdb
import pytest

import __spark_entry__ as entry
from grainfield.plans import queries, table_queries, wide_queries

ORACLE = queries.ORACLE | table_queries.ORACLE | wide_queries.ORACLE
TABLES = "region nation customer supplier part orders lineitem events".split()


@pytest.fixture(scope="module")
def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_same_rows(spark, sf_dir, duck, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)
    cur = duck.execute(f"select {', '.join(cols)} from ({ORACLE[name]})")
    assert got == sorted(cur.fetchall(), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
