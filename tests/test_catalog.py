"""Every catalogue query against its SQL on the smallest data, and streams against batch."""

import math

import pytest

from fusegrid.plans import catalog

duckdb = pytest.importorskip("duckdb")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL = catalog.oracle_sql()


@pytest.fixture(scope="session")
def oracle(data_dir):
    con = duckdb.connect()
    for name in TABLES:
        con.sql(f"create view {name} as select * from '{data_dir}/{name}.parquet'")
    return con


def norm(value):
    if isinstance(value, float):
        return None if math.isnan(value) else float(f"{value:.9g}")
    return value


def rows_of(names, rows):
    order = sorted(names)
    at = [list(names).index(n) for n in order]
    return order, sorted(([norm(r[i]) for i in at] for r in rows), key=repr)


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, data_dir, oracle, name):
    df = catalog.queries()[name](spark, data_dir)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    rel = oracle.sql(SQL[name])
    assert got == rows_of(rel.columns, rel.fetchall())


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(SQL)))
def test_runs(spark, data_dir, name):
    df = catalog.queries()[name](spark, data_dir)
    assert df.columns and df.count() > 0


def test_every_query_reads_the_given_tables(spark):
    for name, run in catalog.queries().items():
        with pytest.raises(Exception, match="nonexistent|PATH_NOT_FOUND"):
            run(spark, "/nonexistent").collect()
            pytest.fail(f"{name} reads no table")
