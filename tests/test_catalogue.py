"""Every registered query of the reference's operators against its SQL in DuckDB."""

import duckdb
import pytest

from patchloom.plans.catalogue import ORACLE_SQL, QUERIES, flagship

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS FROM '{DATA}/{name}.parquet'")
    return connection


def rows(frame):
    names = sorted(frame.columns)
    frame = frame[names].astype(object).where(frame[names].notna(), None)
    number = lambda v: float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return names, sorted(repr(tuple(map(number, r))) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_rows_only_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).count() > 0


def test_flagship(spark):
    assert flagship(spark, DATA).count() > 0
