import duckdb
import pytest

from colonnade import queries

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def oracle(sf):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf}/{t}.parquet')")
    return con


def cells(frame):
    frame = frame[sorted(frame.columns)].astype(object)
    return list(frame.columns), sorted(map(str, frame.where(frame.notna(), None).values.tolist()))


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_against_sql(spark, sf, oracle, name):
    assert cells(queries.QUERIES[name](spark, sf).toPandas()) == cells(oracle.sql(queries.ORACLE_SQL[name]).df())


def test_flagship_and_ann(spark, sf):
    assert queries.flagship(spark, sf).count() > 0
    assert queries.vec_ann(spark, sf).first().vec_id == 0
