"""Each registered query against its SQL on the smallest data."""

import duckdb
import pandas as pd
import pytest

import __spark_entry__
from facelake.plans.catalogue import ORACLE_SQL, QUERIES

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def rows(frame: pd.DataFrame) -> list[tuple]:
    frame = frame[sorted(frame.columns)].astype(object).where(frame.notna(), None)
    return sorted(frame.itertuples(index=False, name=None), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_sql(spark, duck, name):
    assert rows(QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(ORACLE_SQL[name]).df())


def test_embedding_of_synthetic_images(spark):
    found = QUERIES["embed_seeded"](spark, DATA).toPandas()
    assert len(found) == 500 and set(found["dim"]) == {1024} and set(found["status"]) == {"ok"}


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() == 5


def test_sql_names_are_query_names():
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
