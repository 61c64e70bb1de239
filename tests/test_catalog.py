"""Every query with SQL gives the rows that DuckDB gives for that SQL."""

import math
import os

import pandas as pd
import pytest

import __spark_entry__
from kinloom import catalog

duckdb = pytest.importorskip("duckdb")
DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for f in os.listdir(DATA):
        c.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return c


def plain(v):
    if v is None or v is pd.NaT or v is pd.NA or isinstance(v, float) and math.isnan(v):
        return None
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, (int, float)) and not isinstance(v, bool):
        return None if isinstance(v, float) and math.isnan(v) else round(float(v), 9)
    return v if isinstance(v, (bool, str)) else float(v) if type(v).__name__ == "Decimal" else str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return list(df.columns), sorted([tuple(map(plain, r)) for r in df.itertuples(index=False)], key=repr)


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_query(spark, duck, name):
    assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == rows(duck.execute(catalog.ORACLES[name]).df())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_query_without_sql_runs_alike_in_any_partitioning(spark, name):
    first = rows(catalog.QUERIES[name](spark, DATA).toPandas())
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    try:
        assert rows(catalog.QUERIES[name](spark, DATA).toPandas()) == first
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() == 2
    assert set(catalog.QUERIES) <= set(__spark_entry__.queries()) and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
