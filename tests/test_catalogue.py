"""Every query with SQL equals DuckDB on the small tables; every other one runs."""

import glob
import os

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as entry
from tests.conftest import DATA

pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test data here")

GENERAL = {n: q for n, q in __import__("tidemark.plans", fromlist=["catalogue"]).catalogue().items()}


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("set timezone='UTC'")
    for p in glob.glob(f"{DATA}/*.parquet"):
        con.sql(f"create view {os.path.basename(p)[:-8]} as select * from '{p}'")
    return con


def norm(frame: pd.DataFrame) -> list:
    def cell(v):
        if hasattr(v, "tolist") and not isinstance(v, (str, bytes)):
            v = v.tolist()
        if v is None or v is pd.NaT or (isinstance(v, float) and v != v):
            return "null"
        if type(v).__name__ == "Decimal":
            v = float(v)
        return repr(v + 0.0) if isinstance(v, float) else str(v)

    frame = frame[sorted(frame.columns)]
    return sorted(tuple(cell(v) for v in r) for r in frame.itertuples(index=False))


@pytest.mark.parametrize("name", sorted(GENERAL))
def test_query(spark, duck, name):
    fn, sql = GENERAL[name]
    df = fn(spark, DATA)
    got = pd.DataFrame([tuple(r) for r in df.collect()], columns=df.columns, dtype=object)
    spark.catalog.clearCache()
    if sql is None:
        return
    rel = duck.sql(sql)
    want = pd.DataFrame(rel.fetchall(), columns=rel.columns, dtype=object)
    assert sorted(got.columns) == sorted(want.columns)
    assert norm(got) == norm(want)


def test_entry_and_contract(spark):
    assert entry.entry(spark).limit(5).count() == 5
    names = set(entry.queries())
    assert set(entry.oracle_sql()) <= names
    assert {f"p{i}_found" for i in range(1, 7)} <= names
