"""Every query with SQL against DuckDB on the smallest data, and the driver's contract."""

import os

import pandas as pd
import pytest

import __spark_entry__ as entry

CORE = [k for k in entry.queries() if not entry.queries()[k].__module__.startswith("quire.llm")]


def rows(frame):
    def plain(v):
        return None if v is None or v is pd.NaT or v is pd.NA or v != v else f"{float(v):.9g}" if isinstance(v, (int, float)) and not isinstance(v, bool) else str(v)

    frame = frame[sorted(frame.columns)]
    return list(frame.columns), sorted((tuple(map(plain, r)) for r in frame.itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck(small):
    import duckdb

    con = duckdb.connect()
    for name in os.listdir(small):
        con.sql(f"CREATE VIEW {name.split('.')[0]} AS SELECT * FROM '{small}/{name}'")
    return con


def test_contract(spark, small):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", CORE)
def test_query(spark, small, duck, name):
    found = entry.queries()[name](spark, small).toPandas()
    sql = entry.oracle_sql().get(name)
    if sql:
        assert rows(found) == rows(duck.sql(sql).df())
    else:
        assert len(found) > 0
