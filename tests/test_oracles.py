"""Every query with SQL against DuckDB on the smallest tables."""

import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from fathom.plans import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(v):
    if isinstance(v, float):
        return None if v != v else round(v, 9)
    return v.item() if hasattr(v, "item") else v


def rows_of(frame):
    columns = sorted(frame.columns)
    return columns, sorted(str(tuple(plain(v) for v in row)) for row in frame[columns].astype(object).where(frame[columns].notna(), None).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, sf, duck, name):
    got, wanted = QUERIES[name](spark, sf).toPandas(), duck.execute(ORACLES[name]).df()
    assert rows_of(got) == rows_of(wanted)


def test_entry_has_rows(spark):
    assert entry.entry(spark).limit(1).count() == 1


def test_all_oracles_have_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())
