"""Every registered query of the listings library against its SQL twin on the smallest tables."""

import os

import duckdb
import pytest

from marquee.plans import demo

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET timezone = 'UTC'")
    for f in os.listdir(SF):
        con.sql(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def canonical(frame):
    def cell(v):
        if v is None or v != v:
            return ""
        if isinstance(v, float):
            return f"{v:.6f}".rstrip("0").rstrip(".")
        return str(v)

    columns = sorted(frame.columns)
    return columns, sorted(tuple(cell(v) for v in row) for row in frame[columns].astype(object).itertuples(index=False))


@pytest.mark.parametrize("name", sorted(demo.SQL))
def test_query(spark, duck, name):
    assert canonical(demo.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(demo.SQL[name]).df())


def test_queries_without_sql(spark):
    for name in set(demo.QUERIES) - set(demo.SQL):
        assert demo.QUERIES[name](spark, SF).count() > 0


def test_replayed_streams_stay_out_of_the_driver(spark):
    """The rows of a stream are read back from files, not collected in a memory table."""
    assert demo.QUERIES["stream_exclusion_ttl"](spark, SF).inputFiles()
