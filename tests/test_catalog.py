"""Every catalog query against DuckDB on the smallest test tables, the entry module, plans, and streams."""

import datetime as dt
import os
import re
from decimal import Decimal

import pytest

import __spark_entry__
from strataq import catalog
from strataq.api import Engine
from strataq.plans.errors import QueryError
from strataq.streaming import stream

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def plain(v):
    if isinstance(v, float):
        return f"{v:.9g}" if v else "0"
    if isinstance(v, Decimal):
        return f"{v:f}"
    return v.isoformat() if isinstance(v, dt.date) else str(v)


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    c = duckdb.connect()
    for t in catalog.TABLES:
        p = f"{DATA}/{t}.parquet"
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{p + '/*.parquet' if os.path.isdir(p) else p}'")
    return c


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_matches_duckdb(spark, duck, name):
    df = catalog.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    got = sorted(tuple(plain(r[c]) for c in columns) for r in df.collect())
    r = duck.sql(catalog.oracle_sql()[name])
    at = [r.columns.index(c) for c in columns]
    assert sorted(r.columns) == columns
    assert got == sorted(tuple(plain(x[i]) for i in at) for x in r.fetchall())


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_plans(spark):
    """Filters and columns reach the scan; a top-n needs no full sort; dependent keys aren't grouped by."""
    plan = lambda sql: catalog.engine(spark, DATA).explain(sql)["plan"]
    p = plan(catalog.SQL["tpch_q6"][0])
    assert "GreaterThanOrEqual(l_shipdate,1996-01-01T00:00)" in p and "LessThan(l_quantity,24.0)" in p
    assert "ReadSchema: struct<l_quantity:double,l_extendedprice:double,l_discount:double,l_shipdate:timestamp_ntz>" in p
    assert "TakeOrderedAndProject" in plan(catalog.SQL["order_rows_topn"][0])
    physical = plan(catalog.SQL["group_dependent_keys"][0]).split("== Physical Plan ==")[1]
    assert re.search(r"HashAggregate\(keys=\[l_linenumber#\d+\]", physical)


def test_stream(spark, tmp_path):
    schema = spark.read.parquet(f"{DATA}/events.parquet").schema
    spark.read.parquet(f"{DATA}/events.parquet").write.parquet(str(tmp_path / "in"))
    df = stream(spark, str(tmp_path / "in"), schema, "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    q = df.writeStream.outputMode("complete").format("memory").queryName("counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    want = Engine(spark, {"events": f"{DATA}/events.parquet"}).sql("SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
    assert sorted(map(tuple, spark.table("counts").collect())) == sorted(map(tuple, want.collect()))
    with pytest.raises(QueryError):
        stream(spark, str(tmp_path / "in"), schema, "SELECT event_id FROM events LIMIT 1")
