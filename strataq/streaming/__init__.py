"""An extension beyond batch files: the same queries over a folder that keeps getting Parquet files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.api import Engine
from strataq.plans.errors import QueryError
from strataq.plans.parser import parse_sql


def stream(spark: SparkSession, folder: str, schema: T.StructType, sql: str) -> DataFrame:
    """A streaming DataFrame for a query whose FROM names anything; rows or groups, without ORDER BY, LIMIT or exact distinct."""
    q = parse_sql(sql)
    if q.order or q.limit is not None or q.offset:
        raise QueryError("UnboundedInput", "no ORDER BY, LIMIT or OFFSET over a stream")
    return Engine(spark).run(q, spark.readStream.schema(schema).parquet(folder))


def stream_windows(spark: SparkSession, folder: str, schema: T.StructType, time: str, every: str, late: str, *, keys: list[str] = (), sums: list[str] = ()) -> DataFrame:
    """(start, keys, n, sums) for each window of time, of files that keep coming into a folder.

    A row counts if it is at most late behind the newest row seen so far; older ones are dropped. A window is given out
    once, when no row for it can count any more, so state holds the open windows alone. Rows without a time are left out.
    Times without a zone are taken as the session's, which should be UTC, and come back without one.
    """
    rows = spark.readStream.schema(schema).parquet(folder).where(F.col(time).isNotNull())
    kind = schema[time].dataType
    rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    window = F.window(time, every)
    out = rows.groupBy(window.alias("__w"), *keys).agg(F.count(F.lit(1)).alias("n"), *[F.sum(c).alias(c) for c in sums])
    return out.select(F.col("__w.start").cast(kind).alias("start"), *keys, "n", *sums)
