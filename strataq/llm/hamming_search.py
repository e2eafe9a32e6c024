"""Exact top-k search by Hamming distance: incremental multi-index hashing of binary codes."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strataq.llm.common import BROADCAST_ROWS, drop_tables, durable

TOP_K = 10
QUERY_EVERY = 50
#: Rows of one code are cut to their smallest ids in so many deals by id first, so that no task gets all of them.
DEALS = 16


def segment_widths(bits: int, rows: int) -> list[int]:
    """Bits of each segment: as even as can be, wider first, and of log2(rows) - 4 bits at most, rounded up.

    What is left over makes no narrow segment of its own: a value of 4 bits has a sixteenth of all codes.
    """
    parts = math.ceil(bits / min(24, max(4, math.log2(max(rows, 2)) - 4)))
    return [bits // parts + (i < bits % parts) for i in range(parts)]


def sign_segments(vector: Column, widths: list[int]) -> Column:
    """The signs of a vector (1: above 0) as numbers of so many bits each; what is missing or null is 0."""
    parts, at = [], 0
    for width in widths:
        ones = [F.when(F.get(vector, at + i) > 0, F.lit(1 << i)).otherwise(0) for i in range(width)]
        total = ones[0]
        for x in ones[1:]:
            total = total + x
        parts.append(total.cast("int"))
        at += width
    return F.array(*parts)


def _distance(a: str, b: str, parts: int) -> Column:
    total = F.lit(0)
    for i in range(parts):
        total = total + F.bit_count(F.get(a, F.lit(i)).bitwiseXOR(F.get(b, F.lit(i))))
    return total


def flips(rows: DataFrame, width: int | Column, radius: int) -> DataFrame:
    """rows with m, once for each number of width bits of which radius are 1: a bit at a time, each above the last.

    The plan grows with the radius, not with the count of numbers.
    """
    rows = rows.withColumns({"m": F.lit(0), "__bit": F.lit(-1)})
    for left in range(radius, 0, -1):
        rows = rows.withColumn("__bit", F.explode(F.when(F.col("__bit") < width - left, F.sequence(F.col("__bit") + 1, F.lit(width - left)))))
        rows = rows.withColumn("m", F.col("m").bitwiseOR(F.call_function("shiftleft", F.lit(1), F.col("__bit"))))
    return rows.drop("__bit")


def smallest_ids(coded: DataFrame, k: int) -> DataFrame:
    """(code, ids): the k smallest ids of each code, of rows (id, code) that may repeat."""
    rows = coded.distinct().withColumn("deal", F.pmod(F.xxhash64("id"), F.lit(DEALS)))
    for keys in (["code", "deal"], ["code"]):
        order = Window.partitionBy(*keys).orderBy("id")
        rows = rows.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k)
    return rows.groupBy("code").agg(F.array_sort(F.collect_list("id")).alias("ids"))


def top_k(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, *, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, id, distance): for each row of queries, the k rows of vectors whose sign codes are nearest.

    Ties go to the smaller id, so the answer is unique. Codes are cut into even segments of about log2(rows) - 4 bits, each
    indexed by its value; a value then has 16 codes or some more, as looking at one costs far less than a lookup. Rounds
    r = 0, 1, ... look up, in each segment, the values at r bits from the query's; each candidate's whole distance is
    then taken. After round r every code within segments * (r + 1) - 1 bits has been met, as one of its segments is
    within r; a query whose kth distance is no more than that is done and leaves. A query whose kth distance so far is
    that of the first j segments of a round (segments * r + j - 1) looks up only those: a code that is in none of
    them within r, and in none of the others within r - 1, is farther.

    Equal codes are one entry of the index with their k smallest ids, which is all that a top k can show, so a vector
    that a third of the rows share is one candidate. Shells beyond round 0 pass by a query's kth distance so far.

    Rows with a null id or vector are neither queries nor answers. An empty vector has all bits 0, a null value gives
    0, and NaN, which is above every number here, 1. Vectors of unequal lengths are compared as if filled up with 0.
    Repeated rows (an id twice) count once. Fewer than k rows give fewer answers; empty tables none. Only the two named
    columns are read.
    """
    spark = vectors.sparkSession
    made: list[str] = []
    pick = lambda df: df.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("v")).where("id IS NOT NULL AND v IS NOT NULL")
    size = pick(vectors).agg(F.max(F.size("v")).alias("bits"), F.count("*").alias("n")).first()
    asked = pick(queries).agg(F.max(F.size("v"))).first()[0] or 0
    bits = max(size["bits"] or 1, asked, 1)
    widths = segment_widths(bits, size["n"])
    parts, wide = len(widths), widths.count(widths[0])
    width = F.when(F.col("part") < wide, widths[0]).otherwise(widths[-1])
    coded = lambda df: pick(df).select("id", sign_segments(F.col("v"), widths).alias("code"))

    codes = durable(smallest_ids(coded(vectors), k), made)
    index = codes.select("code", "ids", F.posexplode("code").alias("part", "value"))
    # probes are many more than the rows they come from, so they are never the side to broadcast
    few = codes.limit(BROADCAST_ROWS // parts + 1).count() <= BROADCAST_ROWS // parts
    index = F.broadcast(index) if few else index.hint("merge")

    none = F.array().cast("array<struct<d:int,id:bigint>>")
    active = durable(coded(queries).distinct().select(F.col("id").alias("q"), F.col("code").alias("asked"), none.alias("best"), F.lit(bits).alias("limit")), made)
    done: list[DataFrame] = []
    for r in range(widths[0] + 1):
        needed = F.slice("asked", 1, F.least(F.lit(parts), F.col("limit") - (parts * r - 1)))
        probes = active.select("q", "asked", "limit", F.posexplode(needed).alias("part", "at"))
        if r:
            probes = flips(probes, width, r).withColumn("value", F.col("at").bitwiseXOR(F.col("m"))).drop("m")
        else:
            probes = probes.withColumnRenamed("at", "value")
        met = probes.join(index, ["part", "value"]).withColumn("d", _distance("asked", "code", parts).cast("int"))
        met = met.where("d <= limit").select("q", "d", "ids")
        near = Window.partitionBy("q").orderBy("d", F.get("ids", F.lit(0)))
        met = met.distinct().withColumn("n", F.row_number().over(near)).where(F.col("n") <= k)
        pairs = F.transform("ids", lambda i: F.struct(F.col("d").alias("d"), i.alias("id")))
        new = met.groupBy("q").agg(F.flatten(F.collect_list(pairs)).alias("new"))
        best = F.slice(F.array_sort(F.array_distinct(F.concat("best", F.coalesce("new", none)))), 1, k)
        state = active.join(new, "q", "left").select("q", "asked", best.alias("best"))
        kth = F.when(F.size("best") >= k, F.get("best", F.lit(k - 1))["d"]).otherwise(bits)
        state = durable(state.withColumn("limit", kth), made)
        covered = parts * (r + 1) - 1
        over = (F.col("limit") <= covered) if covered < bits else F.lit(True)
        done.append(state.where(over))
        active = state.where(~over)
        if covered >= bits or active.isEmpty():
            break
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    rows = durable(out.select(F.col("q").alias("query_id"), F.posexplode("best").alias("rank", "b")))
    drop_tables(spark, made)
    return rows.select("query_id", (F.col("rank") + 1).cast("int").alias("rank"), F.col("b.id").alias(id_col), F.col("b.d").alias("distance"))


def oracle_sql(k: int = TOP_K) -> str:
    return f"""
WITH c AS (SELECT vec_id, [CASE WHEN x > 0 THEN 1 ELSE 0 END for x in embedding] AS code FROM embeddings),
p AS (SELECT q.vec_id AS query_id, c.vec_id, (list_sum(q.code) + list_sum(c.code) - 2 * list_inner_product(q.code::DOUBLE[], c.code::DOUBLE[]))::INTEGER AS distance
  FROM c q, c WHERE q.vec_id % {QUERY_EVERY} = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM p)
SELECT query_id, rank::INTEGER AS rank, vec_id, distance FROM r WHERE rank <= {k}
"""
