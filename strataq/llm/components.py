"""Connected components of a graph of pairs, by contraction; nothing goes to the driver but whether pairs are left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import drop_tables, durable


def components(links: DataFrame) -> DataFrame:
    """(node, root) for each node of links (a, b): nodes joined by links share a root, which is one of them.

    Each round, every node points to the neighbour of least hash if that is less than its own, and links are redrawn
    between what their ends point to; a hub is folded by partial aggregation and no list of neighbours is built. A round
    leaves a fraction of the nodes, so rounds grow with the logarithm of the largest component.
    """
    spark = links.sparkSession
    made: list[str] = []
    edges = durable(links.where("a <> b").select("a", "b").distinct(), made)
    steps: list[DataFrame] = []
    while not edges.isEmpty():
        rank = lambda c, r=len(steps): F.struct(F.xxhash64(F.lit(r), c).alias("h"), F.col(c).alias("n"))
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        near = both.groupBy("a").agg(F.min(rank("b")).alias("m"))
        step = durable(near.select(F.col("a").alias("node"), F.least(F.col("m"), rank("a"))["n"].alias("up")), made)
        steps.append(step)
        for end in ("a", "b"):
            edges = edges.join(step.withColumnsRenamed({"node": end, "up": f"{end}_"}), end).drop(end).withColumnRenamed(f"{end}_", end)
        edges = durable(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), made)
    if not steps:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).where("false")
    out = steps[0].withColumnRenamed("up", "root")
    for step in steps[1:]:
        out = out.join(step.withColumnRenamed("node", "root"), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    out = durable(out)
    drop_tables(spark, made)
    return out
