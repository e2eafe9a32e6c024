"""Mixing sources to target weights by Poisson replication."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Shares of the mixed corpus. Sources that are not named share the rest in their own proportions.
MIX_WEIGHTS = {"src0": 0.20, "src1": 0.10, "src2": 0.10, "src3": 0.05}
MIX_SEED = "mix-1"
_TWO52 = float(1 << 52)


#: Rates above this are refused: a document that often is no mixture, and its distribution no plan.
MOST = 1e7


def poisson_part(rate: float) -> tuple[int, list[float]]:
    """(k, P(X <= k), P(X <= k + 1), ...), from 12 deviations below the mean as far as 52-bit uniform numbers tell them from 1.

    What lies before k has a probability below 1e-30; so the list grows with the root of the rate.
    """
    if rate > MOST:
        raise ValueError(f"a rate of {rate} repeats a document; at most {MOST}")
    wide = 12 * math.sqrt(rate) + 40
    low = max(0, math.floor(rate - wide))
    out, total = [], 0.0
    for k in range(low, int(rate + wide)):
        total += math.exp(-rate + k * math.log(rate) - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        out.append(total)
        if total >= 1 - 2.0**-53:
            break
    return low, out


def poisson_cdf(rate: float) -> list[float]:
    """P(X <= 0), P(X <= 1), ... as far as a 52-bit uniform number can tell them from 1."""
    low, part = poisson_part(rate)
    return [0.0] * low + part


def uniform(id_col: Column, seed: str, other: Column | None = None) -> Column:
    """A number in (0, 1) that depends on the seed and the id only; for a null id, on other instead."""
    none = F.lit("null") if other is None else F.concat(F.lit("null "), other.cast("string"))
    text = F.concat(F.lit(f"{seed}|"), F.coalesce(id_col.cast("string"), none))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / _TWO52


def mix_sources(
    docs: DataFrame,
    weights: dict[str, float] = MIX_WEIGHTS,
    *,
    repeat: float = 1.0,
    seed: str = MIX_SEED,
    id_col: str = "doc_id",
    source_col: str = "source",
    copy_col: str = "copy_no",
) -> DataFrame:
    """Repeat each document as often as a Poisson draw says, so that sources get their target weights; shuffle globally.

    The expected number of rows is repeat times the input's. A source's rate is its share of those rows over its own
    rows; a document's count inverts the Poisson distribution with that rate at a number hashed from seed and id, so a
    rerun, a retried task or another partitioning draws the same counts. Copies carry copy_col 0, 1, ...; rows are
    dealt to partitions and sorted by a hash of id and copy.

    The driver gets one count per named source and one for the rest, whatever the number of sources. No row is joined
    or grouped by source afterwards, so a hot source is not in one task's hands.

    Nulls: a null source belongs to the unnamed rest; a row with a null id draws by a hash of all its columns (but MAPs);
    null or empty texts are ordinary rows. Repeated rows draw alike, each for itself. A named source without rows is left
    out, its share going to nobody. An empty table gives an empty result. A column named as copy_col is replaced; other
    columns pass, whatever their names.
    """
    if min([0.0, *weights.values()]) < 0 or sum(weights.values()) > 1 + 1e-9:
        raise ValueError("weights must be non-negative and sum to at most 1")
    named = F.when(F.col(source_col).isin(*weights), F.col(source_col)) if weights else F.lit(None).cast("string")
    counts = {r[0]: r[1] for r in docs.groupBy(named.alias("s")).agg(F.count("*").alias("n")).collect()}
    total = sum(counts.values()) * repeat
    def cdf(s: str | None, share: float) -> Column:
        low, values = poisson_part(total * share / counts[s])
        return F.struct(F.lit(low).alias("low"), F.array(*map(F.lit, values)).alias("up"))

    rest = cdf(None, max(0.0, 1 - sum(weights.values()))) if counts.get(None) else F.struct(F.lit(0).alias("low"), F.array(F.lit(1.0)).alias("up"))
    table = F
    for s, w in weights.items():
        if counts.get(s):
            table = table.when(F.col(source_col) == s, cdf(s, w))
    table = rest if table is F else table.otherwise(rest)
    docs = docs.drop(copy_col)
    row = F.xxhash64(*[F.col("`" + f.name.replace("`", "``") + "`") for f in docs.schema.fields if not isinstance(f.dataType, T.MapType)])
    draw = uniform(F.col(id_col), seed, row)
    key = F.xxhash64(F.lit(seed), F.col(id_col), F.col(copy_col), F.when(F.col(id_col).isNull(), F.col("__op6_u")))
    times = F.col("__op6_cdf.low") + F.size(F.filter(F.col("__op6_cdf.up"), lambda c: F.col("__op6_u") >= c))
    return (
        docs.withColumns({"__op6_u": draw, "__op6_cdf": table})
        .withColumn("__op6_n", times)
        .where("__op6_n > 0")
        .withColumn(copy_col, F.explode(F.sequence(F.lit(0), F.col("__op6_n") - 1)))
        .withColumn("__op6_key", key)
        .drop("__op6_u", "__op6_cdf", "__op6_n")
        .repartition("__op6_key")
        .sortWithinPartitions("__op6_key", id_col, copy_col)
        .drop("__op6_key")
    )


def oracle_sql(weights: dict[str, float] = MIX_WEIGHTS, seed: str = MIX_SEED) -> str:
    share = " ".join(f"WHEN '{s}' THEN {w!r}" for s, w in weights.items())
    names = ", ".join(f"'{s}'" for s in weights)
    return f"""
WITH g AS (SELECT *, CASE WHEN source IN ({names}) THEN source END AS s FROM documents),
n AS (SELECT s, count(*) AS n FROM g GROUP BY s),
r AS (SELECT s, (SELECT sum(n) FROM n) * CASE s {share} ELSE {1 - sum(weights.values())!r} END / n AS rate FROM n),
p AS (SELECT s, k, exp(-rate + k * ln(rate) - lgamma(k + 1)) AS p FROM r, range(0, 80) t(k)),
c AS (SELECT s, k, sum(p) OVER (PARTITION BY s ORDER BY k) AS cdf FROM p),
u AS (SELECT *, (('0x' || substr(md5('{seed}|' || doc_id), 1, 13))::BIGINT + 0.5::DOUBLE) / 4503599627370496 AS u FROM g)
SELECT doc_id, source, text, k::INTEGER AS copy_no
FROM u JOIN c ON u.s IS NOT DISTINCT FROM c.s WHERE u.u >= c.cdf
"""
