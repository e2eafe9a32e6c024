"""Sharding by extendible hashing: shards under a byte limit, addressed by prefixes of a hash."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import durable, md5_bits, small

SHARD_BYTES = 16 << 20
BITS = 60
#: So many bits more than the mean shard needs are counted in one pass; only what is still too large is counted again.
SLACK_BITS = 4


def _prefix(h: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", h, (F.lit(BITS) - depth).cast("int"))


def _label(cell: Column, at: int, depth: Column) -> Column:
    """The depth leading bits of a cell of at bits, as text of 0 and 1."""
    bits = F.lpad(F.bin(cell), at, "0") if at else F.lit("")
    return F.substring(bits, F.lit(1), depth)


def _directory(keys: DataFrame, limit: int, at: int) -> DataFrame:
    """For each cell (at bits) of keys (h, bytes): the bucket it lies in, the shallowest that fits; depth null if none does.

    A bucket of one document can't be split and is left as it is.
    """
    cells = durable(keys.groupBy(_prefix(F.col("h"), at).alias("cell")).agg(F.sum("bytes").alias("b"), F.count("*").alias("n")))
    up = cells.select("cell", "b", "n", F.explode(F.sequence(F.lit(0), F.lit(at))).alias("depth"))
    up = up.withColumn("prefix", F.call_function("shiftright", F.col("cell"), (F.lit(at) - F.col("depth")).cast("int")))
    sizes = up.groupBy("depth", "prefix").agg(F.sum("b").alias("shard_bytes"), F.sum("n").alias("shard_rows"))
    fits = sizes.where((F.col("shard_bytes") <= limit) | (F.col("shard_rows") <= 1))
    best = (
        up.select("cell", "depth", "prefix")
        .join(fits, ["depth", "prefix"])
        .groupBy("cell")
        .agg(F.min(F.struct("depth", "shard_bytes")).alias("best"))
    )
    joined = cells.select("cell").join(best, "cell", "left")
    return durable(joined.select("cell", "best.depth", "best.shard_bytes"))


def _assign(keyed: DataFrame, keys: DataFrame, limit: int, mark: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """keyed with shard, depth and shard_bytes by the bits of h; then what no prefix makes fit: rows of keyed, and keys."""
    total = keys.agg(F.sum("bytes")).first()[0] or 0
    at = min(BITS, max(0, math.ceil(math.log2(max(total, 1) / limit))) + SLACK_BITS)
    done = None
    while True:
        found = _directory(keys, limit, at)
        fit = small(found.where("depth IS NOT NULL").withColumnRenamed("cell", "__cell"))
        label = F.concat(F.lit(mark), _label(F.col("__cell"), at, F.col("depth")))
        cell = _prefix(F.col("__h"), at)
        part = keyed.withColumn("__cell", cell).join(fit, "__cell").withColumn("shard", label).drop("__cell")
        done = part if done is None else done.unionByName(part)
        over = found.where("depth IS NULL").select("cell")
        if over.isEmpty():
            return done, None, None
        over = small(over)
        keys = durable(keys.withColumn("cell", _prefix(F.col("h"), at)).join(over, "cell", "left_semi").drop("cell"))
        keyed = keyed.withColumn("__cell", cell).join(over.withColumnRenamed("cell", "__cell"), "__cell", "left_semi").drop("__cell")
        if at == BITS:
            return done, keyed, keys
        at = min(BITS, at + SLACK_BITS)


def shard_documents(docs: DataFrame, limit: int = SHARD_BYTES, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with columns shard (the hash prefix, as bits), depth (their number) and shard_bytes (of UTF-8 text).

    A directory addressed by leading bits of an id's hash: starting from one bucket, only buckets above limit split on
    another bit, so each shard is the shallowest prefix whose documents fit. Bytes are summed once per cell of some
    bits more than the mean shard needs; prefixes are then sums of cells. Only cells that still do not fit are counted
    at more bits. One document larger than the limit has a shard of its own.

    Rows with one id (a hot key, or repeated rows) share all bits; if they do not fit together they overflow into
    shards ('~' and bits) addressed by a hash of a number given to each such row, so one key may hold any share of rows.

    Nulls: a null id hashes as the text 'null'; a null or empty text has 0 bytes. An empty table gives an empty
    result. Columns of docs named shard, depth or shard_bytes are replaced; other columns pass.
    """
    if limit < 1:
        raise ValueError("limit must be at least 1 byte")
    rows = docs.drop("shard", "depth", "shard_bytes").withColumn("__h", md5_bits(F.col(id_col)))
    size = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("bytes")
    keys = durable(rows.select(F.col("__h").alias("h"), size))
    done, rest, _ = _assign(rows, keys, limit, "")
    if rest is not None:
        # numbers are stored with the rows: another scan might number them otherwise
        rest = durable(rest.withColumn("__uid", F.monotonically_increasing_id()))
        rest = rest.withColumn("__h", md5_bits(F.col("__uid"))).drop("__uid")
        more, rest, _ = _assign(rest, durable(rest.select(F.col("__h").alias("h"), size)), limit, "~")
        done = done.unionByName(more)
        if rest is not None:
            raise RuntimeError("two row numbers share 60 bits of a hash")
    return done.drop("__h")


def oracle_sql(limit: int = SHARD_BYTES) -> str:
    return f"""
WITH k AS (SELECT doc_id, ('0x' || substr(md5(doc_id::VARCHAR), 1, 15))::BIGINT AS h, coalesce(strlen(text), 0) AS b FROM documents),
up AS (SELECT doc_id, b, d, h >> ({BITS} - d) AS p FROM k, range(0, {BITS + 1}) t(d)),
s AS (SELECT d, p, sum(b) AS b, count(*) AS n FROM up GROUP BY d, p),
best AS (SELECT up.doc_id, min(s.d) AS d FROM up JOIN s ON up.d = s.d AND up.p = s.p WHERE s.b <= {limit} OR s.n <= 1 GROUP BY up.doc_id)
SELECT k.doc_id, CASE WHEN best.d = 0 THEN '' ELSE lpad(bin(k.h >> ({BITS} - best.d)), best.d::INTEGER, '0') END AS shard,
  best.d::INTEGER AS depth, s.b::BIGINT AS shard_bytes
FROM k JOIN best USING (doc_id) JOIN s ON s.d = best.d AND s.p = k.h >> ({BITS} - best.d)
"""
