"""What the operators of this package share: inputs, durable intermediate tables and size-checked broadcasts."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.shipping import ship

__all__ = ["BROADCAST_ROWS", "UPPER", "ascii_lower", "drop_tables", "durable", "md5_bits", "shared_dir", "ship", "small", "table"]

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: A side of a join is broadcast only if it was counted and has at most so many rows of at most some hundred bytes.
BROADCAST_ROWS = 200_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir, or one of our own where a local session sets none."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    own = getattr(shared_dir, "own", None)
    if own is None:
        own = shared_dir.own = tempfile.mkdtemp(prefix="strataq-")
        atexit.register(shutil.rmtree, own, ignore_errors=True)
    return f"file://{own}"


def _remove(spark: SparkSession, path: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)
    except Exception:  # the session has ended; the folder is the cluster's to clean
        pass


def durable(df: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Write df to the shared folder and read it back: cuts the lineage, and survives the loss of any executor.

    keep gets the path, for drop_tables(); the rest goes when the driver ends.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/strataq-{uuid.uuid4().hex}"
    df.write.parquet(path)
    if keep is not None:
        keep.append(path)
    atexit.register(_remove, spark, path)
    return spark.read.schema(df.schema).parquet(path)


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Remove durable tables that no later plan reads."""
    while paths:
        _remove(spark, paths.pop())


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most so many rows; else as it is, for a shuffled join. df should be durable."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased and nothing else. Text without other letters takes the fast built-in."""
    return F.when(F.octet_length(c) == F.char_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, UPPER.lower()))


def md5_bits(c: Column) -> Column:
    """60 bits of the MD5 of c's text as a non-negative long. Null counts as the text 'null'."""
    return F.conv(F.substring(F.md5(F.coalesce(c.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")
