"""Answers as text (NDJSON, JSON, CSV), Parquet and Arrow."""

from __future__ import annotations

import base64
import datetime as dt
import json
import math
import os
import re
import shutil
import struct
import tempfile
from collections.abc import Iterable, Iterator
from decimal import Decimal
from typing import IO, Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.plans.errors import DataError, QueryError
from strataq.shipping import ship

FORMATS = ("ndjson", "json", "csv", "parquet")
# Codecs by the names they are asked for.
CODECS = {"snappy": "snappy", "zstd": "zstd", "gzip": "gzip", "lz4": "lz4_raw", "lz4_raw": "lz4_raw", "uncompressed": "uncompressed"}
_ESCAPES = {'"': '\\"', "\\": "\\\\", "\n": "\\n", "\r": "\\r", "\t": "\\t"}
_SPECIAL = re.compile("[\"\\\\\x00-\x1f\u2028\u2029]")
_EPOCH = dt.datetime(1970, 1, 1)
_SCHEME = re.compile(r"^file:(//)?(?=/)")


def quoted(s: str) -> str:
    return '"' + _SPECIAL.sub(lambda m: _ESCAPES.get(m[0]) or f"\\u{ord(m[0]):04x}", s) + '"'


def number(x: float, single: bool = False) -> str:
    """The shortest decimal that reads back as the same value, without an exponent."""
    if single:
        for digits in range(1, 10):
            text = f"{x:.{digits}g}"
            if struct.pack("f", float(text)) == struct.pack("f", x):
                break
    else:
        text = repr(x)
    out = format(Decimal(text), "f")
    return out.rstrip("0").rstrip(".") if "." in out else out


def _bytes(v: bytes) -> str | None:
    try:
        return v.decode()
    except UnicodeDecodeError:
        return None


def _micros(v: dt.datetime) -> int:
    d = v.replace(tzinfo=None) - _EPOCH
    return (d.days * 86_400 + d.seconds) * 10**6 + d.microseconds


def json_value(v: Any, t: T.DataType) -> str:
    if v is None:
        return "null"
    if isinstance(t, T.BooleanType):
        return "true" if v else "false"
    if isinstance(t, T.FloatType | T.DoubleType):
        if math.isnan(v) or math.isinf(v):
            return '"NaN"' if math.isnan(v) else '"Infinity"' if v > 0 else '"-Infinity"'
        return number(v, isinstance(t, T.FloatType))
    if isinstance(t, T.DecimalType):
        return format(v, "f")
    if isinstance(t, T.StringType):
        return quoted(v)
    if isinstance(t, T.DateType):
        return str((v - dt.date(1970, 1, 1)).days)
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return str(_micros(v))
    if isinstance(t, T.BinaryType):
        text = _bytes(bytes(v))
        return quoted(text) if text is not None else '{"base64":"' + base64.b64encode(v).decode() + '"}'
    if isinstance(t, T.StructType):
        return "{" + ",".join(f"{quoted(f.name)}:{json_value(v[f.name], f.dataType)}" for f in t.fields) + "}"
    return str(v)


def from_json(v: Any, t: T.DataType) -> Any:
    """What json_value() wrote, read by a JSON parser, as a Python value of its type."""
    if v is None:
        return None
    if isinstance(t, T.StructType):
        return tuple(from_json(v[f.name], f.dataType) for f in t.fields)
    if isinstance(t, T.FloatType | T.DoubleType):
        return float(v)
    if isinstance(t, T.DecimalType):
        return Decimal(v)
    if isinstance(t, T.DateType):
        return dt.date(1970, 1, 1) + dt.timedelta(days=v)
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return _EPOCH.replace(tzinfo=dt.UTC if isinstance(t, T.TimestampType) else None) + dt.timedelta(microseconds=v)
    if isinstance(t, T.BinaryType):
        return base64.b64decode(v["base64"]) if isinstance(v, dict) else v.encode()
    return v


def csv_value(v: Any, t: T.DataType) -> str:
    if v is None:
        return ""
    if isinstance(t, T.FloatType | T.DoubleType) and (math.isnan(v) or math.isinf(v)):
        return "NaN" if math.isnan(v) else "Infinity" if v > 0 else "-Infinity"
    if isinstance(t, T.DateType):
        return v.isoformat()
    if isinstance(t, T.TimestampType | T.TimestampNTZType):
        return v.replace(tzinfo=None).isoformat(" ", "microseconds") + "Z" * isinstance(t, T.TimestampType)
    if isinstance(t, T.StringType):
        text = v
    elif isinstance(t, T.BinaryType):
        found = _bytes(bytes(v))
        text = found if found is not None else json_value(v, t)
    else:
        return json_value(v, t)
    return '"' + text.replace('"', '""') + '"' if text == "" or re.search('[",\r\n]', text) else text


def flat(df: DataFrame) -> DataFrame:
    """avg_state pairs as two columns, <name>__sum and <name>__count."""
    out = []
    for f in df.schema.fields:
        c = F.col(_quote(f.name))
        if isinstance(f.dataType, T.StructType) and f.dataType.names == ["sum", "count"]:
            out += [c["sum"].alias(f"{f.name}__sum"), c["count"].alias(f"{f.name}__count")]
        else:
            out.append(c)
    return df.select(*out)


def _as_stored(df: DataFrame) -> tuple[DataFrame, list[T.DataType]]:
    """What Python's datetime would shift or can't hold comes as it is stored: instants as UTC wall-clock times."""
    types = [f.dataType for f in df.schema.fields]
    for f in df.schema.fields:
        if isinstance(f.dataType, T.TimestampType):
            df = df.withColumn(f.name, F.timestamp_micros(F.unix_micros(F.col(_quote(f.name)))).cast("timestamp_ntz"))
    return df, types


def _quote(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def _object(keys: list[str], values: Iterable[Any], types: list[T.DataType]) -> str:
    return "{" + ",".join(f"{k}:{json_value(v, t)}" for k, v, t in zip(keys, values, types, strict=True)) + "}"


def text_rows(df: DataFrame, form: str) -> DataFrame:
    """One column, line: each row as NDJSON or CSV without its line end, made where the row is."""
    if form not in ("ndjson", "csv"):
        raise QueryError("BadFormat", form)
    df, types = _as_stored(flat(df) if form == "csv" else df)
    keys = [quoted(n) for n in df.columns]
    ship(df.sparkSession)

    def run(batches: Iterator[Any]) -> Iterator[Any]:
        import pyarrow as pa

        for b in batches:
            rows = zip(*[c.to_pylist() for c in b.columns], strict=True)
            if form == "csv":
                out = [",".join(csv_value(v, t) for v, t in zip(r, types, strict=True)) for r in rows]
            else:
                out = [_object(keys, r, types) for r in rows]
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["line"])

    return df.mapInArrow(run, "line string")


def lines(df: DataFrame, form: str) -> Iterator[str]:
    """The answer as text, partition by partition: the driver holds one at a time."""
    if form == "csv":
        df = flat(df)
    df, types = _as_stored(df)
    rows = df.toLocalIterator(prefetchPartitions=True)
    names = df.columns
    if form == "csv":
        yield ",".join(csv_value(n, T.StringType()) for n in names) + "\r\n"
        for r in rows:
            yield ",".join(csv_value(v, t) for v, t in zip(r, types, strict=True)) + "\r\n"
        return
    keys = [quoted(n) for n in names]
    objects = (_object(keys, r, types) for r in rows)
    if form == "ndjson":
        for o in objects:
            yield o + "\n"
        return
    yield "["
    for i, o in enumerate(objects):
        yield ("," if i else "") + o
    yield "]\n"


def write_text(df: DataFrame, form: str, out: IO[str]) -> int:
    if form not in FORMATS[:3]:
        raise QueryError("BadFormat", form)
    n = 0
    for part in lines(df, form):
        out.write(part)
        n += 1
    return n


def _narrowed(df: DataFrame) -> DataFrame:
    """Integer sums, exact as DECIMAL(38,0), as INT64; one that doesn't fit is an error when it is written."""
    return df.select(*[F.col(f"`{f.name}`").cast("long").alias(f.name) if f.dataType == T.DecimalType(38, 0) else F.col(f"`{f.name}`") for f in df.schema.fields])


def refuse_alias(path: str, inputs: Iterable[str]) -> None:
    """An output that is an input, holds one or lies in one, also by another name for it, would destroy what is read."""
    real = lambda p: os.path.realpath(_SCHEME.sub("", p)) if "://" not in p or p.startswith("file:") else p
    out = real(path)
    for i in map(real, inputs):
        both = os.path.exists(out) and os.path.exists(i) and os.path.samefile(out, i)
        if both or out == i or i.startswith(out.rstrip("/") + "/") or out.startswith(i.rstrip("/") + "/"):
            raise QueryError("OutputIsInput", f"{path} is read by the query")


def _replaceable(spark: SparkSession, path: str) -> bool:
    """Whether nothing is there, or nothing but what such a write leaves: part files and marks."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return True
    if not fs.getFileStatus(p).isDirectory():
        return False
    return all(not s.isDirectory() and s.getPath().getName().startswith(("part-", "_", ".")) for s in fs.listStatus(p))


def write_parquet(
    df: DataFrame,
    path: str,
    *,
    codec: str = "snappy",
    single: bool = False,
    bloom: dict[str, float] | None = None,
    row_group_bytes: int | None = None,
    row_group_rows: int | None = None,
    version: str | None = None,
    level: int | None = None,
    narrow: bool = False,
    inputs: Iterable[str] = (),
) -> None:
    """A folder of part files, written by all tasks and put in place by the committer when it is whole.

    single: one file of one task instead, in place by a rename; for small answers. A folder that holds anything but
    part files is not replaced. level: how hard zstd works.
    """
    if codec not in CODECS:
        raise QueryError("BadCodec", codec)
    refuse_alias(path, inputs)
    df = flat(_narrowed(df) if narrow else df)
    options = {"compression": CODECS[codec]}
    for c, fpp in (bloom or {}).items():
        if isinstance(df.schema[c].dataType, T.BooleanType):
            raise QueryError("BadBloomFilter", "not for BOOLEAN columns")
        options |= {f"parquet.bloom.filter.enabled#{c}": "true", f"parquet.bloom.filter.fpp#{c}": str(fpp)}
    if row_group_bytes:
        options["parquet.block.size"] = str(row_group_bytes)
    if row_group_rows:
        options["parquet.block.row.count.limit"] = str(row_group_rows)
    if level is not None:
        options["parquet.compression.codec.zstd.level"] = str(level)
    if version:
        options["parquet.writer.version"] = {"v1": "PARQUET_1_0", "v2": "PARQUET_2_0"}[version]
    if not single:
        if not _replaceable(df.sparkSession, path):
            raise DataError("OutputNotReplaceable", f"{path} holds something else")
        df.write.mode("overwrite").options(**options).parquet(path)
        return
    temp = tempfile.mkdtemp(prefix=".strataq-", dir=os.path.dirname(os.path.abspath(path)))
    try:
        df.coalesce(1).write.options(**options).parquet(f"file://{temp}/out")
        parts = [f for f in os.listdir(f"{temp}/out") if f.startswith("part-")]
        if len(parts) != 1:
            raise DataError("WriteFailed", f"{len(parts)} part files")
        os.replace(f"{temp}/out/{parts[0]}", path)
    finally:
        shutil.rmtree(temp, ignore_errors=True)
