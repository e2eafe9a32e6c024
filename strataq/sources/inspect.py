"""Reports about Parquet files: schema, footers and statistics, and whether every column can be read."""

from __future__ import annotations

import io
from typing import Any

import pyarrow as pa
import pyarrow.parquet as pq
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from strataq.plans.errors import DataError

#: Details are given of footers of at most so many bytes.
DETAIL_BYTES = 8 << 20


def schema(spark: SparkSession, path: str) -> str:
    return spark.read.parquet(path).schema.treeString()


def _tail(spark: SparkSession, path: str) -> tuple[int, bytes]:
    """The size of a file of any of Hadoop's file systems, and its footer with what frames it."""
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    size = fs.getFileStatus(p).getLen()
    stream = fs.open(p)
    try:
        stream.seek(max(size - 8, 0))
        end = bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, min(size, 8)))
        if end[4:] != b"PAR1":
            raise DataError("OpenFailed", f"{path} is not a Parquet file")
        length = int.from_bytes(end[:4], "little") + 8
        stream.seek(size - length)
        return size, bytes(jvm.org.apache.commons.io.IOUtils.toByteArray(stream, length))
    finally:
        stream.close()


class _End(io.RawIOBase):
    """A file of which only the end is known."""

    def __init__(self, size: int, data: bytes):
        self.size, self.data, self.at = size, data, 0

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.at

    def seek(self, offset: int, whence: int = 0) -> int:
        self.at = offset + (0, self.at, self.size)[whence]
        return self.at

    def read(self, n: int = -1) -> bytes:
        end = self.size if n < 0 else min(self.at + n, self.size)
        start = self.size - len(self.data)
        out = bytes(max(0, min(end, start) - self.at)) + self.data[max(0, self.at - start) : max(0, end - start)]
        self.at = end
        return out


def metadata(spark: SparkSession, path: str) -> pq.FileMetaData:
    try:
        return pq.read_metadata(pa.PythonFile(_End(*_tail(spark, path)), "r"))
    except DataError:
        raise
    except Exception as e:
        raise DataError("OpenFailed", f"{path}: {str(e).splitlines()[0]}") from e


def inspect(spark: SparkSession, path: str, *, detail: bool = False) -> dict[str, Any]:
    """Footer facts of one file; detail adds row groups and their columns' statistics, for footers of at most DETAIL_BYTES."""
    meta = metadata(spark, path)
    if detail and meta.serialized_size > DETAIL_BYTES:
        raise DataError("FooterTooLarge", f"{path}: detail of a footer of {meta.serialized_size} bytes")
    out: dict[str, Any] = {
        "schema_version": 1, "path": path, "rows": meta.num_rows, "row_groups": meta.num_row_groups, "columns": meta.num_columns,
        "created_by": meta.created_by, "format_version": meta.format_version, "footer_bytes": meta.serialized_size,
        "schema": [{"name": c.path, "physical": c.physical_type, "logical": str(c.logical_type), "max_repetition": c.max_repetition_level} for c in map(meta.schema.column, range(meta.num_columns))],
    }
    if detail:
        out["groups"] = []
        blooms = _blooms(spark, path)
        for k, g in enumerate(map(meta.row_group, range(meta.num_row_groups))):
            columns = []
            for i, c in enumerate(map(g.column, range(g.num_columns))):
                s = c.statistics
                stats = {"nulls": s.null_count, "min": str(s.min) if s.has_min_max else None, "max": str(s.max) if s.has_min_max else None} if s else None
                columns.append({"path": c.path_in_schema, "codec": c.compression, "encodings": list(c.encodings), "bytes": c.total_compressed_size, "raw_bytes": c.total_uncompressed_size, "statistics": stats, "page_index": c.has_column_index and c.has_offset_index, "bloom_filter": blooms[k][i]})
            out["groups"].append({"rows": g.num_rows, "bytes": g.total_byte_size, "columns": columns})
    return out


def _blooms(spark: SparkSession, path: str) -> list[list[bool]]:
    """Which column of which row group has a Bloom filter."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf))
    try:
        return [[c.getBloomFilterOffset() >= 0 for c in g.getColumns()] for g in reader.getFooter().getBlocks()]
    finally:
        reader.close()


def conform(spark: SparkSession, path: str) -> dict[str, str]:
    """Read every value of each column: 'ok', or what went wrong."""
    out = {}
    df = spark.read.parquet(path)
    for c in df.columns:
        try:
            df.agg(F.count_if(F.hash(F.to_json(F.struct(f"`{c}`"))) == 0)).collect()
            out[c] = "ok"
        except Exception as e:
            out[c] = str(e).split("\n")[0]
    return out
