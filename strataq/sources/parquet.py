"""Parquet files read as one table, in the order given."""

from __future__ import annotations

import re
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.plans.errors import DataError, QueryError

#: Footers are read by so many threads of the driver; that is waiting for storage, not work.
FOOTER_THREADS = 16
#: So many files at most are told apart by a list in the plan.
NAMED_FILES = 16
_PLACE_BITS = 40


def _file_system(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def expand(spark: SparkSession, inputs: list[str]) -> list[str]:
    """Inputs with globs of file names expanded, sorted within each. Wildcards in directories are refused."""
    out = []
    for path in inputs:
        folder, _, name = path.rpartition("/")
        if re.search(r"[*?\[]", folder):
            raise QueryError("GlobInDirectory", f"{path}: wildcards in file names only")
        if not re.search(r"[*?\[]", name):
            out.append(path)
            continue
        fs, p = _file_system(spark, path)
        found = sorted(str(s.getPath().toString()) for s in (fs.globStatus(p) or []))
        if not found:
            raise DataError("FileNotFound", f"no file matches {path}")
        out += found
    return out


def _shape(t: T.DataType, exact: bool) -> object:
    if isinstance(t, T.StructType):
        return tuple((f.name if exact else f.name.lower(), _shape(f.dataType, exact)) for f in t.fields)
    if isinstance(t, T.DecimalType):
        return ("decimal", t.scale, t.precision if exact else None)
    return t.simpleString() if exact else type(t).__name__


@dataclass(frozen=True)
class File:
    """One Parquet file of an input: which input, its path, the rows of its row groups, and its schema as Parquet has it."""

    place: int
    path: str
    groups: tuple[int, ...]
    schema: str

    @property
    def rows(self) -> int:
        return sum(self.groups)


def _part_files(spark: SparkSession, path: str) -> list[str]:
    """The file itself, or the files below a folder, by name, without hidden ones and Spark's marks."""
    fs, p = _file_system(spark, path)
    status = fs.getFileStatus(p)
    if not status.isDirectory():
        return [status.getPath().toString()]
    out, found, base = [], fs.listFiles(p, True), len(status.getPath().toString())
    while found.hasNext():
        name = found.next().getPath().toString()
        if not any(x[0] in "._" and "=" not in x for x in name[base:].split("/") if x):
            out.append(name)
    return sorted(out)


def _footer(spark: SparkSession, place: int, path: str) -> File:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(path), conf)
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(where)
    try:
        meta = reader.getFooter()
        text = meta.getFileMetaData().getSchema().toString().partition("\n")[2]
        return File(place, path, tuple(b.getRowCount() for b in meta.getBlocks()), text)
    finally:
        reader.close()


def footers(spark: SparkSession, paths: list[str]) -> list[File]:
    """The files of the inputs in the order given, with their footers, read side by side."""
    with ThreadPoolExecutor(FOOTER_THREADS) as pool:
        files = list(pool.map(lambda x: [(x[0], f) for f in _part_files(spark, x[1])], enumerate(paths)))
        return list(pool.map(lambda x: _footer(spark, *x), [f for some in files for f in some]))


def check_schemas(spark: SparkSession, files: list[File], exact: bool) -> T.StructType:
    """The one schema of all files. Aggregates need equal names (in any case), nesting and scales; rows, all of it.

    Spark reads one file for each different schema in the footers, however many files there are.
    """
    different: dict[str, str] = {}
    for f in files:
        different.setdefault(f.schema, f.path)
    first = None
    for p in different.values():
        schema = spark.read.parquet(p).schema
        if first is None:
            first = schema
        elif _shape(schema, exact) != _shape(first, exact):
            raise DataError("SchemaMismatch", f"{p} differs from {files[0].path}")
    return first


def opened(spark: SparkSession, paths: list[str], exact: bool) -> tuple[T.StructType, list[File]]:
    """Schema and files of inputs."""
    if not paths:
        raise QueryError("NoInput", "no input was named")
    try:
        files = footers(spark, paths)
        if not files:
            raise DataError("FileNotFound", f"no Parquet file in {', '.join(paths)}")
        return check_schemas(spark, files, exact), files
    except QueryError:
        raise
    except Exception as e:
        raise DataError("OpenFailed", str(e).split("\n")[0]) from e


def open_table(spark: SparkSession, inputs: list[str], *, exact: bool = False) -> DataFrame:
    """The inputs as one DataFrame with Spark's _metadata column available."""
    schema, files = opened(spark, expand(spark, inputs), exact)
    return read_files(spark, schema, files)


def read_files(spark: SparkSession, schema: T.StructType, files: list[File]) -> DataFrame:
    return spark.read.schema(schema).parquet(*[f.path for f in files])


def first_files(files: list[File], rows: int) -> list[File]:
    """The files that hold the first so many rows; by footers alone."""
    out, n = [], 0
    for f in files:
        if n >= rows and out:
            break
        out.append(f)
        n += f.rows
    return out


def place_after(files: list[File], rows: int) -> int:
    """The place (as with_ordinal() numbers them) that ends the first so many rows, if all but the last file are used up."""
    before = sum(f.rows for f in files[:-1])
    return (len(files) - 1 << _PLACE_BITS) + max(rows - before, 0)


def _plain(path: str) -> str:
    return re.sub(r"^\w+:(//[^/]*)?(?=/)", "", path)


def with_ordinal(spark: SparkSession, df: DataFrame, files: list[File], name: str) -> DataFrame:
    """df with each row's place in the input as a number: the file's place in the order given, then the row's in the file.

    Spark spells a file's path in _metadata in its own way, percent-encoded; both sides are decoded and stripped of the
    scheme. A few files are told apart in place; more are looked up in a table of one row per file.
    """
    row, path = F.col("_metadata.row_index"), F.col("_metadata.file_path")
    if len(files) == 1:
        return df.withColumn(name, row)
    own = F.regexp_replace(F.try_url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), r"^\w+:(//[^/]*)?(?=/)", "")
    place = lambda c: F.call_function("shiftleft", c.cast("long"), F.lit(_PLACE_BITS)) + F.col(name)
    if len(files) <= NAMED_FILES:
        number = F.create_map(*[F.lit(x) for i, f in enumerate(files) for x in (_plain(f.path), i)])
        return df.withColumns({name: row, "__file": own}).withColumn(name, place(F.try_element_at(number, F.col("__file")))).drop("__file")
    known = spark.createDataFrame([(_plain(f.path), i) for i, f in enumerate(files)], "__file string, __place long")
    rows = df.withColumns({name: row, "__file": own}).join(known, "__file")
    return rows.withColumn(name, place(F.col("__place"))).drop("__file", "__place")


def row_group_bounds(file: File, wanted: list[int] | None) -> tuple[int, int] | None:
    """First and end row of row groups [start, end) of a file, or of the fraction [start, end, of] of them."""
    if wanted is None:
        return None
    if len(wanted) not in (2, 3) or any(type(x) is not int or x < 0 for x in wanted) or wanted[0] > wanted[1] or (len(wanted) == 3 and not 0 < wanted[2] >= wanted[1]):
        raise QueryError("BadFieldType", f"row_groups: {wanted}")
    n = len(file.groups)
    start, end = wanted[:2] if len(wanted) == 2 else (wanted[0] * n // wanted[2], wanted[1] * n // wanted[2])
    if end > n:
        raise DataError("RowGroupOutOfRange", f"{file.path} has {n} row groups")
    return sum(file.groups[:start]), sum(file.groups[:end])


def open_slices(spark: SparkSession, inputs: list[str], slices: list[list[int] | None]) -> DataFrame:
    """The inputs, one file each, as one table, of each just the rows of its slice of row groups."""
    if len(slices) != len(inputs):
        raise QueryError("BadFieldType", "row_groups: one entry for each input")
    schema, files = opened(spark, inputs, False)
    if len(files) != len(inputs):
        raise QueryError("BadFieldType", "row_groups: inputs must be files")
    out = None
    for file, wanted in zip(files, slices, strict=True):
        part = read_files(spark, schema, [file])
        bounds = row_group_bounds(file, wanted)
        if bounds:
            row = F.col("_metadata.row_index")
            part = part.where((row >= bounds[0]) & (row < bounds[1]))
        out = part if out is None else out.unionAll(part)
    return out
