"""Line deduplication: lines found in many documents, as per-document bitmaps of what to keep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import ascii_lower, drop_tables, durable, small

MIN_DOCS = 10
#: [\x20\x09-\x0D]
BLANKS = "\x20\x09\x0a\x0b\x0c\x0d"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def line_keep_bitmaps(
    docs: DataFrame, min_docs: int = MIN_DOCS, min_key: int = 1, *, keep_first: bool = False, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Which lines to keep, for the documents that lose any: (id, fp, n_lines, keep), keep a run-length bitmap.

    A line's key is the line without blanks at both ends, A-Z lower-cased. Keys of at least min_key code points that
    min_docs or more documents hold lose all their lines; with keep_first, all but the first in the order of documents
    (keys of two documents or more then need min_docs=2). apply_bitmaps() makes texts of the bitmaps.

    96-bit hashes of keys are range-partitioned by (hash, document), so the documents of one hot line lie in many
    tasks, and sorted there by document and position; what streams out is a row for each hash and document with the
    positions, and for each task and hash a count and the first occurrence. Text is never shuffled here.

    Nulls: a null text is one empty line. Empty lines have keys of 0 code points and stay. Rows that repeat an id and
    text count as one document and get the same bitmap; rows that share only the id are told apart by fp, a hash of
    the text. A null id is an id like others. An empty table gives no row. Only the two named columns are read.
    """
    made: list[str] = []
    mine = [F.col(id_col).alias("id"), F.hash(text_col).alias("fp")]
    lines = _lines(F.col(text_col))
    raw = docs.select(*mine, F.posexplode(lines).alias("pos", "line"))
    key = ascii_lower(F.trim(F.col("line"), F.lit(BLANKS)))
    keyed = raw.select("id", "fp", "pos", key.alias("key")).where(F.char_length("key") >= max(min_key, 1))
    occ = durable(keyed.select(F.xxhash64("key").alias("h1"), F.hash("key").alias("h2"), "id", "fp", "pos"), made)
    by = ["h1", "h2", "id", "fp"]
    ordered = occ.repartitionByRange(*by).sortWithinPartitions(*by, "pos")
    per = durable(ordered.groupBy(*by).agg(F.collect_set("pos").alias("pos")))
    drop_tables(docs.sparkSession, made)
    hot = per.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min(F.struct("id", "fp")).alias("first")).where(F.col("n") >= min_docs)
    hit = per.join(small(durable(hot)), ["h1", "h2"])
    if keep_first:
        here = F.struct("id", "fp").eqNullSafe(F.col("first"))
        hit = hit.withColumn("pos", F.when(here, F.array_remove("pos", F.array_min("pos"))).otherwise(F.col("pos")))
    drops = hit.groupBy("id", "fp").agg(F.array_sort(F.flatten(F.collect_list("pos"))).alias("drops")).where(F.size("drops") > 0)
    # counted apart: beside the explosion, a text would be split again for each of its lines
    sizes = docs.select(F.col(id_col).alias("i"), F.hash(text_col).alias("f"), F.size(lines).alias("n")).groupBy("i", "f").agg(F.max("n").alias("n_lines"))
    both = drops.join(sizes, F.col("id").eqNullSafe(F.col("i")) & (F.col("fp") == F.col("f")))
    return both.select("id", "fp", "n_lines", keep_bitmap(F.col("drops"), F.col("n_lines")).alias("keep"))


def keep_bitmap(drops: Column, n_lines: Column) -> Column:
    """A run-length bitmap: the runs of kept lines as structs of start and len."""
    starts = F.concat(F.array(F.lit(0)), F.transform(drops, lambda d: d + 1))
    ends = F.concat(drops, F.array(n_lines))
    runs = F.zip_with(starts, ends, lambda s, e: F.struct(s.alias("start"), (e - s).alias("len")))
    return F.filter(runs, lambda r: r["len"] > 0)


def apply_bitmaps(docs: DataFrame, bitmaps: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with n_lines, n_dropped, keep and kept_text; columns of these names are replaced, all others pass.

    A row without a bitmap keeps all its lines. Rows that repeat an id and text get the same answer, each for itself.
    """
    rows = docs.drop("n_lines", "n_dropped", "keep", "kept_text")
    marks = bitmaps.select(F.col("id").alias("__op5_id"), F.col("fp").alias("__op5_fp"), F.col("keep").alias("__op5_keep"))
    own = "`" + id_col.replace("`", "``") + "`"
    both = rows.join(marks, F.col(own).eqNullSafe(F.col("__op5_id")) & (F.hash(text_col) == F.col("__op5_fp")), "left")
    lines, runs = _lines(F.col(text_col)), F.col("__op5_keep")
    kept = F.flatten(F.transform(runs, lambda r: F.slice(lines, r["start"] + 1, r["len"])))
    text = F.when(runs.isNull(), F.coalesce(F.col(text_col), F.lit(""))).otherwise(F.array_join(kept, "\n"))
    left = F.aggregate(runs, F.lit(0), lambda n, r: n + r["len"])
    whole = F.array(F.struct(F.lit(0).alias("start"), F.size(lines).alias("len")))
    made = {"n_lines": F.size(lines), "n_dropped": F.coalesce(F.size(lines) - left, F.lit(0)), "keep": F.coalesce(runs, whole), "kept_text": text}
    return both.withColumns(made).drop("__op5_id", "__op5_fp", "__op5_keep")


def oracle_sql(min_docs: int = MIN_DOCS) -> str:
    return f"""
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, unnest(range(0, len(string_split(coalesce(text, ''), chr(10))))) AS pos FROM documents),
k AS (SELECT doc_id, pos, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
hot AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= {min_docs}),
m AS (SELECT k.*, hot.key IS NOT NULL AS dropped FROM k LEFT JOIN hot ON k.key = hot.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE dropped)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
