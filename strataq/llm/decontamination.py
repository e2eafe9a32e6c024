"""Benchmark decontamination: a prefix-filtered join of benchmark windows with documents, verified word by word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strataq.llm.common import BROADCAST_ROWS, UPPER, ascii_lower, durable

WINDOW = 10
SHINGLE = 5
#: What separates words, after A-Z are lower-cased.
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def with_words(df: DataFrame, text_col: str, out: str = "words") -> DataFrame:
    """df with the words of a text: lower-cased A-Z, split at what no word has. Null has none."""
    split = df.withColumn("__raw", F.split(ascii_lower(F.coalesce(text_col, F.lit(""))), NO_WORD, -1))
    lead = F.when(F.get("__raw", F.lit(0)) == "", 1).otherwise(0)
    trail = F.when(F.element_at("__raw", -1) == "", 1).otherwise(0)
    return split.withColumn(out, F.slice("__raw", lead + 1, F.greatest(F.size("__raw") - lead - trail, F.lit(0)))).drop("__raw")


def _hash(words: str, at: Column, k: int) -> Column:
    return F.xxhash64(*[F.get(words, at + i) for i in range(k)])


def benchmark_windows(items: DataFrame, window: int, shingle: int, id_col: str, text_col: str) -> DataFrame:
    """The different windows of all items: (window, wid, len, k, items); an item of fewer words, but not none, is one."""
    rows = with_words(items.select(F.coalesce(F.col(id_col).cast("string"), F.lit("null")).alias("item"), F.col(text_col).alias("t")), "t")
    n = F.size("words")
    cut = F.explode(F.transform(F.sequence(F.lit(0), F.greatest(n - window, F.lit(0))), lambda s: F.slice("words", s + 1, window)))
    every = rows.where(n > 0).select("item", cut.alias("window"))
    size = F.size("window")
    same = every.groupBy("window").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return same.select("window", F.xxhash64("window").alias("wid"), size.alias("len"), F.least(size, F.lit(shingle)).alias("k"), "items")


def _positions(docs: DataFrame, k: int) -> DataFrame:
    """(id, fp, words, p, h): each run of k words of each document, as a hash."""
    n = F.size("words")  # not filtered by: a filter below would split every text again
    runs = docs.withColumn("p", F.explode(F.when(n >= k, F.sequence(F.lit(0), n - k))))
    return runs.withColumn("h", _hash("words", F.col("p"), k))


def find_contamination(
    docs: DataFrame,
    items: DataFrame,
    window: int = WINDOW,
    shingle: int = SHINGLE,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
) -> DataFrame:
    """(id, fp, n_words, spans, items) for each document: the occurrences of benchmark windows, and whose they are.

    A window is so many consecutive words of an item; an item of fewer words, but not none, is one window. An
    occurrence needs all words of the window in order, so it holds each of the window's shingles. The shingles are
    ordered by how often they occur in all documents; each window is indexed by its rarest, and every run of words of
    every document looks that index up. Where it is met, the window must start and end within the document, and then
    all its words are compared.

    The index is broadcast if it was counted and is small; else runs of words (hash, document and position only) are
    shuffled by hash, and only documents with a candidate are read again to compare words.

    Nulls: a null text has no words, a null item id is the text 'null'; a null document id is kept. Documents without
    words have a row with n_words 0. Rows that repeat an id and a text are one document; rows that share only the id are
    told apart by fp, a hash of the text. Empty tables give no occurrences. Only the named columns are read.
    """
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("fp"), F.col(text_col).alias("t"))
    given = with_words(given, "t").drop("t")
    windows = durable(benchmark_windows(items, window, shingle, item_id_col, item_text_col))
    heads = given.select("id", "fp", F.size("words").alias("n_words"))
    parts = []
    for (k,) in sorted(windows.select("k").distinct().collect()):
        own = windows.where(F.col("k") == k)
        grams = own.select("*", F.explode(F.sequence(F.lit(0), F.col("len") - k)).alias("off"))
        grams = durable(grams.withColumn("h", _hash("window", F.col("off"), k)))
        is_small = grams.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
        mark = F.broadcast if is_small else (lambda x: x)
        known = grams.select("h").distinct()
        runs = _positions(given, k)
        counts = runs.select("h").join(mark(known), "h", "left_semi").groupBy("h").agg(F.count("*").alias("often"))
        # a shingle that no document has makes its window impossible; nothing needs to be looked up for it
        ranked = grams.join(durable(counts), "h", "left").fillna(0, ["often"])
        rarest = ranked.groupBy("wid", "window", "items", "len").agg(F.min(F.struct("often", "h", "off")).alias("r")).where("r.often > 0")
        text = F.array_join("window", " ").alias("text")
        index = durable(rarest.select(F.col("r.h").alias("h"), F.col("r.off").alias("off"), F.col("len").cast("int"), text, "items"))
        if is_small:
            met = runs.join(F.broadcast(index), "h")
        else:
            met = runs.drop("words").join(index, "h").withColumnsRenamed({"id": "i", "fp": "f"})
            met = met.join(given, F.col("i").eqNullSafe(F.col("id")) & (F.col("f") == F.col("fp")))
        # all of this becomes the join's condition, so no row that holds a whole text's words leaves the join
        start = F.col("p") - F.col("off")
        fits = (start >= 0) & (start + F.col("len") <= F.size("words"))
        met = met.where(fits & (F.array_join(F.slice("words", F.greatest(start + 1, F.lit(1)), F.col("len")), " ") == F.col("text")))
        parts.append(met.select("id", "fp", F.struct(start.alias("start"), (start + F.col("len")).alias("end")).alias("span"), "items"))
    rows = heads
    for part in parts:
        rows = rows.unionByName(part, allowMissingColumns=True)
    if not parts:
        rows = rows.withColumns({"span": F.lit(None).cast("struct<start:int,end:int>"), "items": F.lit(None).cast("array<string>")})
    spans, whose = F.array_sort(F.collect_set("span")), F.array_sort(F.array_distinct(F.flatten(F.collect_set("items"))))
    return rows.groupBy("id", "fp").agg(F.max("n_words").alias("n_words"), spans.alias("spans"), whose.alias("items"))


def covered(spans: Column) -> Column:
    """How many positions sorted spans cover together."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("to"))
    add = lambda a, s: F.struct((a["n"] + F.greatest(s["end"] - F.greatest(s["start"], a["to"]), F.lit(0))).alias("n"), F.greatest(a["to"], s["end"]).alias("to"))
    return F.aggregate(spans, zero, add, lambda a: a["n"])


def clean_documents(docs: DataFrame, items: DataFrame, *, most: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without those of whose words more than the share most lies in benchmark windows; all columns and rows else."""
    found = find_contamination(docs, items, id_col=id_col, text_col=text_col)
    bad = found.where(covered(F.col("spans")) > most * F.col("n_words")).select(F.col("id").alias("__op1_id"), F.col("fp").alias("__op1_fp"))
    own = F.col(f"`{id_col}`").eqNullSafe(F.col("__op1_id")) & (F.xxhash64(text_col) == F.col("__op1_fp"))
    return docs.join(durable(bad), own, "left_anti")


def oracle_sql(window: int = WINDOW) -> str:
    low = f"translate({{}}, '{UPPER}', '{UPPER.lower()}')"
    words = "regexp_extract_all(" + low + ", '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
    return f"""
WITH d AS (SELECT doc_id, {words.format("coalesce(text, '')")} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {words.format("coalesce(text, '')")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(len(w), {window}) AS n, array_to_string(w[i:i + least(len(w), {window}) - 1], ' ') AS t
  FROM b, range(1, 100000) r(i) WHERE len(w) > 0 AND i <= greatest(len(w) - {window} + 1, 1)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i:i + n - 1], ' ') AS t
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
m AS (SELECT doc_id, i, dw.n, item FROM dw JOIN bw ON dw.n = bw.n AND dw.t = bw.t),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM m) GROUP BY doc_id),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM m) GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h ON h.doc_id = d.doc_id LEFT JOIN it ON it.doc_id = d.doc_id
"""
