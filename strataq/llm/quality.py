"""A quality classifier: hashed word n-grams, logistic regression, follow-the-regularised-leader updates."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from strataq.llm.common import drop_tables, durable, ship
from strataq.llm.tokens import TABLE, chunks, mix, run_hashes

#: At most about so many labelled rows are fitted on, those of least hash; so the driver's share is bounded.
TRAIN_ROWS = 6_000
#: And on so many bytes of text together: rows are fewer if they are long, but whole. One of more than a quarter is passed over.
TRAIN_BYTES = 1 << 25
BITS = 20
REPEAT = np.uint64(0xC2B2AE3D27D4EB4F)
THRESHOLD = 0.5
#: Blank, letter or digit (with all bytes of other scripts), and the rest.
_KIND = np.full(256, 2, np.uint8)
_KIND[[9, 10, 11, 12, 13, 32]] = 0
for _lo, _hi in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _KIND[_lo:_hi] = 1


def features(data: np.ndarray, offsets: np.ndarray, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers of the unigrams and bigrams of words and marks, and of the runs of each text in them."""
    n = len(data)
    kind = _KIND[data]
    cut = np.ones(n + 1, bool)
    cut[1:n] = kind[1:] != kind[:-1]
    cut[offsets] = True
    at = np.flatnonzero(cut)
    starts, ends = at[:-1], at[1:]
    real = kind[starts] != 0 if n else np.zeros(0, bool)
    starts, ends = starts[real], ends[real]
    h = run_hashes(TABLE[data], starts, ends)
    first = np.searchsorted(starts, offsets)
    two = np.zeros(len(h), np.uint64)
    if len(h):
        two[1:] = mix(h[:-1] * np.uint64(3) + h[1:])
        two[1:][h[1:] == h[:-1]] = REPEAT  # any word followed by itself is one bigram
        two[first[:-1][first[:-1] < len(h)]] = np.uint64(0)  # no bigram reaches over a text's start
    both = np.empty(2 * len(h), np.int64)
    both[0::2] = h >> np.uint64(64 - bits)
    both[1::2] = two >> np.uint64(64 - bits)
    return both, 2 * first


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    bits: int = BITS

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Sparse dot products; a feature's value is its count over the square root of the text's features."""
        f, first = features(data, offsets, self.bits)
        total = np.concatenate([[0.0], np.cumsum(self.weights[f], dtype=np.float64)])
        n = np.diff(first)
        return self.bias + (total[first[1:]] - total[first[:-1]]) / np.sqrt(np.maximum(n, 1))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(text, y) to (ids, n, y): the buckets of each whole text and how often it has them."""
    for b in batches:
        ids, counts = [], []
        for _, _, data, offsets in chunks(b.column(0)):
            f, first = features(data, offsets)
            for i, j in zip(first[:-1], first[1:], strict=True):
                k, n = np.unique(f[i:j], return_counts=True)
                ids.append(k.astype(np.int32).tobytes())
                counts.append(n.astype(np.int32).tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(counts, pa.binary()), b.column(1)], names=["ids", "n", "y"])


def fit(texts: list[str], labels: list[int], *, bits: int = BITS, **how) -> Model:
    """fit_counts() of the texts' features."""
    counted = []
    for t in texts:
        b = np.frombuffer(t.encode(), np.uint8)
        counted.append(np.unique(features(b, np.array([0, len(b)]), bits)[0], return_counts=True))
    return fit_counts(counted, labels, bits=bits, **how)


def fit_counts(counted: list[tuple[np.ndarray, np.ndarray]], labels: list[int], *, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1, rounds: int = 3) -> Model:
    """FTRL-proximal, one text at a time; classes weigh alike. Without rows of both classes, the share of ones is the score."""
    y = np.array(labels, float)
    ones = y.mean() if len(y) else 0.5
    if not 0 < ones < 1:
        return Model(np.zeros(1 << bits, np.float32), float(np.log((ones + 0.01) / (1.01 - ones))), bits)
    rows = [(ids, n / np.sqrt(max(n.sum(), 1))) for ids, n in counted]
    z, g2 = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)
    last = 1 << bits  # the bias, without l1

    def weight(i: np.ndarray) -> np.ndarray:
        pull = np.where(i == last, 0.0, l1)
        return np.where(np.abs(z[i]) <= pull, 0.0, -(z[i] - np.sign(z[i]) * pull) / ((beta + np.sqrt(g2[i])) / alpha + l2))

    rng = np.random.default_rng(3)
    per = np.where(y == 1, 0.5 / ones, 0.5 / (1 - ones))
    for _ in range(rounds):
        for r in rng.permutation(len(rows)):
            i, x = np.append(rows[r][0], last), np.append(rows[r][1], 1.0)
            w = weight(i)
            p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
            g = (p - y[r]) * x * per[r]
            z[i] += g - (np.sqrt(g2[i] + g * g) - np.sqrt(g2[i])) / alpha * w
            g2[i] += g * g
    w = weight(np.arange(last + 1))
    return Model(w[:last].astype(np.float32), float(w[last]), bits)


def held_out(id_col: str = "doc_id") -> F.Column:
    """Whether a document's label may not be learned; false for a null id, which has no label."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, most: int, made: list[str]) -> DataFrame:
    """(h, text, y): whole texts and labels of about so many labelled rows that aren't held out, of least hash h.

    Together they have at most so many bytes: rows from some hash on are left out.
    """
    kept = labels.where(F.col(label).isin(0, 1) & ~held_out()).select("doc_id", F.col(label).cast("int").alias("y")).distinct()
    sample = kept.orderBy(F.xxhash64("doc_id"), "doc_id", "y").limit(rows)
    got = docs.join(F.broadcast(sample), "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "y")
    got = durable(got.where(F.octet_length("text") <= most // 4), made)
    sizes = got.groupBy("h").agg(F.sum(F.octet_length("text")).alias("n")).orderBy("h").collect()
    total = np.cumsum([r.n for r in sizes])
    over = int(np.searchsorted(total, most, "right"))
    return got if over == len(sizes) else got.where(F.col("h") < sizes[over].h)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int, most: int = TRAIN_BYTES) -> tuple[list[str], list[int]]:
    """Whole texts and labels of about so many labelled rows that aren't held out, of least hash; bounded in rows and bytes."""
    made: list[str] = []
    got = sorted(_sample(docs, labels, label, rows, most, made).select("text", "y").collect())
    drop_tables(docs.sparkSession, made)
    return [r[0] for r in got], [r[1] for r in got]


def train(docs: DataFrame, labels: DataFrame, *, label: str = "quality", rows: int = TRAIN_ROWS) -> Model:
    """The features are counted on the executors, on whole texts; the driver gets the counts."""
    spark = docs.sparkSession
    ship(spark)
    made: list[str] = []
    sample = _sample(docs, labels, label, rows, TRAIN_BYTES, made).select("text", "y")
    got = sorted(sample.mapInArrow(_counts, "ids binary, n binary, y int").collect())
    drop_tables(spark, made)
    return fit_counts([(np.frombuffer(r[0], np.int32), np.frombuffer(r[1], np.int32)) for r in got], [r[2] for r in got])


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text", score_col: str = "score", keep: list[str] | None = None) -> DataFrame:
    """Columns keep (the id, if none are named) and a score from 0 to 1 for each whole text.

    Null and empty texts score as texts without words: the bias alone. Repeated rows score each for itself; a null id
    stays. An empty table gives an empty result. A column that has the score's name is replaced, if it is kept.
    """
    names = [c for c in (keep if keep is not None else [id_col]) if c != score_col]
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)
    # under plain names: mapInArrow knows no others
    given = docs.select(*[F.col("`" + c.replace("`", "``") + "`").alias(f"c{k}") for k, c in enumerate(names)], F.col(text_col).alias("text"))
    plain = [*given.columns[:-1], "score"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            x = np.zeros(len(b))
            for i, j, data, offsets in chunks(b.column(len(names))):
                x[i:j] = m.logits(data, offsets)
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(1 / (1 + np.exp(-np.clip(x, -40, 40))))], names=plain)

    schema = T.StructType([*given.schema.fields[:-1], T.StructField("score", T.DoubleType())])
    return given.mapInArrow(run, schema).toDF(*names, score_col)
