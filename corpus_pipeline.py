"""A corpus from raw documents: quality, near-duplicates, benchmark leaks, mixing of sources, shards."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from strataq.llm import decontamination, mixing, near_dedup, quality, sharding
from strataq.llm.common import durable, table

#: Jaccard similarity of shingle sets from which on the stage takes documents as copies; op3_near_dedup has its own.
NEAR = 0.8


def _fresh(docs: DataFrame, name: str) -> str:
    """A column name that docs does not have, in any case."""
    taken = {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    return name


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on the labelled ones among docs, doesn't reject.

    Null and empty texts score as texts without words, and go or stay by that; repeated rows share their score. A null
    doc_id has no label and is scored like others. Without labelled rows, the share of good ones (a half) is the score, so
    all stay. An empty table stays empty. All columns of docs pass, whatever their names.
    """
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    score = _fresh(docs, "__score")
    scored = quality.score(docs, model, score_col=score, keep=docs.columns)
    return scored.where(F.col(score) >= quality.THRESHOLD).drop(score)


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of least doc_id, of each group that links of similarity NEAR or more join.

    Null and empty texts are linked with nothing and stay. Rows that repeat a doc_id are one document and stay or go
    together; a null doc_id is an id that comes before all others. An empty table stays empty; all columns pass.
    """
    return near_dedup.drop_near_duplicates(docs, NEAR)


def keep_clean(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of a benchmark item.

    Null and empty texts have no words and stay, as do null doc_ids and repeated rows with clean texts. An empty table
    of documents or items takes nothing away; all columns pass.
    """
    return decontamination.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated, or left out, so that sources get their target weights.

    Rows of null sources belong to the unnamed rest; rows with null doc_ids draw by their contents; repeated rows draw
    alike. Texts don't matter. An empty table stays empty; all columns pass, whatever their names.
    """
    copy = _fresh(docs, "__copy")
    return mixing.mix_sources(docs, copy_col=copy).drop(copy)


def shard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their shard, its depth and bytes; columns of those names are replaced, others pass.

    Null and empty texts have no bytes; null doc_ids share a hash; copies of one doc_id that overflow a shard are dealt
    over several. An empty table stays empty.
    """
    return sharding.shard_documents(docs)


STAGES = [
    ("quality classifier", keep_good),
    ("near-duplicates", keep_one_of_each_group),
    ("benchmark decontamination", keep_clean),
    ("mixing sources", mix),
    ("sharding", shard),
]

#: A trained classifier is not SQL; tests/llm/test_pipeline.py has a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = durable(docs)
    return docs
