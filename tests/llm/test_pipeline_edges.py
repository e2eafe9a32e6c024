"""Each stage of the pipeline on nulls, repeated rows, odd and clashing column names, and empty tables."""

from collections import Counter

import pytest
from pyspark.sql import functions as F

import corpus_pipeline

ODD = ("__score", "__copy", "score", "copy_no", "id", "fp", "h", "__id", "a`b", "words", "span")
STAGES = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("edges"))
    good = [(i, f"the river runs past the old mill number {i} and the town beyond it keeps its quiet market day {i * 7}") for i in range(60)]
    good[5] = (5, "one two three four five six seven eight nine ten eleven twelve of the leaked benchmark item")
    rows = [*good, (None, None), (None, "a text without an id but with a few plain words in it"), (200, ""), (200, ""), (201, None), (3, good[3][1]), (300, "x" * 300_000)]
    docs = spark.createDataFrame([(i, t, "en", None if (i or 0) % 9 == 0 else f"src{i % 5}", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs = docs.withColumns({c: F.lit(f"{c}!") for c in ODD})
    spark.createDataFrame([(i, 1, 0) for i in range(0, 60, 2)], "doc_id long, quality int, toxic int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame([(1, good[5][1]), (2, None), (None, "")], "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return docs.repartition(3), d


@pytest.mark.parametrize("name", list(STAGES))
def test_edges(spark, tables, name):
    docs, d = tables
    out = STAGES[name](spark, docs, d)
    more = ["shard", "depth", "shard_bytes"] if name == "sharding" else []
    assert out.columns[: len(docs.columns)] == docs.columns and sorted(out.columns[len(docs.columns) :]) == sorted(more)
    rows = out.collect()
    assert all(r[c] == f"{c}!" for r in rows for c in ODD)
    n = Counter((r.doc_id, r.text) for r in rows)
    if name == "quality classifier":
        assert sum(n.values()) == 67
    if name == "near-duplicates":
        assert n[(None, None)] == n[(201, None)] == 1 and n[(200, "")] == 2 and n[(300, "x" * 300_000)] == 1
        assert sum(k == 3 for k, _ in n.elements()) == 2
    if name == "benchmark decontamination":
        assert sum(n.values()) == 66 and not any(k == 5 for k, _ in n)
    if name == "sharding":
        assert sum(n.values()) == 67
    assert STAGES[name](spark, docs.limit(0), d).count() == 0
