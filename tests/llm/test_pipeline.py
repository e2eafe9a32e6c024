"""The pipeline on the smallest test tables, stage by stage against plain versions of the stages."""

import os
import re

import pytest

import corpus_pipeline
from strataq.llm import queries
from tests.llm.test_operators import LOWER, brute_components

DATA = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, kept = docs.columns, [docs]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, kept[-1], DATA).write.parquet(str(tmp_path / str(i)))
        kept.append(spark.read.parquet(str(tmp_path / str(i))))
        if i + 1 < len(corpus_pipeline.STAGES):
            assert kept[-1].columns == columns
    good, single, clean, mixed, sharded = ([r.asDict() for r in k.collect()] for k in kept[1:])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{DATA}/labels.parquet").collect()}
    left = {r["doc_id"] for r in good}
    assert sum(i in left for i, y in labels.items() if y) >= 0.95 * sum(labels.values())
    want = brute_components([(r["doc_id"], r["text"]) for r in good])
    assert {r["doc_id"] for r in single} == {i for i, v in want.items() if v[2]}
    split = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    wins = set()
    for r in spark.read.parquet(f"{DATA}/benchmark.parquet").collect():
        w = split(r.text)
        n = min(10, len(w))
        wins |= {tuple(w[k : k + n]) for k in range(len(w) - n + 1)} if w else set()
    sizes = {len(w) for w in wins}
    leaks = {r["doc_id"] for r in single if any(tuple(w[k : k + n]) in wins for w in [split(r["text"])] for n in sizes for k in range(len(w) - n + 1))}
    assert {r["doc_id"] for r in clean} == {r["doc_id"] for r in single} - leaks
    assert {r["doc_id"] for r in mixed} <= {r["doc_id"] for r in clean} and len(sharded) == len(mixed)
    assert sorted(map(str, (r["doc_id"] for r in sharded))) == sorted(map(str, (r["doc_id"] for r in mixed)))


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_registered(spark):
    names = queries.queries()
    assert sorted(int(n[2:].split("_")[0]) for n in names) == list(range(1, 11))
    assert set(queries.oracle_sql()) <= set(names)
