"""The threshold of near-duplicates: the pipeline's stage links at 0.8, op3 at 0.85."""

import math

import pytest

import corpus_pipeline
from strataq.llm import near_dedup
from tests.llm.test_operators import shingles, table


def test_limits():
    assert near_dedup.limits(0.85) == near_dedup.Limits(17, 20, 4, 16, 90)
    for s in (0.1, 0.3, 0.5, 0.8, 0.85, 0.95):
        m = near_dedup.limits(s)
        assert (1 - s**m.least) ** m.trees <= near_dedup.MISS and m.least <= m.stride
        assert (m.trees - 1) * m.stride + m.depth <= near_dedup.HASHES
        assert sum(math.comb(128, k) * s**k * (1 - s) ** (128 - k) for k in range(m.agree)) <= near_dedup.MISS
    assert near_dedup.limits(1).agree == 128
    for s in (0, 1.1, 0.01):
        with pytest.raises(ValueError):
            near_dedup.limits(s)


def test_stage_links_from_eight_tenths(spark):
    base = [f"b{i}" for i in range(100)]
    other = [*base[:90], *[f"x{i}" for i in range(10)]]  # 86 of 106 shingles
    less = [*base[:88], *[f"y{i}" for i in range(12)]]  # 84 of 108 with base, 84 of 108 with other
    texts = [" ".join(w) for w in (base, other, less)]
    a, b, c = map(shingles, texts)
    assert 0.8 <= len(a & b) / len(a | b) < 0.85 and max(len(a & c) / len(a | c), len(b & c) / len(b | c)) < 0.8
    docs = table(spark, texts)
    assert sorted(r.doc_id for r in corpus_pipeline.keep_one_of_each_group(spark, docs, "").collect()) == [0, 2]
    assert all(r.kept for r in near_dedup.near_duplicates(docs).collect())
