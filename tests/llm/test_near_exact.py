"""Pairs that pass the exact prefix join are compared on full sets, whatever their minhashes say."""

import dataclasses
import random

from strataq.llm import near_dedup
from tests.llm.test_operators import brute_components, table


def test_minhashes_rule_out_no_link(spark, monkeypatch):
    rng = random.Random(12)
    texts = []
    for g in range(12):
        core = [f"g{g}w{i}" for i in range(80)]
        texts += [" ".join(core), " ".join([*core, *[f"e{rng.randrange(10**6)}" for _ in range(rng.randrange(1, 6))]])]
    want = brute_components(list(enumerate(texts)))
    assert sum(not v[2] for v in want.values()) == 12
    usual = near_dedup.limits
    monkeypatch.setattr(near_dedup, "limits", lambda t: dataclasses.replace(usual(t), agree=near_dedup.HASHES + 1))
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in near_dedup.near_duplicates(table(spark, texts)).collect()}
    assert got == want
