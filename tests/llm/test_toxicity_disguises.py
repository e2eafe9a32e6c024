"""Toxicity of disguised insults: the kernel runs over windows of whole texts and measures gaps in code points."""

import random

import numpy as np
import pyarrow as pa
import pytest

from strataq.llm import toxicity
from strataq.llm.tokens import chunks
from tests.llm.test_operators import _labelled

DISGUISES = {
    "blank": lambda w: w[:3] + " " + w[3:],
    "blanks": " ".join,
    "two blanks": "  ".join,
    "two marks": "--".join,
    "middle dots": "·".join,
    "zero width": "​".join,
    "blanks and marks": " - ".join,
    "accents": lambda w: w.replace("a", "á").replace("o", "ö"),
    "capitals": str.upper,
}


@pytest.fixture(scope="module")
def model():
    rows = _labelled(random.Random(7), 600)
    return toxicity.fit([r[0] for r in rows], [r[2] for r in rows])


def scores(model, texts):
    out = np.concatenate([model.logits(data, offsets) for _, _, data, offsets in chunks(pa.array(texts))])
    return 1 / (1 + np.exp(-out))


@pytest.mark.parametrize("kind", DISGUISES)
def test_disguised(model, kind):
    words = [r[0] for r in _labelled(random.Random(8), 60) if not r[2]][:20]
    assert (scores(model, words) < toxicity.THRESHOLD).all()
    for insult in ("grumpfot", "snarkwig", "blorpish"):
        texts = [t.replace(" ", f" {DISGUISES[kind](insult)} ", 1) for t in words]
        assert (scores(model, texts) >= toxicity.THRESHOLD).mean() >= 0.9, insult


def test_short_insults():
    rng = random.Random(5)
    rows = [(r[0] + (f" {rng.choice(('zog', 'ux'))} lar" if i % 3 == 0 else ""), int(i % 3 == 0)) for i, r in enumerate(_labelled(rng, 600)) if not r[2]]
    m = toxicity.fit([r[0] for r in rows[:300]], [r[1] for r in rows[:300]])
    got = scores(m, [r[0] for r in rows[300:]]) >= toxicity.THRESHOLD
    assert (got == np.array([r[1] for r in rows[300:]], bool)).mean() >= 0.97


def test_windows_against_plain_sums():
    texts = ["ab c · déf  ghi-j 漢字 k", "", " -- ", "x" * 75 + " no", "l m"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t.encode()) for t in texts])])
    codes, pos, *words = toxicity.letters(data, offsets)
    a, b, row = toxicity.windows(*words)
    table = np.random.default_rng(1).normal(size=toxicity.SPACE).astype(np.float32)
    total, norm = toxicity.sums(codes, pos, table, a, b)
    assert set(row) == {0, 3, 4}
    for i, (s, e) in enumerate(zip(a, b, strict=True)):
        c, p, _ = toxicity.layout([(codes[s:e], pos[s:e])])
        some = [(float((w * table[k]).sum()), float((w * w).sum())) for _, w, k in toxicity.occurrences(c, p)]
        assert abs(sum(x for x, _ in some) - total[i]) < 1e-3 and abs(np.sqrt(sum(q for _, q in some) + 0.25) - norm[i]) < 1e-3
