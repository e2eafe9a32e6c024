"""Classifiers are fitted on whole texts; what is bounded is how many."""

import numpy as np

from strataq.llm import quality, toxicity
from tests.llm.test_operators import table


def _long(spark):
    ids = [i for i in range(400) if (np.uint32(__import__("zlib").crc32(str(i).encode())) % 3) != 1]
    fill = " ".join(c * 4000 for c in "lanteo")
    texts = [(i, ("badmark snarkwig " if i % 2 else "fine tavenlo ") + fill) for i in ids[:40]]
    labels = spark.createDataFrame([(i, 1 - i % 2, i % 2) for i, _ in texts], "doc_id long, quality int, toxic int")
    return texts, table(spark, texts), labels


def test_marks_at_the_start_of_long_texts_are_learned(spark):
    texts, docs, labels = _long(spark)
    got, y = quality.training_rows(docs, labels, "toxic", 100)
    assert sorted(got) == sorted(t for _, t in texts) and sum(y) == sum(i % 2 for i, _ in texts)
    model = quality.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((s >= 0.5) == (i % 2 == 0) for i, s in scores.items())
    model = toxicity.train(docs, labels)
    scores = {r.doc_id: r.score for r in quality.score(docs, model).collect()}
    assert all((s >= toxicity.THRESHOLD) == (i % 2 == 1) for i, s in scores.items())


def test_bytes_bound_rows_and_not_texts(spark):
    texts, docs, labels = _long(spark)
    size = max(len(t) for _, t in texts)
    got, y = quality.training_rows(docs, labels, "toxic", 100, 10 * size)
    assert len(got) == len(y) and 9 <= len(got) <= 11 and set(got) <= {t for _, t in texts}
    assert quality.training_rows(docs, labels, "toxic", 100, size)[0] == []
