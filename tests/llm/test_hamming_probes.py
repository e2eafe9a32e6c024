"""Lookups of the Hamming search: even segments, and no more of them than a query's kth distance asks for."""

import random

import pytest

from strataq.llm import hamming_search


def test_probes_follow_the_kth_distance(spark, monkeypatch):
    rng = random.Random(1)
    codes = [[rng.choice((-1.0, 1.0)) for _ in range(64)] for _ in range(800)]
    for i in range(10, 40):  # near copies, so that some queries are done early
        codes[i] = [-x if rng.random() < 0.1 else x for x in codes[0]]
    df = spark.createDataFrame(list(enumerate(codes)), "vec_id long, embedding array<float>")
    asked, probes, real = df.where("vec_id % 50 = 0"), [], hamming_search.flips

    def flips(rows, *a):
        out = real(rows, *a)
        probes.append(out.count())
        return out

    monkeypatch.setattr(hamming_search, "flips", flips)
    got = sorted(tuple(r) for r in hamming_search.top_k(df, asked).collect())
    want = []
    for q in range(0, 800, 50):
        near = sorted((sum(a != b for a, b in zip(codes[q], c, strict=True)), i) for i, c in enumerate(codes))[:10]
        want += [(q, n + 1, i, d) for n, (d, i) in enumerate(near)]
    assert got == want
    assert sum(probes) < 2_500  # 4,200 with all segments in each round, of 7 bits and a last one of 1


@pytest.mark.parametrize(("bits", "rows"), [(64, 500), (64, 10_256), (64, 12_000), (64, 51_282), (64, 10**9), (1, 0), (3, 100), (30, 10**9), (1024, 50_000)])
def test_segments_are_even(bits, rows):
    widths = hamming_search.segment_widths(bits, rows)
    assert sum(widths) == bits and 0 <= widths[0] - widths[-1] <= 1 <= widths[-1] and widths[0] <= 24
    assert widths == sorted(widths, reverse=True)


def test_equal_codes_are_dealt_out(spark):
    """Of 1,500 rows of one code, no task gets many; their smallest ids are kept, and rows that repeat count once."""
    conf = {"spark.sql.shuffle.partitions": "100", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {c: spark.conf.get(c) for c in conf}
    rows = [(i, [7, 7]) for i in range(3_000, 1_500, -1)] + [(1_501, [7, 7])] * 30 + [(i, [i, 1]) for i in range(1_500)] + [(5_000, [3, 1])]
    store, jvm = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._jvm
    stages = lambda: {(s.stageId(), s.attemptId()) for s in (found.apply(i) for found in [store.stageList(None, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())] for i in range(found.size()))}
    old = stages()
    try:
        for c, v in conf.items():
            spark.conf.set(c, v)
        coded = spark.createDataFrame(rows, "id long, code array<int>").repartition(100)
        got = {tuple(r.code): r.ids for r in hamming_search.smallest_ids(coded, 10).collect()}
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert got == {(7, 7): list(range(1_501, 1_511)), **{(i, 1): [i] for i in range(1_500)}, (3, 1): [3, 5_000]}
    read = []
    for s in stages() - old:
        tasks = store.taskList(*s, 1_000)
        read += [t.taskMetrics().get().shuffleReadMetrics().recordsRead() for t in (tasks.apply(i) for i in range(tasks.size())) if t.taskMetrics().isDefined()]
    assert sum(read) >= 3_000 and max(read) < 300  # 994 where each task's smallest of a code meet at once
