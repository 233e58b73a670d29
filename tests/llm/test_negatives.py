import random

import numpy as np
from pyspark.sql import functions as F

from pagetext.llm import negatives as N

SCHEMA = "vec_id bigint, embedding array<bigint>, label int, block string, key string, v string"


def brute(rows, positives=5, negatives=3):
    rows = [r for r in rows if r[0] is not None and r[2] is not None and r[1] is not None and None not in r[1]]
    out = []
    for a in (r for r in rows if r[0] % 50 == 0):
        scored = [(sum(x * y for x, y in zip(a[1], r[1])), r) for r in rows]
        near = sorted((-s, r[0]) for s, r in scored if r[2] == a[2] and r[0] != a[0])[:positives]
        for s, pid in near:
            far = sorted((-t, r[0]) for t, r in scored if r[2] != a[2] and 50 * -s <= 100 * t <= 95 * -s)[:negatives]
            out += [(a[0], pid, k + 1, nid, -s, -t) for k, (t, nid) in enumerate(far)]
    return sorted(out)


def test_strassen():
    rng = np.random.default_rng(1)
    for m, k, n in ((1, 1, 1), (33, 64, 35), (130, 67, 201), (64, 0, 64), (0, 5, 5)):
        a, b = rng.integers(-300, 300, (m, k)), rng.integers(-300, 300, (k, n))
        assert (N.strassen(a, b) == a @ b).all()
    a, b = rng.integers(-2**30, 2**30, (70, 70)), rng.integers(-2**25, 2**25, (70, 70))
    assert (N.strassen(a, b) == a @ b).all()


def test_against_brute_force(spark):
    rng = random.Random(3)
    vector = lambda n: [rng.randrange(-3, 9) for _ in range(n)]
    rows = [(i, vector(6), 0 if i % 3 == 0 else rng.randrange(40), "x", "y", "z") for i in range(600)]  # label 0 holds a third, others few
    rows += [(700 + i, rows[50][1], rng.randrange(3), "x", "y", "z") for i in range(30)]  # ties
    rows += [(800, [], 0, "x", "y", "z"), (850, [1, 2], 0, "x", "y", "z"), (851, vector(11), 1, "x", "y", "z"), (900, [0] * 6, 1, "x", "y", "z"), (None, vector(6), 1, "x", "y", "z"),
             (950, None, 1, "x", "y", "z"), (1000, [None, 1], 1, "x", "y", "z"), (1050, vector(6), None, "x", "y", "z"), (1100, [-5] * 6, 77, "x", "y", "z"), rows[0], rows[1]]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    want = brute(rows)
    for cells in (1 << 19, 150):
        got = N.mine_negatives(df, F.col("vec_id") % 50 == 0, block_cells=cells)
        assert got.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
        assert sorted(map(tuple, got.collect())) == want
    assert N.mine_negatives(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0
    assert N.mine_negatives(df.filter("vec_id % 50 > 0"), F.col("vec_id") % 50 == 0).count() == 0


def test_whole_vectors(spark):
    df = spark.createDataFrame([(1, [0.5, -0.001]), (2, [float("nan")]), (3, [float("inf")]), (4, None), (5, [None]), (6, [])], "id int, e array<float>")
    got = {r[0]: r[1] for r in df.filter(N.usable(F.col("e"))).select("id", N.whole_vector(F.col("e"))).collect()}
    assert got == {1: [128, -1], 6: []}
