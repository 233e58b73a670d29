import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetext.llm import neighbours as N


def brute(rows, k, ask):
    out = {}
    for qi, q in rows:
        if ask(qi):
            scored = sorted((-sum(a * b for a, b in zip(q, v)), i) for i, v in rows if i != qi)
            out[qi] = [(i, -s) for s, i in scored[:k]]
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id bigint, embedding array<float>, id string, block int").repartition(3)


@pytest.mark.parametrize("scale", [False, True])
def test_recall_against_brute_force(spark, scale):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(1200, 16)) + rng.normal(size=(12, 16))[rng.integers(0, 12, 1200)] * 2
    v = v * (rng.random((1200, 1)) * 3 + 0.1) if scale else v / np.linalg.norm(v, axis=1, keepdims=True)
    v[700:900] = v[3]  # a large group of copies
    rows = [(int(i), [float(x) for x in np.float32(a)]) for i, a in enumerate(v)]
    want = brute(rows, 20, lambda i: i % 20 == 0)
    got = {}
    for r in N.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0, block_rows=200).collect():
        got.setdefault(r.query_id, {})[r.rank] = (r.vec_id, r.score)
    assert got.keys() == want.keys() and all(sorted(g) == list(range(1, 21)) for g in got.values())
    recall = np.mean([len({i for i, _ in got[q].values()} & {i for i, _ in want[q]}) / 20 for q in want])
    assert recall >= 0.9
    vec = dict(rows)
    for q, g in got.items():
        order = [g[i] for i in range(1, 21)]
        assert order == sorted(order, key=lambda x: (-x[1], x[0]))
        assert all(abs(s - np.dot(vec[q], vec[i])) < 1e-9 for i, s in order)
        if q == 700:
            assert [i for i, _ in order] == [i for i, _ in want[q]]  # ties go to the smaller ids


def test_sure_of_one_is_exact(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.float32(a)]) for i, a in enumerate(rng.normal(size=(300, 6)))]
    got = N.nearest_neighbours(frame(spark, rows), F.col("vec_id") < 30, k=5, sure=1.0, block_rows=40).collect()
    want = brute(rows, 5, lambda i: i < 30)
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == {(q, n + 1, i) for q, found in want.items() for n, (i, _) in enumerate(found)}


def test_unusable_vectors_and_few_candidates(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (20, [0.0, 0.0]), (40, None), (60, [nan, 1.0]), (80, [inf, 1.0]), (100, [1.0, None]), (120, []), (None, [1.0, 1.0]), (140, [1.0, 2.0, 3.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5]), (2, [0.5, 0.5]), (0, [2.0, 0.0])]
    got = [tuple(r) for r in N.nearest_neighbours(frame(spark, rows), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect()]
    assert {g[0] for g in got} == {0} and {g[2] for g in got} == {1, 2}
    assert N.nearest_neighbours(frame(spark, []), F.col("vec_id") % 20 == 0).count() == 0
    assert N.nearest_neighbours(frame(spark, rows[1:7]), F.col("vec_id") % 20 == 0).count() == 0


def test_chi_square():
    rng = random.Random(0)
    draws = sorted(sum(rng.gauss(0, 1) ** 2 for _ in range(8)) for _ in range(20000))
    for share in (0.1, 0.5, 0.9):
        assert abs(N.chi2_cdf(np.array([draws[int(share * 20000)]]), 8)[0] - share) < 0.02
