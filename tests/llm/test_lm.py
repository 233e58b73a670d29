import math
import zlib
from collections import Counter

import numpy as np
import pytest

from pagetext.llm import lm as L


def fold(i):
    return zlib.crc32(("" if i is None else str(i)).encode()) % 7


def tokens(text):
    return (text or "").encode().lower().split() + [None]


def grams(ts, k):
    padded = ["<s>"] * (k - 1) + ts
    return [tuple(padded[i:i + k]) for i in range(len(ts))]


def brute(rows, order, weights):
    train = [tokens(t) for i, t in rows if fold(i) != 2]
    counts = [Counter(g for ts in train for g in grams(ts, k)) for k in range(1, order + 1)]
    n, v, out = sum(counts[0].values()), len(counts[0]), []
    for i, t in rows:
        ts, score, base = tokens(t), 0.0, 0.0
        gs = [grams(ts, k) for k in range(1, order + 1)]
        for j in range(len(ts)):
            p, context = [1 / (v + 1), counts[0][gs[0][j]] / n], 0
            for k in range(2, order + 1):
                c = gs[k - 1][j][:-1]
                context = len(train) if set(c) == {"<s>"} else counts[k - 2][c]
                p.append(counts[k - 1][gs[k - 1][j]] / context if context else 0.0)
            score += math.log10(sum(a * b for a, b in zip(weights(context.bit_length() if order > 1 else 0), p)))
            base += math.log10((counts[0][gs[0][j]] + 1) / (n + v + 1))
        out.append((i, fold(i) == 2, len(ts), sum(counts[0][g] > 0 for g in gs[0]), n, base, score))
    return out


@pytest.mark.parametrize("order", [1, 2, 3])
def test_scores_equal_brute_force(docs, doc_rows, order, monkeypatch):
    fixed = {b: np.arange(order + 1, 0, -1) + (0.1 * b if b >= 0 else 0) for b in range(-1, 40)}
    fixed = {b: w / w.sum() for b, w in fixed.items()}
    monkeypatch.setattr(L, "learn_weights", lambda cells, order: fixed)
    got = sorted((tuple(r) for r in L.score_texts(docs, order=order, block_chars=20000).collect()), key=str)
    want = sorted(brute([(r[0], r[1]) for r in doc_rows], order, lambda b: fixed[b]), key=str)
    assert len(got) == len(want)
    for g, w in zip(sorted(got, key=lambda r: (r[0] is None, r[0] or 0, r[2])), sorted(want, key=lambda r: (r[0] is None, r[0] or 0, r[2]))):
        assert g[:5] == w[:5] and math.isclose(g[5], w[5], rel_tol=1e-9) and math.isclose(g[6], w[6], rel_tol=1e-9)


def test_blocks_do_not_matter(docs):
    a = sorted(map(str, L.score_texts(docs, block_chars=1 << 24).select("doc_id", "n_tokens", "n_known", "train_tokens").collect()))
    assert a == sorted(map(str, L.score_texts(docs, block_chars=5000).select("doc_id", "n_tokens", "n_known", "train_tokens").collect()))


def test_learned_weights_beat_the_base(docs):
    rows = L.score_texts(docs).filter("held_out").collect()
    assert rows and sum(r.score for r in rows) > sum(r.base_score for r in rows) and all(r.score <= 0 for r in rows)


def test_expectation_maximisation_finds_the_mixture():
    rng = np.random.default_rng(0)
    true = np.array([0.1, 0.6, 0.3])
    ratio = np.round(4 * rng.normal(size=(5000, 2)) * 3)
    p = np.concatenate([np.ones((5000, 1)), np.exp2(ratio / 4)], axis=1)
    # Counts in proportion to the mixture make it the best one.
    cells = np.concatenate([np.full((5000, 1), 3.0), ratio, (1000 * (p @ true) / (p @ np.ones(3)))[:, None]], axis=1)
    w = L.learn_weights(cells, 2)[3]
    loss = lambda x: -(cells[:, -1] * np.log(p @ x)).sum()
    assert abs(w.sum() - 1) < 1e-9 and all(loss(w) <= loss(y) + 1e-3 * abs(loss(y)) for y in rng.dirichlet(np.ones(3), 200))


def test_empty_and_untrained(spark, no_docs):
    assert L.score_texts(no_docs).count() == 0
    held = [i for i in range(100) if fold(i) == 2][:3]
    rows = L.score_texts(spark.createDataFrame([(i, "a b") for i in held], "doc_id bigint, text string")).collect()
    assert [(r.n_tokens, r.n_known, r.train_tokens, r.base_score) for r in rows] == [(3, 0, 0, 0.0)] * 3


def test_estimates_are_held_for_a_slice_of_a_block():
    import tracemalloc

    import pyarrow as pa

    texts = pa.chunked_array([[" ".join(f"w{(k * k + j) % 4001}" for k in range(60_000)) for j in range(20)]])
    b = L.Block(texts, np.zeros(20, np.int64), 2)
    counts = pa.table({"bucket": [0, 1], "total": pa.array([np.full(len(d), 3) for d in b.distinct], pa.list_(pa.int64()))})
    docs = pa.table({"doc_id": list(range(20)), "text": texts, "role": np.zeros(20, np.int64)})
    weights = {-1: np.full(3, 1 / 3)}
    tracemalloc.start()
    L.Block(texts, np.zeros(20, np.int64), 2)
    block = tracemalloc.get_traced_memory()[1]
    tracemalloc.reset_peak()
    out = L._scores(2, 1, 100, 10, weights)(docs, counts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert out["n_tokens"].to_pylist() == [60_001] * 20 and out["n_known"].to_pylist() == [60_001] * 20
    assert peak < 1.5 * block, (peak, block)
