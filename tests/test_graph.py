"""Greedy passes over rivals against the sequential pass, whole, by component and in rounds."""

import random

import pytest

from pagetext.operators import graph as G


def sequential_dropped(edges):
    gone = set()
    for page in {e[0] for e in edges}:
        own = [e for e in edges if e[0] == page]
        for n in sorted({e[1] for e in own} | {e[2] for e in own}):
            if (page, n) not in gone:
                gone |= {(page, lose) for _, win, lose in own if win == n}
    return gone


def rivals(seed):
    rng = random.Random(seed)
    out = []
    for page in range(6):
        base = 0
        for _ in range(4):
            size = rng.randrange(2, 12)
            for _ in range(rng.randrange(1, 2 * size)):
                a, b = sorted(rng.sample(range(size), 2))
                out.append((page, base + a, base + b))
            base += 100
    return out


@pytest.mark.parametrize("fold_edges", [G.FOLD_EDGES, 8, 0])
def test_dropped(spark, fold_edges):
    edges = rivals(1)
    df = spark.createDataFrame(edges, "page long, win int, lose int")
    got = G.greedy_dropped(df, ["page"], fold_edges)
    assert got.columns == ["page", "n"]
    rows = [tuple(r) for r in got.collect()]
    assert set(rows) == sequential_dropped(edges) and len(rows) == len(set(rows))
    assert G.greedy_dropped(df.limit(0), ["page"], fold_edges).count() == 0


@pytest.mark.parametrize("fold_edges", [G.FOLD_EDGES, 8, 0])
def test_one_to_one(spark, fold_edges):
    pairs = sorted(set(rivals(2)))
    want, used = set(), set()
    for page, a, b in pairs:
        if ("a", page, a) not in used and ("b", page, b) not in used:
            used |= {("a", page, a), ("b", page, b)}
            want.add((page, a, b))
    got = G.greedy_one_to_one(spark.createDataFrame(pairs, "page long, gt int, det int"), ["page"], "gt", "det", fold_edges)
    assert {tuple(r) for r in got.collect()} == want


def test_a_long_chain_needs_no_rounds(spark, monkeypatch):
    monkeypatch.setattr(G, "_dropped_in_rounds", None)
    chain = spark.range(10000).selectExpr("1L as page", "int(id) as win", "int(id + 1) as lose")
    got = G.greedy_dropped(chain, ["page"])
    assert got.count() == 5000 and got.filter("n % 2 = 0").count() == 0
