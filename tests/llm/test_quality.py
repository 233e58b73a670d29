import random
import re
from collections import Counter

import numpy as np
import pytest

from pagetext.llm import quality as Q

from .conftest import prose


def brute(text):
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    windows = [tuple(words[i:i + 3]) for i in range(len(words) - 2)]
    times = Counter(windows)
    hit = {j for i, w in enumerate(windows) if times[w] > 1 for j in range(i, i + 3)}
    seen, dup = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(hit)]


@pytest.mark.parametrize("text", [None, "", " \n ", "a", "a b c", "a b c a b c", "a a a a", "x\nx\n\n \n x\nx", "a b c d a b c", "é é é ü é é é", "#*$%&|<> #a\n#a"])
def test_statistics(text):
    assert Q.statistics(text)[0] == brute(text)


def test_statistics_of_random_texts():
    rng = random.Random(1)
    for _ in range(200):
        t = "".join(rng.choice("ab \n#") for _ in range(rng.randrange(60)))
        assert Q.statistics(t)[0] == brute(t)


def walk(trees, x):
    out = trees.base
    for i in trees.roots:
        while trees.feature[i] >= 0:
            i = trees.left[i] if x[trees.feature[i]] <= trees.limit[i] else trees.right[i]
        out += trees.value[i]
    return out


def test_trees_learn_and_keep_their_constraints():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 3))
    y = ((x[:, 0] - x[:, 1] + 0.3 * np.sin(3 * x[:, 2]) + 0.3 * rng.normal(size=1500)) > 0).astype(float)
    trees = Q.boost(x, y, (1, -1, 0))
    assert np.mean((trees.score(x) > 0.5) == (y > 0.5)) > 0.9
    assert np.allclose([walk(trees, r) for r in x[:50]], trees.margin(x[:50]))
    probe = rng.normal(size=(100, 3))
    for f, way in ((0, 1), (1, -1)):
        line = np.repeat(probe, 40, axis=0)
        line[:, f] = np.tile(np.linspace(-4, 4, 40), 100)
        step = np.diff(trees.margin(line).reshape(100, 40), axis=1)
        assert (way * step >= -1e-12).all()


def test_rated_documents(spark, docs, doc_rows, no_docs):
    rng = random.Random(4)
    extra = [(1000 + i, prose(rng, "en", 120) if i % 2 else " ".join(w + "###" for w in prose(rng, "en", 120).split())) for i in range(80)]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(extra, "doc_id bigint, text string"))
    labels = spark.createDataFrame([(1000 + i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (5, None, 0), (99999, 0, 1)], "doc_id bigint, quality int, toxic int")
    model = Q.fit_quality(table, labels)
    rows = Q.rate_quality(table, model).collect()
    text = {**{r[0]: r[1] for r in doc_rows}, **dict(extra)}
    assert len(rows) == len(doc_rows) + 80
    for r in rows:
        if r.doc_id is not None:
            b = brute(text[r.doc_id])
            assert [r[c] for c in Q.BASE] == b
            assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0]) and not (r.kept and r.base_failed)
    by = {r.doc_id: r for r in rows}
    assert all(by[1000 + i].kept == bool(i % 2) for i in range(60, 80))  # not labelled
    assert Q.fit_quality(no_docs, labels) is None
    assert {r.kept == (not r.base_failed) for r in Q.rate_quality(table, None).collect()} == {True}
    assert Q.rate_quality(no_docs, model).count() == 0
