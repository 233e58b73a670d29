import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from pagetext.llm import language as G

from .conftest import prose


@pytest.fixture(scope="module")
def model(docs):
    return G.fit_language(G.training_rows(docs))


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(0)
    lens, size = np.array([3, 1, 4]), 3
    em, start, step = rng.normal(size=(lens.sum(), size)), rng.normal(size=size), rng.normal(size=(size, size))
    post, starts, moves = G.forward_backward(em, lens, start, step, moves=True)
    want, want_moves, want_starts, at = np.zeros_like(em), np.zeros((size, size)), np.zeros(size), 0
    for n in lens:
        paths = list(itertools.product(range(size), repeat=int(n)))
        score = np.array([start[p[0]] + sum(em[at + i, c] for i, c in enumerate(p)) + sum(step[a, b] for a, b in zip(p, p[1:])) for p in paths])
        share = np.exp(score - score.max())
        share /= share.sum()
        for p, s in zip(paths, share):
            want_starts[p[0]] += s
            for i, c in enumerate(p):
                want[at + i, c] += s
            for a, b in zip(p, p[1:]):
                want_moves[a, b] += s
        at += n
    assert np.allclose(post, want) and np.allclose(moves, want_moves) and np.allclose(starts, want_starts)


def test_predictions(docs, doc_rows, model):
    got = {r.doc_id: r for r in G.identify_language(docs, model).collect()}
    for i in (310, 311, 312, 313):
        assert (got[i].lang_pred, got[i].lang_score) == ("und", 0.0)
    told = [(got[r[0]].lang_pred, r[2]) for r in doc_rows if r[0] is not None and r[0] < 120]
    assert np.mean([a == b for a, b in told]) > 0.95
    assert all(0 <= r.lang_score <= 1 for r in got.values())
    assert got[300].lang_pred == "de"  # longer than one chain


def test_only_the_text_counts(docs, model):
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit("q")).withColumn("doc_id", -F.col("doc_id")).withColumn("lang_pred", F.lit("old"))
    a = sorted((r.lang_pred, r.lang_score) for r in G.identify_language(docs, model).collect())
    assert a == sorted((r.lang_pred, r.lang_score) for r in G.identify_language(other, model).collect())


def test_code_switching(spark, model):
    rng = random.Random(9)
    text = " ".join([prose(rng, "en", 40), prose(rng, "de", 40), prose(rng, "fr", 40)])
    runs = G.label_words(spark.createDataFrame([(1, text), (2, None)], "doc_id bigint, text string"), model).orderBy("first_word").collect()
    assert sum(r.n_words for r in runs) == 120 and {r.doc_id for r in runs} == {1}
    label = [r.lang for r in runs for _ in range(r.n_words)]
    assert np.mean([a == b for a, b in zip(label, ["en"] * 40 + ["de"] * 40 + ["fr"] * 40)]) > 0.9
    assert model.step.diagonal().min() > model.step[~np.eye(len(model.langs), dtype=bool)].max()  # staying is likelier than switching


def test_kept_rows_and_no_labels(docs, no_docs, model):
    kept = G.keep_identified(docs, model)
    assert kept.columns == docs.columns
    ids = {r.doc_id for r in kept.collect()}
    assert not ids & {310, 311, 312, 313} and set(range(120)) - ids == set()
    nothing = docs.withColumn("lang", F.lit(None).cast("string"))
    assert G.fit_language(nothing) is None and G.fit_language(no_docs) is None
    assert {r.lang_pred for r in G.identify_language(docs, None).collect()} == {"und"}
    assert G.identify_language(no_docs, model).count() == 0


def test_held_out_rows_are_not_learned_from(docs):
    changed = docs.withColumn("text", F.when(G.id_fold(F.col("doc_id"), 4) == 2, F.lit("zzz")).otherwise(F.col("text")))
    a, b = (G.fit_language(G.training_rows(d)) for d in (docs, changed))
    assert a.langs == b.langs and np.array_equal(a.weights, b.weights) and np.array_equal(a.step, b.step)


def test_every_labelled_language_is_learned(spark):
    rng = random.Random(12)
    lexicon = {f"l{k:02}": ["".join(chr(0x4E00 + 40 * k + rng.randrange(40)) for _ in range(3)) for _ in range(12)] for k in range(70)}
    rows = [(100 * int(lang[1:]) + i, " ".join(rng.choice(words) for _ in range(30)), lang) for lang, words in lexicon.items() for i in range(2 if lang > "l64" else 4)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    m = G.fit_language(docs)
    assert m.langs == sorted(lexicon) and len(m.weights) == G.table_size(70) + 1 < G.HASHED
    got = G.predict([r[1] for r in rows], m)[0]
    assert np.mean([a == r[2] for a, r in zip(got, rows) if r[2] > "l64"]) == 1


def test_samples_shrink_with_the_number_of_languages():
    assert all(G.sample_size(n, 400, 6, 24) == (400, 6) for n in range(13)) and G.table_size(64) == G.HASHED
    for n in (20, 64, 100, 235, 1000):
        docs, segments = G.sample_size(n, 400, 6, 24)
        assert docs >= G.LEAST and docs * segments * 24 * n * n <= max(1.5 * G.CELLS, G.LEAST * 24 * n * n)


def test_rows_without_an_id_keep_the_bound_of_the_sample(spark, monkeypatch):
    """Rows without an id, with one id, and repeated rows: of each language at most the documents asked for are collected, by their texts."""
    rows = [(None, f"word{i} other words of text {i}", "aa") for i in range(3000)] + [(7, f"{i} der text von {i}", "bb") for i in range(300)]
    rows += [(None, "the same text", "cc")] * 3000 + [(i, None, "dd") for i in range(5)] + [(9, "...", "aa")]
    taken = []
    monkeypatch.setattr(G, "train", lambda segments: taken.extend(segments) or "model")
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string")
    assert G.fit_language(df.repartition(5), docs_per_lang=20) == "model"
    assert {c: sum(l == c for l, _ in taken) for c in ("aa", "bb", "cc", "dd")} == {"aa": 20, "bb": 20, "cc": 1, "dd": 0}
    first, taken[:] = list(taken), []
    G.fit_language(df.repartition(3), docs_per_lang=20)
    assert taken == first
