import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import functions as F

from pagetext.llm import classifier as C
from pagetext.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"


def words(text):
    return regex.findall(r"[\p{L}\p{N}\p{M}]+|[^\p{L}\p{N}\p{M}\s]+", text or "")


def test_contexts_and_pool_against_plain_python():
    texts = ["a b, c!! a", None, "", " \n ", "été été ### x_1 b", "b"]
    codes, sizes = C._codes(pa.array(texts))
    plain = [[zlib.crc32(w.encode()) % C.ROWS for w in words(t)] for t in texts]
    assert codes.tolist() == sum(plain, []) and sizes.tolist() == [len(p) for p in plain]
    index = C.index_vectors()
    assert (np.abs(index).sum(axis=1) == C.NONZERO).all()
    want = np.zeros((C.ROWS, C.DIM), np.int64)
    for p in plain:
        for i, w in enumerate(p):
            for j in range(max(0, i - C.WINDOW), min(len(p), i + C.WINDOW + 1)):
                want[w] += index[p[j]] if j != i else 0
    sums, counts = np.zeros_like(want), np.zeros(C.ROWS, np.int64)
    C.count_contexts(codes, sizes, index, sums, counts)
    assert (sums == want).all() and counts.sum() == len(codes)
    vectors = np.random.default_rng(0).standard_normal((C.ROWS, C.DIM)).astype(np.float32)
    pooled = C.pool(codes, sizes, C.with_squares(vectors))
    for p, x in zip(plain, pooled):
        v = vectors[p].astype(float)
        assert np.allclose(x, np.concatenate([v.mean(axis=0), v.std(axis=0), [np.log1p(len(p)) / 10]]) if p else 0, atol=1e-5)


def test_network_learns_and_is_calibrated():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((1500, 6))
    p = 1 / (1 + np.exp(-3 * (1 - x[:, 0] ** 2 + x[:, 1])))  # not linear
    y = (rng.random(1500) < p).astype(float)
    net = C.train(x, y, None)
    score = net.score(x)
    assert ((score > 0.5) == (p > 0.5)).mean() > 0.9
    for low in (0.0, 0.3, 0.6):
        some = (score >= low) & (score < low + 0.4)
        assert abs(score[some].mean() - y[some].mean()) < 0.1
    assert C.train(x[:10], np.arange(10) % 2.0, None).temperature == 1.0  # too few rows to set any aside


def test_held_out_accuracy(spark):
    found = QUERIES["op13_quality_classifier"](spark, SF).cache()
    assert found.columns == ["doc_id", "held_out", "score", "predicted"]
    labels = spark.read.parquet(f"{SF}/labels.parquet").select("doc_id", "quality")
    rows = found.join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) / len(rows) >= 0.95
    assert found.filter("not score between 0 and 1 or predicted <> int(score >= 0.7)").count() == 0
    assert found.count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_awkward_rows(spark, docs, doc_rows, no_docs):
    d = docs.withColumn("score", F.lit("x")).withColumn("predicted", F.lit("y"))
    labels = spark.createDataFrame([(i, i % 2, "x") for i in range(120)] + [(3, 0, "x"), (None, 1, "x"), (5, None, "x"), (9999, 1, "x")], "doc_id bigint, quality int, score string")
    one, two = (C.fit_classifier(d.repartition(n), labels) for n in (2, 7))
    assert (one.vectors == two.vectors).all() and np.allclose(one.w1, two.w1)  # neither the order nor the cut of the rows matters
    rows = C.classify_quality(d, one).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(r[0]) for r in doc_rows) and all(0 <= r.score <= 1 for r in rows)
    empty = {r.score for r in rows if r.doc_id in (310, 311, 312)}
    assert len(empty) == 1  # null, empty and blank texts are scored alike
    assert C.fit_classifier(no_docs, labels) is None and C.fit_classifier(docs, labels.limit(0)) is None
    assert C.fit_classifier(docs, labels.withColumn("quality", F.lit(1))) is None
    assert {(r.score, r.predicted) for r in C.classify_quality(docs, None).collect()} == {(1.0, 1)}
    assert C.classify_quality(no_docs, one).count() == 0


def test_labels_of_the_held_out_fold_are_never_read(spark, docs):
    labels = spark.createDataFrame([(i, i % 2) for i in range(120)], "doc_id bigint, quality int")
    held = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    turned = labels.withColumn("quality", F.when(held, 1 - F.col("quality")).otherwise(F.col("quality")))
    assert (C.fit_classifier(docs, labels).w1 == C.fit_classifier(docs, turned).w1).all()


def test_score_of_a_text_does_not_depend_on_its_batch():
    rng = np.random.default_rng(5)
    net = C.train(rng.standard_normal((200, 64)), np.arange(200) % 2.0, None)
    x = rng.standard_normal(64)
    for n in range(1, 40):
        assert len(set(net.score(np.tile(x, (n, 1))))) == 1 and net.score(np.tile(x, (n, 1)))[0] == net.score(x[None])[0]
