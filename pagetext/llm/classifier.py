"""Quality classifier: random-indexing word vectors pooled per document, then a two-layer network with calibrated probabilities.

Every word owns a sparse random index vector; its word vector is the sum of the index vectors of its neighbours in all texts. Words are dealt
into a fixed number of rows by hash, so the table of vectors has one size whatever the corpus holds. A document is the mean and the spread of
its words' vectors.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, DoubleType, IntegerType, StructField, StructType

from pagetext.llm.common import id_fold, id_key

ROWS, DIM = 1 << 15, 32
WINDOW, NONZERO = 2, 4
TOKENS, STRETCH = 250_000, 1 << 15  # words counted, and vectors summed, at a time
SUMS = [f"d{j}" for j in range(DIM)]


def index_vectors(seed: int = 29) -> np.ndarray:
    """Every row's sparse random index vector: ``NONZERO`` signs, the rest zero."""
    rng = np.random.default_rng(seed)
    out = np.zeros((ROWS, DIM), np.int8)
    at = np.argsort(rng.random((ROWS, DIM)), axis=1)[:, :NONZERO]
    np.put_along_axis(out, at, rng.choice(np.array([-1, 1], np.int8), (ROWS, NONZERO)), 1)
    return out


def _codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(row of every word, words of each text). Words are runs of letters, digits and marks, or runs of other signs."""
    spaced = pc.replace_substring_regex(pc.fill_null(texts, ""), r"([^\pL\pN\pM\s]+)", r" \1 ")
    parts = pc.split_pattern_regex(spaced, r"\s+")
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    real = pc.not_equal(flat, "").to_numpy(zero_copy_only=False)
    coded = flat.dictionary_encode()
    row = np.array([zlib.crc32(w.as_buffer()) % ROWS if w.is_valid else 0 for w in coded.dictionary], np.int64).reshape(-1)
    text = np.repeat(np.arange(len(sizes)), sizes)
    return row[coded.indices.to_numpy(zero_copy_only=False)][real], np.bincount(text[real], minlength=len(sizes))


def _pieces(batch: pa.RecordBatch, column: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch of about ``TOKENS`` words, a longer text alone."""
    size = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False) // 5
    part = np.cumsum(size) // TOKENS
    for at in np.unique(part):
        rows = np.flatnonzero(part == at)
        yield batch.slice(rows[0], len(rows))


def count_contexts(codes: np.ndarray, sizes: np.ndarray, index: np.ndarray, sums: np.ndarray, counts: np.ndarray) -> None:
    """Add to ``sums`` the index vectors of each word's neighbours within ``WINDOW`` words of its text, and to ``counts`` the words."""
    if not len(codes):
        return
    text = np.repeat(np.arange(len(sizes)), sizes)
    own = index[codes]
    near = np.zeros_like(own)  # at most 2 * WINDOW a component
    for step in range(1, WINDOW + 1):
        apart = np.flatnonzero(text[:-step] != text[step:])
        for to, other in ((near[:-step], own[step:]), (near[step:], own[:-step])):
            to += other
            to[apart] -= other[apart]
    order = np.argsort(codes.astype(np.uint16), kind="stable")  # ROWS fit 16 bits, which are sorted in linear time
    word = codes[order]
    heads = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
    sums[word[heads]] += np.add.reduceat(near[order], heads, axis=0, dtype=np.int64)
    counts[word[heads]] += np.diff(np.append(heads, len(word)))


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    index = index_vectors()
    sums, counts = np.zeros((ROWS, DIM), np.int64), np.zeros(ROWS, np.int64)
    for b in batches:
        for part in _pieces(b, 0):
            count_contexts(*_codes(part.column(0)), index, sums, counts)
    rows = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(rows.astype(np.int32)), pa.array(counts[rows]), *[pa.array(c) for c in sums[rows].T]], names=["row", "n", *SUMS])


def word_vectors(docs: DataFrame, text: str = "text") -> np.ndarray:
    """Random-indexing vectors of all words of all texts, ``ROWS`` x ``DIM``: centred by the corpus mean and of length one; unseen rows are zero.

    Each task sends one sum per row of the table; sums are whole numbers, so the result does not depend on the order of the tasks.
    """
    schema = "row int, n bigint, " + ", ".join(f"{c} bigint" for c in SUMS)
    sums = docs.select(F.col(text).alias("text")).filter(F.col("text").isNotNull()).mapInArrow(_contexts, schema)
    table = sums.groupBy("row").agg(F.sum("n").alias("n"), *[F.sum(c).alias(c) for c in SUMS]).toArrow()  # ``ROWS`` rows at most
    n, context = np.zeros(ROWS), np.zeros((ROWS, DIM))
    rows = table["row"].to_numpy()
    n[rows] = table["n"].to_numpy()
    context[rows] = np.stack([table[c].to_numpy() for c in SUMS], axis=1).reshape(-1, DIM)
    vector = np.divide(context, n[:, None], out=np.zeros_like(context), where=n[:, None] > 0)
    mean = n @ vector / max(n.sum(), 1)
    vector = np.where(n[:, None] > 0, vector - mean, 0)
    length = np.linalg.norm(vector, axis=1, keepdims=True)
    return np.divide(vector, length, out=np.zeros_like(vector), where=length > 0).astype(np.float32)


def with_squares(vectors: np.ndarray) -> np.ndarray:
    """The table ``pool`` sums over: vectors beside their squares, as doubles."""
    return np.concatenate([vectors, vectors.astype(np.float64) ** 2], axis=1)


def pool(codes: np.ndarray, sizes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Mean and spread of the word vectors of each text, and how many words it has; a text without words is all zero."""
    out, one = np.zeros((len(sizes), 2 * DIM + 1)), np.ones(STRETCH)
    at = 0
    for k in np.flatnonzero(sizes):
        n, total = int(sizes[k]), np.zeros(2 * DIM)
        for i in range(0, n, STRETCH):
            part = codes[at + i:at + min(i + STRETCH, n)]
            total += one[:len(part)] @ table[part]
        at += n
        mean, square = total[:DIM] / n, total[DIM:] / n
        out[k] = np.concatenate([mean, np.sqrt(np.maximum(square - mean * mean, 0)), [np.log1p(n) / 10]])
    return out


@dataclass
class Network:
    """Two layers over pooled vectors; ``temperature`` divides the log odds."""

    vectors: np.ndarray
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Row by row: a matrix product may round a row differently by its place in the batch, and equal texts are to score alike."""
        inner = np.tanh(np.einsum("ij,jk->ik", (x - self.centre) / self.scale, self.w1) + self.b1)
        return (inner * self.w2).sum(axis=1) + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x) / self.temperature, -700, 700)))


def train(x: np.ndarray, y: np.ndarray, vectors: np.ndarray, hidden: int = 32, steps: int = 400, rate: float = 0.02, decay: float = 1e-3, seed: int = 7) -> Network:
    """Fit the network by full-batch gradient steps with momentum and scale, then its temperature on every fifth row, which the network never saw."""
    held = np.arange(len(x)) % 5 == 4
    held &= len(x) >= 50
    rng = np.random.default_rng(seed)
    net = Network(vectors, x[~held].mean(axis=0), np.maximum(x[~held].std(axis=0), 1e-3), rng.standard_normal((x.shape[1], hidden)) / np.sqrt(x.shape[1]), np.zeros(hidden),
                  rng.standard_normal(hidden) / np.sqrt(hidden), 0.0)
    z, t = (x[~held] - net.centre) / net.scale, y[~held]
    parts = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second = [np.zeros_like(p) for p in parts], [np.zeros_like(p) for p in parts]
    for step in range(1, steps + 1):
        h = np.tanh(z @ parts[0] + parts[1])
        g = (1 / (1 + np.exp(-np.clip(h @ parts[2] + parts[3][0], -700, 700))) - t) / len(t)
        back = np.outer(g, parts[2]) * (1 - h * h)
        slopes = [z.T @ back + decay * parts[0], back.sum(axis=0), h.T @ g + decay * parts[2], np.array([g.sum()])]
        for i, s in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * s
            second[i] = 0.999 * second[i] + 0.001 * s * s
            parts[i] = parts[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = parts[0], parts[1], parts[2], float(parts[3][0])
    if held.any():
        margin, t = net.margin(x[held]), y[held]
        tried = np.exp(np.linspace(np.log(0.2), np.log(20), 200))
        loss = [np.logaddexp(0, np.where(t > 0, -1, 1) * margin / k).mean() for k in tried]
        net.temperature = float(tried[int(np.argmin(loss))])
    return net


def _worker(vectors, model, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = with_squares(vectors.value if model is None else model.value.vectors)
        for b in batches:
            for part in _pieces(b, 1):
                x = pool(*_codes(part.column(1)), table)
                if model is None:
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(x), pa.list_(pa.float64()))], names=["doc_id", "pooled"])
                else:
                    score = model.value.score(x)
                    yield pa.RecordBatch.from_arrays([part.column(0), pa.array(score), pa.array((score >= least).astype(np.int32))], names=["doc_id", "score", "predicted"])
    return run


def fit_classifier(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000, held_out: int = 2, folds: int = 4, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Network | None:
    """Word vectors from all texts, and a network from the labels of all folds but ``held_out``; None unless both classes occur.

    The network learns from the ``sample_rows`` labelled documents with the smallest hash-random keys (a documented bound). Contradicting labels of a
    document count as bad, labels that are null or without an id are left out; of several texts with a labelled id the one with the smallest hash is taken.
    """
    spark = docs.sparkSession
    vectors = word_vectors(docs, text)
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & (id_fold(F.col(doc_id), folds) != held_out))
    known = known.groupBy(F.col(doc_id).alias("doc_id")).agg((F.min(label) > 0).cast("int").alias("y"))
    sample = known.orderBy(id_key(F.col("doc_id"), "classifier"), "doc_id").limit(sample_rows)
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).join(F.broadcast(sample), "doc_id")
    one = texts.groupBy("doc_id").agg(F.first("y").alias("y"), F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    shared = spark.sparkContext.broadcast(vectors)
    schema = StructType([StructField("doc_id", BinaryType()), StructField("pooled", ArrayType(DoubleType()))])
    tagged = one.select(F.concat_ws(":", "y", id_key(F.col("doc_id"), "classifier")).cast("binary").alias("doc_id"), "text")
    rows = tagged.mapInArrow(_worker(shared, None, 0.0), schema).toArrow()
    keys = [(k[2:], k[:1]) for k in rows["doc_id"].to_pylist()]
    order = sorted(range(len(keys)), key=keys.__getitem__)  # the result must not depend on the order in which rows arrive
    y = np.array([keys[i][1] == b"1" for i in order], float)
    if not len(y) or y.min() == y.max():
        return None
    x = rows["pooled"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    return train(x[order], y, vectors)


def classify_quality(docs: DataFrame, model: Network | None, least: float = 0.7, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, score (probability of good quality, 0 to 1) and predicted (1 if score >= ``least``, else 0) for every whole text.

    Null and empty texts are scored as texts without words. Without a model (no labels of both kinds) every score is 1. Repeated rows are
    scored each, ids may be null, further columns are ignored.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([d.schema["doc_id"], StructField("score", DoubleType()), StructField("predicted", IntegerType())])
    if model is None:
        return d.select("doc_id", F.lit(1.0).alias("score"), F.lit(1).alias("predicted"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # ``ROWS`` x ``DIM`` floats
    return d.mapInArrow(_worker(None, shared, least), schema)
