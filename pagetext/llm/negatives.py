"""Hard-negative mining: anchor-candidate tiles of integer inner products by Strassen's recursion, and mergeable heaps over the tiles.

Rows are dealt by label into blocks of bounded size, anchors into chunks likewise. A chunk meets the blocks that hold its labels to find
positives, then the blocks that hold other labels to find negatives, so each product is needed once.
Every tile keeps only a short heap per anchor (or anchor and positive); heaps of different tiles merge to the heap of all.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.llm.common import id_key, running_totals, stored

LEAF = 32  # a side from which on a tile is multiplied directly
ANCHORS, ROWS = 256, 1024  # one tile of scores
NONE = np.iinfo(np.int64).min


def strassen(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product of int64 matrices by Strassen's seven half-size products; odd sides are padded with zeros.

    Only integer additions and products, so the result is exact (as any int64 product, modulo 2**64).
    """
    (m, k), n = a.shape, b.shape[1]
    if min(m, k, n) <= LEAF:
        return _direct(a, b)
    a, b = (np.pad(x, [(0, s % 2) for s in x.shape]) if x.shape[0] % 2 or x.shape[1] % 2 else x for x in (a, b))
    i, j, c = a.shape[0] // 2, a.shape[1] // 2, b.shape[1] // 2
    a11, a12, a21, a22 = a[:i, :j], a[:i, j:], a[i:, :j], a[i:, j:]
    b11, b12, b21, b22 = b[:j, :c], b[:j, c:], b[j:, :c], b[j:, c:]
    p1 = strassen(a11 + a22, b11 + b22)
    p2 = strassen(a21 + a22, b11)
    p3 = strassen(a11, b12 - b22)
    p4 = strassen(a22, b21 - b11)
    p5 = strassen(a11 + a12, b22)
    p6 = strassen(a21 - a11, b11 + b12)
    p7 = strassen(a12 - a22, b21 + b22)
    out = np.empty((2 * i, 2 * c), np.int64)
    out[:i, :c], out[:i, c:] = p1 + p4 - p5 + p7, p3 + p5
    out[i:, :c], out[i:, c:] = p2 + p4, p1 - p2 + p3 + p6
    return out[:m, :n]


def _direct(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A leaf: in doubles where every partial sum is a whole number below 2**53 and thus exact, else in int64."""
    if not a.size or not b.size:
        return np.zeros((a.shape[0], b.shape[1]), np.int64)
    high = max(abs(int(a.min())), int(a.max())) * max(abs(int(b.min())), int(b.max())) * a.shape[1]
    if high < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64)).astype(np.int64)
    return a @ b


def whole_vector(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of every component as a long."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(scale)).cast("long"))


def usable(vector: Column) -> Column:
    """Not null, and without a null or non-finite component; zero and empty vectors are usable."""
    return F.coalesce(F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))), F.lit(False))


def _matrix(col: pa.ChunkedArray, width: int) -> np.ndarray:
    """Rows of a list column cut or padded with zeros to ``width``."""
    whole = col.combine_chunks()
    sizes = pa.compute.list_value_length(whole).to_numpy(zero_copy_only=False).astype(np.int64)
    values = whole.flatten().to_numpy(zero_copy_only=False)
    if len(sizes) and (sizes == width).all():
        return values.reshape(-1, width)
    out = np.zeros((len(sizes), width), np.int64)
    row = np.repeat(np.arange(len(sizes)), sizes)
    at = np.arange(len(values)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    keep = at < width
    out[row[keep], at[keep]] = values[keep]
    return out


def _longest(*cols: pa.ChunkedArray) -> int:
    """Components beyond the shorter side's longest vector meet only zeros, so they are not needed."""
    return min(int(pa.compute.max(pa.compute.list_value_length(c)).as_py() or 0) for c in cols)


def merge_heaps(score: np.ndarray, ids: np.ndarray, new: np.ndarray, new_ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The best of two heaps row by row: higher score first, then smaller id; ``NONE`` fills empty places."""
    k = score.shape[1]
    s, i = np.concatenate([score, new], axis=1), np.concatenate([ids, new_ids], axis=1)
    first = np.argsort(i, axis=1, kind="stable")
    s, i = np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)
    # negated scores would overflow at the smallest long only, which is the mark of an empty place
    first = np.argsort(np.where(s == NONE, np.iinfo(np.int64).max, -np.maximum(s, NONE + 1)), axis=1, kind="stable")[:, :k]
    return np.take_along_axis(s, first, 1), np.take_along_axis(i, first, 1)


def _best_of(scores: np.ndarray, fits: np.ndarray, ids: np.ndarray, k: int, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Heap of the ``k`` best fitting columns of each row; a column below the row's ``least`` can no longer enter."""
    rows = len(scores)
    s, i = np.full((rows, k), NONE), np.full((rows, k), np.iinfo(np.int64).max)
    hit = fits & (scores >= least[:, None])
    if hit.sum() > 4 * k * rows:
        cut = np.partition(np.where(hit, scores, NONE), scores.shape[1] - min(k, scores.shape[1]), axis=1)[:, -min(k, scores.shape[1])]
        hit &= scores >= cut[:, None]
    r, c = np.nonzero(hit)
    if not len(r):
        return s, i
    v = scores[r, c]
    order = np.lexsort((ids[c], -v, r))
    r, c, v = r[order], c[order], v[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < k
    s[r[keep], place[keep]], i[r[keep], place[keep]] = v[keep], ids[c[keep]]
    return s, i


def _tiles(left: pa.Table, right: pa.Table):
    """Tiles of scores of one chunk (left) and one block (right): slices of both and their product."""
    width = _longest(left["av"], right["v"])
    a, b = _matrix(left["av"], width), _matrix(right["v"], width)
    for i in range(0, len(a), ANCHORS):
        for j in range(0, len(b), ROWS):
            yield slice(i, i + ANCHORS), slice(j, j + ROWS), strassen(a[i:i + ANCHORS], b[j:j + ROWS].T)


def _positives(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, label, anchor = (left[c].to_numpy() for c in ("key", "alabel", "anchor"))
        ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
        score, found = np.full((len(key), k), NONE), np.full((len(key), k), np.iinfo(np.int64).max)
        if len(key) and len(ids):
            for i, j, s in _tiles(left, right):
                fits = (labels[j] == label[i, None]) & (ids[j] != anchor[i, None])
                score[i], found[i] = merge_heaps(score[i], found[i], *_best_of(s, fits, ids[j], k, score[i, -1]))
        r, c = np.nonzero(score != NONE)
        return pa.table([pa.array(key[r]), pa.array(found[r, c]), pa.array(score[r, c])], names=["key", "positive_id", "positive_score"])
    return run


def _negatives(k: int, low: int, high: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        key, label = left["key"].to_numpy(), left["alabel"].to_numpy()
        ids, labels = right["id"].to_numpy(), right["label"].to_numpy()
        which = pa.compute.list_value_length(left["positives"].combine_chunks()).to_numpy(zero_copy_only=False).astype(np.int64) if len(key) else np.zeros(0, np.int64)
        most = int(which.max()) if len(which) else 0
        values = left["positives"].combine_chunks().flatten().to_numpy(zero_copy_only=False) if most else np.zeros(0, np.int64)
        start = np.cumsum(which) - which
        out = []
        if most and len(ids):
            score, found = np.full((most, len(key), k), NONE), np.full((most, len(key), k), np.iinfo(np.int64).max)
            for i, j, s in _tiles(left, right):
                differ = labels[j] != label[i, None]
                for p in range(most):
                    there = which[i] > p
                    pos = np.where(there, values[np.minimum(start[i] + p, len(values) - 1)], 0)
                    # 100 * s >= low * pos and 100 * s <= high * pos, as whole numbers
                    fits = differ & there[:, None] & (s >= -((-low * pos) // 100)[:, None]) & (s <= ((high * pos) // 100)[:, None])
                    score[p, i], found[p, i] = merge_heaps(score[p, i], found[p, i], *_best_of(s, fits, ids[j], k, score[p, i, -1]))
            out = np.nonzero(score != NONE)
        p, r, c = out if most and len(ids) else (np.zeros(0, np.int64),) * 3
        cols = [key[r], p + 1, found[p, r, c], score[p, r, c]] if len(p) else [np.zeros(0, np.int64)] * 4
        return pa.table([pa.array(np.asarray(x, np.int64)) for x in cols], names=["key", "place", "negative_id", "negative_score"])
    return run


def mine_negatives(vectors: DataFrame, is_anchor: Column, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95, block_cells: int = 1 << 19,
                   vec_id: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    ``is_anchor`` is a condition on the columns of ``vectors``; ``vector`` holds whole numbers (see ``whole_vector``). Scores are integer
    inner products; higher come first, ties by smaller id. An anchor's positives are its first ``positives`` other rows of the same
    label; for each, the first ``negatives`` rows of other labels with low% <= negative score / positive score <= high% are returned (so none for a
    negative positive score). A vector shorter than its partner counts as padded with zeros. Scores must stay below 2**56.

    Rows whose id, label or vector is null, or whose vector holds a null, take no part. Rows with the anchor's own id are not its positives;
    other repeated rows count each, and every anchor row answers on its own. Blocks hold about ``block_cells`` components, whatever the labels' sizes.
    An empty table, or one without anchors, gives no rows; further columns are ignored.
    """
    spark = vectors.sparkSession
    d = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(label).cast("long").alias("label"), F.col(vector).cast("array<bigint>").alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks"))
    d = d.filter(F.col("id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: x.isNotNull()))
    placed = running_totals(d.withColumn("mix", id_key(F.col("id"), "tiles")), [], ["label", "mix", "id"],
                            {"__row": F.lit(1).cast("long"), "__ask": F.col("asks").cast("long"), "__cells": F.greatest(F.size("v"), F.lit(1)).cast("long")})
    # a block or chunk ends after a number of components, so long vectors make smaller blocks
    rows = stored(placed.withColumn("block", F.floor(F.col("__cells") / block_cells)).drop("__cells", "mix"), "rows")
    widest = F.max(F.size("v")).alias("w")
    size = rows.agg(F.max("block").alias("b"), widest, F.max("__ask").alias("n")).collect()[0]
    out = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    if not size["n"]:
        return spark.createDataFrame([], out)
    per_chunk = max(ANCHORS, block_cells // max(size["w"], 1))
    anchors = rows.filter("asks").select(F.col("__row").alias("key"), F.col("id").alias("anchor"), F.col("label").alias("alabel"), F.col("v").alias("av"), F.floor((F.col("__ask") - 1) / per_chunk).alias("chunk"))
    rows = rows.select("id", "label", "v", "block")
    chunks, blocks = (size["n"] - 1) // per_chunk + 1, size["b"] + 1
    span = lambda d, of, label: d.groupBy(F.col(label).alias("of")).agg(F.min(of).alias("a"), F.max(of).alias("b"))
    on = ("chunk", "block")

    def tiles(left: DataFrame, right: DataFrame, worker, schema: str) -> DataFrame:
        left = left.select("key", "alabel", "anchor", "av", *on, *[c for c in left.columns if c == "positives"])
        return left.groupBy(*on).cogroup(right.select("id", "label", "v", *on).groupBy(*on)).applyInArrow(worker, schema)

    # Positives: chunks and blocks that share a label. Negatives: a chunk and a block of one and the same single label are left out.
    left = anchors.join(span(rows, "block", "label"), F.col("alabel") == F.col("of")).withColumn("block", F.explode(F.sequence("a", "b")))
    right = rows.join(span(anchors, "chunk", "alabel"), F.col("label") == F.col("of")).withColumn("chunk", F.explode(F.sequence("a", "b")))
    near = tiles(left, right.drop("a", "b", "of"), _positives(positives), "key bigint, positive_id bigint, positive_score bigint")
    order = Window.partitionBy("key").orderBy(F.desc("positive_score"), "positive_id")
    near = stored(near.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= positives), "positives")

    lists = near.groupBy("key").agg(F.sort_array(F.collect_list(F.struct("place", "positive_score"))).alias("p"))  # ``positives`` a key at most
    asking = anchors.join(lists.select("key", F.col("p.positive_score").alias("positives")), "key")
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    only = lambda d, of, label: d.groupBy(of).agg(F.when(F.min(label) == F.max(label), F.min(label)).alias(f"{of}_only"))
    chunk_only, block_only = only(anchors, "chunk", "alabel"), only(rows, "block", "label")
    other = ~F.coalesce(F.col("chunk_only") == F.col("block_only"), F.lit(False))
    left = asking.withColumn("block", every(blocks)).join(chunk_only, "chunk").join(block_only, "block").filter(other)
    right = rows.withColumn("chunk", every(chunks)).join(chunk_only, "chunk").join(block_only, "block").filter(other)
    far = tiles(left, right, _negatives(negatives, low, high), "key bigint, place bigint, negative_id bigint, negative_score bigint")
    order = Window.partitionBy("key", "place").orderBy(F.desc("negative_score"), "negative_id")
    far = far.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= negatives)
    found = far.join(near, ["key", "place"]).join(anchors.select("key", "anchor"), "key")
    return found.select(F.col("anchor").alias("anchor_id"), "positive_id", "rank", "negative_id", "positive_score", "negative_score")
