"""Approximate nearest neighbours by low-dimensional stable projections, kd-trees and a chi-square stopping test.

Largest inner product is turned into smallest distance by one more coordinate: with the largest norm M, a candidate x becomes
(x, sqrt(M² - |x|²)) and a query (q, 0). A Gaussian projection to m dimensions keeps squared distances up to a chi-square
factor with m degrees of freedom, so a candidate as near as the k-th neighbour found so far lies beyond a projected
distance r with probability 1 - chi2(r² / d_k²). Candidates are visited by growing projected distance until
that chance is small enough.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from pagetext.llm.common import id_key, stored

LEAF = 64
PAIRS = 1 << 21  # distances of rows from cells or boxes computed at a time


def chi2_cdf(x: np.ndarray, m: int) -> np.ndarray:
    """Chi-square distribution function for an even number of degrees of freedom."""
    half = np.minimum(np.asarray(x, float) / 2, 700.0)
    term, total = np.ones_like(half), np.ones_like(half)
    for i in range(1, m // 2):
        term = term * half / i
        total = total + term
    return 1 - np.exp(-half) * total


def projection(dim: int, m: int, seed: int = 11) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim + 1, m))


def usable(vector: Column) -> Column:
    """Not null, not empty, no null or non-finite component, not zero."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(ok, F.lit(False)) & F.exists(vector, lambda x: x != 0)


def _split(points: np.ndarray, rows: np.ndarray, size: int) -> list[np.ndarray]:
    """Rows of the leaves of a kd-tree: the widest dimension is halved until a leaf has ``size`` rows or all are equal."""
    if len(rows) <= size:
        return [rows]
    p = points[rows]
    wide = int(np.argmax(p.max(axis=0) - p.min(axis=0)))
    half = len(rows) // 2
    order = np.argpartition(p[:, wide], half)
    return _split(points, rows[order[:half]], size) + _split(points, rows[order[half:]], size)


def _box_distance(q: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Squared projected distance of every query from every box."""
    out = np.zeros((len(q), len(low)))
    for j in range(q.shape[1]):
        gap = np.maximum(np.maximum(low[:, j] - q[:, j, None], q[:, j, None] - high[:, j]), 0)
        out += gap * gap
    return out


def exact_scores(x: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Inner products of paired rows, summed in component order, so that equal vectors tie exactly."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * q[:, j]
    return out


def search_block(ids: np.ndarray, x: np.ndarray, px: np.ndarray, qids: np.ndarray, q: np.ndarray, pq: np.ndarray, bound: np.ndarray, top: float, k: int, sure: float):
    """Best ``k`` (score, id) of one block for each query. ``bound``: squared distance of the k-th neighbour known already."""
    m = px.shape[1]
    leaves = _split(px, np.arange(len(x)), LEAF)
    low = np.stack([px[r].min(axis=0) for r in leaves])
    high = np.stack([px[r].max(axis=0) for r in leaves])
    near = _box_distance(pq, low, high)
    order = np.argsort(near, axis=1, kind="stable")
    best = np.full((len(q), k), -np.inf)
    best_id = np.full((len(q), k), np.iinfo(np.int64).max)
    q2 = (q * q).sum(axis=1)
    slack = 1e-9 * (np.sqrt(top * q2) + 1e-300)
    live = np.arange(len(q))
    for t in range(len(leaves)):
        d_k = np.minimum(bound[live], top + q2[live] - 2 * best[live, -1])
        r = near[live, order[live, t]]
        with np.errstate(divide="ignore", invalid="ignore"):
            ratio = np.where(d_k > 0, r / d_k, np.where(r > 0, np.inf, 0.0))
        live = live[~(chi2_cdf(ratio, m) >= sure)]
        if not len(live):
            break
        at = order[live, t]
        by = np.argsort(at, kind="stable")
        cuts = np.flatnonzero(np.diff(at[by], prepend=-1))
        who, what = [], []
        for a, b in zip(cuts, np.append(cuts[1:], len(by))):
            qs, cs = live[by[a:b]], leaves[at[by[a]]]
            hit = q[qs] @ x[cs].T >= (best[qs, -1] - slack[qs])[:, None]
            hit &= ids[cs][None, :] != qids[qs][:, None]
            i, j = np.nonzero(hit)
            who.append(qs[i])
            what.append(cs[j])
        who, what = np.concatenate(who), np.concatenate(what)
        score = exact_scores(x[what], q[who])
        sort = np.lexsort((ids[what], -score, who))
        who, score, found = who[sort], score[sort], ids[what][sort]
        place = np.arange(len(who)) - np.searchsorted(who, who)
        keep = place < k
        who, score, found, place = who[keep], score[keep], found[keep], place[keep]
        rows = np.unique(who)
        new, new_id = np.full((len(rows), 2 * k), -np.inf), np.full((len(rows), 2 * k), np.iinfo(np.int64).max)
        new[:, :k], new_id[:, :k] = best[rows], best_id[rows]
        at_row = np.searchsorted(rows, who)
        new[at_row, k + place], new_id[at_row, k + place] = score, found
        first = np.lexsort((new_id, -new), axis=1)[:, :k]
        best[rows], best_id[rows] = np.take_along_axis(new, first, 1), np.take_along_axis(new_id, first, 1)
    return best, best_id


def nearest_neighbours(vectors: DataFrame, is_query: Column, k: int = 20, m: int = 8, sure: float = 0.95, block_rows: int = 8192, sample_rows: int = 20000, max_blocks: int = 1 << 16,
                       vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """The ``k`` rows of largest inner product found for each query row: query_id, rank, vec_id, score.

    ``is_query`` is a condition on the columns of ``vectors``. All usable rows are indexed; a kd-tree fitted on a bounded sample of projected rows
    deals them into cells, and a cell above ``block_rows`` rows (many copies of a vector, say) is dealt on by id. From ``max_blocks`` blocks
    on the blocks grow instead, since the driver holds a box of each. Queries first search the
    block nearest in the projection; with the k-th distance found there the stopping test (probability ``sure``) rules out most other blocks, the rest are
    searched too. Scores are exact inner products of the given components as doubles; ties go to the smaller id.

    Vectors that are null, zero, or hold a null or non-finite component take no part, nor do rows without id or of another length than most.
    Rows with the query's own id are not its candidates; repeated rows count each. Fewer than ``k`` candidates: all of them.
    """
    spark = vectors.sparkSession
    d = vectors.select(F.col(vec_id).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks"))
    d = d.filter(F.col("id").isNotNull() & usable(F.col("v"))).withColumn("dim", F.size("v"))
    dims = d.groupBy("dim").agg(F.count(F.lit(1)).alias("n"), F.max(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x)).alias("top")).orderBy(F.desc("n"), "dim").limit(1).collect()
    schema = "query_id bigint, rank int, vec_id bigint, score double"
    if not dims:
        return spark.createDataFrame([], schema)
    dim, rows, top = dims[0]
    block_rows = max(block_rows, -(-rows // max_blocks))
    g = projection(dim, m)

    def project(v: np.ndarray, query: bool) -> np.ndarray:
        more = np.zeros(len(v)) if query else np.sqrt(np.maximum(top - (v * v).sum(axis=1), 0))
        return v @ g[:-1] + more[:, None] * g[-1]

    mat = lambda col: col.combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim) if isinstance(col, pa.ChunkedArray) else col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
    d = d.filter(F.col("dim") == dim).drop("dim")
    sample = mat(d.select("v", id_key(F.col("id"), "cells").alias("key")).orderBy("key").limit(sample_rows).select("v").toArrow()["v"])
    cells, points = [], project(sample, False)
    for leaf in _split(points, np.arange(len(points)), max(1, int(len(points) * block_rows / max(rows, 1)))):
        cells.append(points[leaf].mean(axis=0))
    centre = np.stack(cells)

    def deal(batches):
        for b in batches:
            v = mat(b.column(1))
            p = project(v, False)
            step = max(1, PAIRS // centre.size)
            cell = np.concatenate([((p[i:i + step, None, :] - centre) ** 2).sum(axis=2).argmin(axis=1) for i in range(0, len(p), step)]) if len(p) else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(cell.astype(np.int64)), pa.array(list(p), pa.list_(pa.float64()))], names=["id", "v", "asks", "cell", "p"])

    dealt = stored(d.mapInArrow(deal, "id bigint, v array<double>, asks boolean, cell bigint, p array<double>"), "vectors")
    parts = dealt.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("long").alias("parts"))  # one row a cell
    dealt = dealt.join(parts, "cell").withColumn("block", F.struct("cell", F.pmod(F.xxhash64("id"), "parts").alias("part"))).drop("cell", "parts")
    box = dealt.groupBy("block").agg(*[f(F.col("p")[j]).alias(f"{n}{j}") for j in range(m) for n, f in (("a", F.min), ("b", F.max))]).orderBy("block").collect()
    keys = [(r["block"]["cell"], r["block"]["part"]) for r in box]  # rows / block_rows of them
    low, high = (np.array([[r[f"{n}{j}"] for j in range(m)] for r in box]) for n in "ab")
    asking = dealt.filter("asks").select(F.col("id").alias("qid"), F.col("v").alias("qv"))
    chunks = max(1, -(-asking.count() // 4096))

    def visits(first: bool):
        def run(batches):
            step = max(1, PAIRS // max(len(low), 1))
            for b in (whole.slice(i, step) for whole in batches for i in range(0, whole.num_rows, step)):
                q = mat(b.column(1))
                near = _box_distance(project(q, True), low, high)
                order = np.zeros(near.shape, bool)
                order[np.arange(len(q)), near.argmin(axis=1)] = True
                if not first:
                    d_k = b.column(2).to_numpy(zero_copy_only=False)
                    with np.errstate(divide="ignore", invalid="ignore"):
                        ratio = np.where(d_k[:, None] > 0, near / d_k[:, None], np.where(near > 0, np.inf, 0.0))
                    order = ~order & ~(chi2_cdf(ratio, m) >= sure)
                i, j = np.nonzero(order)
                for at in range(0, len(i), 8192):
                    s, e = i[at:at + 8192], j[at:at + 8192]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(s)), b.column(1).take(pa.array(s)), b.column(2).take(pa.array(s)),
                                                      pa.array([keys[x][0] for x in e], pa.int64()), pa.array([keys[x][1] for x in e], pa.int64())], names=["qid", "qv", "bound", "cell", "part"])
        return run

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.float64())], names=names)
        x, q = mat(left["v"]), mat(right["qv"])
        qids = right["qid"].to_numpy()
        best, ids = search_block(left["id"].to_numpy(), x, project(x, False), qids, q, project(q, True), right["bound"].to_numpy(), top, k, sure)
        i, j = np.nonzero(best > -np.inf)
        return pa.table([pa.array(qids[i]), pa.array(ids[i, j]), pa.array(best[i, j])], names=names)

    def pass_over(queries: DataFrame, first: bool) -> DataFrame:
        routed = queries.mapInArrow(visits(first), "qid bigint, qv array<double>, bound double, cell bigint, part bigint").withColumn("chunk", F.pmod(F.xxhash64("qid", F.lit(1)), F.lit(chunks)))
        copies = dealt.select("id", "v", F.col("block.cell").alias("cell"), F.col("block.part").alias("part"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))).alias("chunk"))
        on = ("cell", "part", "chunk")
        return copies.groupBy(*on).cogroup(routed.groupBy(*on)).applyInArrow(search, "query_id bigint, vec_id bigint, score double")

    asked = asking.dropDuplicates(["qid", "qv"])
    one = stored(pass_over(asked.withColumn("bound", F.lit(float("inf"))), True), "nearest")
    norms = F.aggregate("qv", F.lit(0.0), lambda s, x: s + x * x)
    kth = one.groupBy("query_id").agg(F.count(F.lit(1)).alias("n"), F.min("score").alias("worst"))
    bound = F.when(F.col("n") >= k, F.greatest(F.lit(top) + norms - 2 * F.col("worst"), F.lit(0.0))).otherwise(float("inf"))
    two = pass_over(asked.join(kth, F.col("qid") == F.col("query_id"), "left").select("qid", "qv", F.coalesce(bound, F.lit(float("inf"))).alias("bound")), False)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return one.unionByName(two).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
