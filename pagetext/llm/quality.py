"""Quality rules: document statistics, and gradient-boosted trees over them with monotonic constraints.

Trees are grown on binned statistics and flattened into node arrays, which score a whole batch at a time.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, LongType, StructField, StructType

from pagetext.llm.common import id_key

BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
#: What the trees see: a name and the direction in which quality may move with it (1 up, -1 down, 0 free).
FEATURES = (("log_words", 0), ("mean_word", 0), ("symbol_share", -1), ("dup_line_share", -1), ("repeat_share", -1), ("distinct_share", 0),
            ("upper_share", 0), ("letter_share", 0), ("digit_share", 0), ("stop_share", 0), ("line_words", 0), ("top_word_share", 0), ("symbol_words", -1), ("bang_share", 0))
_SYMBOLS = re.compile(r"[#*$%&|<>]")
_DROP = {c: None for c in b"\t\n\x0b\x0c\r "}


def statistics(text: str | None) -> tuple[list[int], list[float]]:
    """(base counts, features) of one whole text; words are runs without ASCII white space.

    ``n_repeat_words`` counts the words that lie in a window of three words found twice or more in the text.
    """
    t = text or ""
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]
    n = len(words)
    if not n:
        return [0] * 5, [0.0] * len(FEATURES)
    chars = sum(map(len, words))
    symbols = len(_SYMBOLS.findall(t))
    lines = [x for x in t.split("\n") if not x.translate(_DROP) == ""]
    dup = len(lines) - len(set(lines))
    ids: dict[str, int] = {}
    code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    repeat = 0
    if n >= 4:
        # Pairs are numbered first, so that a window's number stays below the square of the words of any text.
        pair = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
        _, window, times = np.unique(pair[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
        twice = times[window] > 1
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k:n - 2 + k] |= twice
        repeat = int(hit.sum())
    counts = np.bincount(code)
    distinct = list(ids)
    cap = np.fromiter((w.isupper() for w in distinct), bool, len(distinct))
    small = np.fromiter((len(w) <= 3 for w in distinct), bool, len(distinct))
    marked = np.fromiter((_SYMBOLS.search(w) is not None for w in distinct), bool, len(distinct)) if symbols else np.zeros(len(distinct), bool)
    points = np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32))
    found = [(chr(c), int(points[c])) for c in np.flatnonzero(points)]
    letters, digits = sum(k for c, k in found if c.isalpha()), sum(k for c, k in found if c.isdigit())
    feats = [float(np.log1p(n)), chars / n, symbols / chars, dup / max(len(lines), 1), repeat / n, len(ids) / n, float(counts[cap].sum()) / n, letters / chars,
             digits / chars, float(counts[small].sum()) / n, n / max(len(lines), 1), float(counts.max()) / n, float(counts[marked].sum()) / n, t.count("!") / n]
    return [n, chars, symbols, dup, repeat], feats


@dataclass
class Trees:
    """All trees in flat arrays: node i tests ``feature[i]`` against ``limit[i]``; leaves have feature -1 and a value."""

    roots: np.ndarray
    feature: np.ndarray
    limit: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    base: float
    depth: int

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row: every row walks down all trees at once."""
        rows = np.arange(len(x))[:, None]
        at = np.broadcast_to(self.roots, (len(x), len(self.roots))).copy()
        for _ in range(self.depth):
            f = self.feature[at]
            down = np.where(x[rows, np.maximum(f, 0)] <= self.limit[at], self.left[at], self.right[at])
            at = np.where(f >= 0, down, at)
        return self.base + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def _grow(binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray, way: Sequence[int], depth: int, least: int, shrink: float, ridge: float, nodes: dict) -> int:
    """Grow one tree on gradients; returns its root. A split on a constrained feature must keep the order of its sides, whose
    values are further held on their side of the middle, so the whole tree is monotone."""
    def leaf(rows: np.ndarray, low: float, high: float) -> float:
        return float(np.clip(g[rows].sum() / (h[rows].sum() + ridge), low, high))

    def add(f: int, limit: float, value: float) -> int:
        for k, v in (("feature", f), ("limit", limit), ("left", -1), ("right", -1), ("value", value)):
            nodes[k].append(v)
        return len(nodes["feature"]) - 1

    def build(rows: np.ndarray, level: int, low: float, high: float) -> int:
        gs, hs = g[rows].sum(), h[rows].sum()
        best = (1e-9, -1, 0, 0.0, 0.0)
        if level < depth and len(rows) >= 2 * least:
            for f in range(binned.shape[1]):
                if not len(edges[f]):
                    continue
                size = len(edges[f]) + 1
                col = binned[rows, f]
                gl, hl, nl = (np.cumsum(np.bincount(col, w, size))[:-1] for w in (g[rows], h[rows], None))
                gr, hr, nr = gs - gl, hs - hl, len(rows) - nl
                vl, vr = np.clip(gl / (hl + ridge), low, high), np.clip(gr / (hr + ridge), low, high)
                gain = 2 * (gl * vl + gr * vr) - (hl + ridge) * vl * vl - (hr + ridge) * vr * vr
                gain[(nl < least) | (nr < least) | (way[f] * (vr - vl) < 0)] = -np.inf
                k = int(gain.argmax())
                whole = float(np.clip(gs / (hs + ridge), low, high))
                rise = gain[k] - (2 * gs * whole - (hs + ridge) * whole * whole)
                if rise > best[0]:
                    best = (rise, f, k, float(vl[k]), float(vr[k]))
        _, f, k, vl, vr = best
        if f < 0:
            return add(-1, 0.0, shrink * leaf(rows, low, high))
        at, mid = add(f, float(edges[f][k]), 0.0), (vl + vr) / 2
        goes = binned[rows, f] <= k
        l_range, r_range = ((low, high), (low, high)) if not way[f] else ((low, mid), (mid, high)) if way[f] > 0 else ((mid, high), (low, mid))
        nodes["left"][at] = build(rows[goes], level + 1, *l_range)
        nodes["right"][at] = build(rows[~goes], level + 1, *r_range)
        return at

    return build(np.arange(len(g)), 0, -np.inf, np.inf)


def boost(x: np.ndarray, y: np.ndarray, way: Sequence[int], trees: int = 60, depth: int = 4, shrink: float = 0.2, least: int = 5, ridge: float = 1.0, bins: int = 64) -> Trees:
    """Logistic gradient boosting on quantile bins; rows of the rarer class weigh more, so that both weigh the same."""
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1])) for c in x.T]
    edges = [e[e < c.max()] for e, c in zip(edges, x.T)]
    binned = np.stack([np.searchsorted(e, c, side="left") for e, c in zip(edges, x.T)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    weight = np.where(y > 0, 0.5 / share, 0.5 / (1 - share))
    margin, roots, nodes = np.zeros(len(y)), [], {k: [] for k in ("feature", "limit", "left", "right", "value")}
    out = None
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        roots.append(_grow(binned, edges, weight * (y - p), weight * p * (1 - p), way, depth, least, shrink, ridge, nodes))
        one = Trees(np.array(roots[-1:]), *(np.array(nodes[k]) for k in ("feature", "limit", "left", "right", "value")), 0.0, depth)
        margin += one.margin(x)
        out = Trees(np.array(roots), one.feature, one.limit, one.left, one.right, one.value, 0.0, depth)
    return out


def document_statistics(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Base counts and the features (array) of every whole text."""
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([d.schema["doc_id"], *[StructField(c, LongType()) for c in BASE], StructField("features", ArrayType(DoubleType()))])
    return d.mapInArrow(_worker(None, schema.names, None), schema)


def _worker(shared, names: Sequence[str], least: float | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [statistics(t.as_py()) for t in b.column(1)]
            base = np.array([r[0] for r in rows], np.int64).reshape(-1, len(BASE))
            x = np.array([r[1] for r in rows]).reshape(-1, len(FEATURES))
            cols = [b.column(0), *[pa.array(c) for c in base.T]]
            if shared is None:
                yield pa.RecordBatch.from_arrays([*cols, pa.array(list(x), pa.list_(pa.float64()))], names=list(names))
                continue
            failed = (base[:, 0] < 50) | (100 * base[:, 4] > 50 * base[:, 0])
            score = shared.value.score(x) if shared.value is not None else np.ones(len(x))
            yield pa.RecordBatch.from_arrays([*cols, pa.array(failed), pa.array(score), pa.array(~failed & (score >= least))], names=list(names))
    return run


def fit_quality(docs: DataFrame, labels: DataFrame, sample_rows: int = 20000, doc_id: str = "doc_id", text: str = "text", label: str = "quality") -> Trees | None:
    """Train on the ``sample_rows`` labelled documents with the smallest hash-random keys (a documented bound); None unless both classes occur.

    A document with contradicting labels counts as bad; labels that are null or without a document are left out.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(doc_id).isNotNull()).groupBy(doc_id).agg((F.min(label) > 0).cast("int").alias("__y"))
    sample = known.orderBy(id_key(F.col(doc_id), "quality"), doc_id).limit(sample_rows)
    chosen = docs.select(F.col(doc_id).alias("doc_id"), text).join(F.broadcast(sample.select(F.col(doc_id).alias("doc_id"))), "doc_id", "left_semi")
    stats = document_statistics(chosen.dropDuplicates(["doc_id"]), "doc_id", text)
    rows = stats.join(sample.withColumnRenamed(doc_id, "doc_id"), "doc_id").select("features", "__y").toArrow()
    y = rows["__y"].to_numpy().astype(float)
    if not len(y) or y.min() == y.max():
        return None
    x = rows["features"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(y), -1)
    order = np.lexsort([*x.T, y])  # the result must not depend on the order in which rows arrive
    return boost(x[order], y[order], [w for _, w in FEATURES])


def rate_quality(docs: DataFrame, model: Trees | None, least: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, the base counts, base_failed, quality (0 to 1) and kept, for every whole text.

    ``base_failed``: fewer than 50 words, or more than half of the words in repeated windows; such documents are never kept. Others are kept
    if the trees' score is ``least`` or more; without a model (no labels) all others are kept. Null and empty texts have no words, so they fail.
    Repeated rows are rated each; further columns are ignored.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    schema = StructType([d.schema["doc_id"], *[StructField(c, LongType()) for c in BASE], StructField("base_failed", BooleanType()), StructField("quality", DoubleType()), StructField("kept", BooleanType())])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a few thousand nodes at most
    return d.mapInArrow(_worker(shared, schema.names, least), schema)
