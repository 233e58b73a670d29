"""Language model scores by deleted interpolation of word n-grams.

Texts are dealt into blocks of bounded size. Every block asks for the counts of its distinct n-grams: the keys go, sorted and in buckets, to
the tasks that add them up over all blocks, and the sums come back in the same order. So a frequent word costs a block one key
however often it occurs, no task sees more than a block or a bucket, and nothing corpus-wide is held in one place. N-grams are
told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, LongType, StructField, StructType

from pagetext.llm.common import id_fold, release, stored

END, START = 0, 1  # codes of the end token and of what stands before the first word
STEPS = 4  # of a factor two, to which ratios are rounded while the weights are learned
SLICE = 1 << 17  # tokens whose estimates are held at a time
EVAL, KEPT, HELD = 0, 1, 2  # roles of a document: not learned from, counted, held out for the weights
_COUNTS = "block bigint, bucket bigint, kept array<bigint>, total array<bigint>"


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Block:
    """Tokens of a block's documents and the keys of their n-grams."""

    def __init__(self, texts: pa.ChunkedArray, roles: np.ndarray, order: int):
        from xxhash import xxh64_intdigest

        codes: dict[bytes, int] = {}
        parts, sizes = [], []
        for t in texts:
            words = (t.as_py() or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits
            parts.append(np.fromiter((codes.setdefault(w, len(codes) + 2) for w in words), np.int32, len(words)))
            parts.append(np.zeros(1, np.int32))
            sizes.append(len(words) + 1)
        self.sizes = np.array(sizes, np.int64)
        self.first = np.cumsum(self.sizes) - self.sizes
        cur = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        names = np.fromiter((xxh64_intdigest(w) for w in codes), np.uint64, len(codes))
        names = _mix(np.concatenate([np.array([0x5EED, 0x57A7], np.uint64), names]) + np.uint64(1))
        self.role = np.repeat(roles, self.sizes)
        #: keys[k]: key of the (k+1)-gram that ends at each token
        self.keys = [names[cur]]
        for k in range(1, order):
            context = self.before(self.keys[-1], k)
            self.keys.append(_mix(context * np.uint64(0x9E3779B97F4A7C15) + names[cur]))
        self.distinct = [np.unique(x) for x in self.keys]

    def before(self, keys: np.ndarray, k: int) -> np.ndarray:
        """Key of the k words before each token; before the first word stands the start."""
        out = np.empty_like(keys)
        out[1:] = keys[:-1]
        out[self.first] = _mix(np.array([START + 100 + k], np.uint64))
        return out

    def buckets(self, level: int, n: int) -> np.ndarray:
        """Bucket of each distinct key; they grow with the sorted keys."""
        return (self.distinct[level] >> np.uint64(32)).astype(np.int64) * n >> 32


def _requests(order: int, buckets: int):
    def run(group: pa.Table) -> pa.Table:
        b = Block(group["text"], group["role"].to_numpy(), order)
        rows = []
        for level in range(order):
            distinct = b.distinct[level]
            counts = []
            for role in (KEPT, HELD):
                some, n = np.unique(b.keys[level][b.role == role], return_counts=True)
                c = np.zeros(len(distinct), np.int32)
                c[np.searchsorted(distinct, some)] = n
                counts.append(c)
            where = b.buckets(level, buckets)
            cuts = np.searchsorted(where, np.arange(buckets + 1))
            for k, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                if x < y:
                    rows.append((group["block"][0].as_py(), level * buckets + k, distinct[x:y].view(np.int64), counts[0][x:y], counts[1][x:y]))
        cols = list(zip(*rows))
        return pa.table([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.list_(pa.int64())), pa.array(cols[3], pa.list_(pa.int32())), pa.array(cols[4], pa.list_(pa.int32()))],
                        names=["block", "bucket", "keys", "kept", "held"])
    return run


def _sums(buckets: int):
    def run(group: pa.Table) -> pa.Table:
        flat = lambda name: group[name].combine_chunks().flatten().to_numpy(zero_copy_only=False)
        _, at = np.unique(flat("keys"), return_inverse=True)
        kept = np.bincount(at, flat("kept")).astype(np.int64)
        total = kept + np.bincount(at, flat("held")).astype(np.int64)
        ends = np.cumsum(group["keys"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False))
        split = lambda x: np.split(x[at], ends[:-1])
        bucket = group["bucket"][0].as_py()
        blocks, k, t = group["block"].to_pylist(), split(kept), split(total)
        out_kept, out_total = list(k), list(t)
        if bucket < buckets:  # single words: a row of block -1 carries vocabulary and tokens of this bucket
            blocks, out_kept, out_total = [*blocks, -1], [*out_kept, np.array([(kept > 0).sum(), kept.sum()])], [*out_total, np.array([(total > 0).sum(), total.sum()])]
        return pa.table([pa.array(blocks, pa.int64()), pa.array([bucket] * len(blocks), pa.int64()), pa.array(out_kept, pa.list_(pa.int64())), pa.array(out_total, pa.list_(pa.int64()))], names=["block", "bucket", "kept", "total"])
    return run


def _answers(b: Block, counts: pa.Table, order: int, buckets: int, column: str) -> list[np.ndarray]:
    """Corpus counts of each level's distinct keys, put together from the buckets."""
    by = np.argsort(counts["bucket"].to_numpy())
    flat = counts[column].combine_chunks().take(pa.array(by))
    joined = flat.flatten().to_numpy(zero_copy_only=False)
    ends = np.cumsum([0] + [len(x) for x in b.distinct])
    return [joined[x:y] for x, y in zip(ends[:-1], ends[1:])]


def _slices(at: np.ndarray) -> Iterator[np.ndarray]:
    """``at`` in slices, so that the estimates of a block are never held for all its tokens."""
    return (at[k:k + SLICE] for k in range(0, len(at), SLICE))


def _estimates(b: Block, answers: list[np.ndarray], n: int, v: int, at: np.ndarray):
    """(estimates by order from uniform up, context bucket, count of the token) of the tokens ``at``."""
    count = [a[np.searchsorted(d, k[at])].astype(np.int64) for a, d, k in zip(answers, b.distinct, b.keys)]
    ends = int(answers[0][np.searchsorted(b.distinct[0], b.keys[0][b.first[0] + b.sizes[0] - 1])]) if len(b.sizes) else 0
    est = [np.full(len(at), 1.0 / (v + 1)), count[0] / n if n else np.zeros(len(at))]
    context = np.zeros(len(at), np.int64)
    starts = np.isin(at, b.first, assume_unique=True)
    for k in range(1, len(b.keys)):
        # Before the first word there is a start for every document, so its count is that of the end token.
        context = np.where(starts, ends, answers[k - 1][np.searchsorted(b.distinct[k - 1], b.keys[k - 1][at - 1])]).astype(np.int64)
        est.append(np.where(context > 0, count[k] / np.maximum(context, 1), 0.0))
    bucket = np.zeros(len(at), np.int64) if len(b.keys) == 1 else np.frexp(context)[1].astype(np.int64)  # 0, 1, 2-3, 4-7, ...
    return est, bucket, count[0]


def _cells(order: int, buckets: int, n: int, v: int):
    """Held-out tokens of a block, counted by context bucket and rounded log ratios of the estimates to the uniform one."""
    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        names = ["bucket", *[f"r{k}" for k in range(1, order + 1)], "n"]
        if not docs.num_rows:
            return pa.table([pa.array([], pa.int64())] * len(names), names=names)
        b = Block(docs["text"], docs["role"].to_numpy(), order)
        answers, parts = _answers(b, counts, order, buckets, "kept"), [np.zeros((0, order + 2), np.int64)]
        for at in _slices(np.flatnonzero(b.role == HELD)):
            est, bucket, _ = _estimates(b, answers, n, v, at)
            with np.errstate(divide="ignore"):
                ratios = [np.where(e > 0, np.round(STEPS * np.log2(np.maximum(e, 1e-300) / est[0])), -9999).astype(np.int64) for e in est[1:]]
            cells, times = np.unique(np.stack([bucket, *ratios], axis=1), axis=0, return_counts=True)
            parts.append(np.column_stack([cells, times]))
        return pa.table([pa.array(np.ascontiguousarray(c)) for c in np.concatenate(parts).T], names=names)
    return run


def learn_weights(cells: np.ndarray, order: int, rounds: int = 60) -> dict[int, np.ndarray]:
    """Weights of the estimates (uniform first) per context bucket, by expectation-maximisation on held-out counts.

    ``cells``: rows of (bucket, log ratios, count). Each bucket starts from the weights learned over all buckets, with one
    token's worth of prior, so that rare buckets stay near it and no weight is zero.
    """
    size = order + 1

    def em(part: np.ndarray, prior: np.ndarray) -> np.ndarray:
        ratio = np.concatenate([np.ones((len(part), 1)), np.where(part[:, 1:-1] <= -9999, 0.0, np.exp2(part[:, 1:-1] / STEPS))], axis=1)
        w, n = prior.copy(), part[:, -1]
        for _ in range(rounds):
            share = ratio * w
            share /= share.sum(axis=1, keepdims=True)
            w = (share * n[:, None]).sum(axis=0) + prior
            w /= w.sum()
        return w

    even = np.full(size, 1 / size)
    if not len(cells):
        return {-1: even}
    pooled = em(cells, even)
    return {-1: pooled, **{int(b): em(cells[cells[:, 0] == b], pooled) for b in np.unique(cells[:, 0])}}


def _scores(order: int, buckets: int, n: int, v: int, weights: dict[int, np.ndarray]):
    highest = max(weights)
    table = np.stack([weights.get(k, weights.get(highest if k > highest >= 0 else -1)) for k in range(66)])

    def run(docs: pa.Table, counts: pa.Table) -> pa.Table:
        names = ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
        if not docs.num_rows:
            return pa.table([docs["doc_id"], pa.array([], pa.bool_()), *[pa.array([], pa.int64())] * 3, *[pa.array([], pa.float64())] * 2], names=names)
        b = Block(docs["text"], docs["role"].to_numpy(), order)
        answers, size = _answers(b, counts, order, buckets, "total"), len(b.role)
        known, plain, mixed = np.empty(size, bool), np.empty(size), np.empty(size)
        for at in _slices(np.arange(size)):
            est, bucket, c = _estimates(b, answers, n, v, at)
            w = table[bucket]
            known[at], plain[at] = c > 0, np.log10((c + 1) / (n + v + 1))
            mixed[at] = np.log10(sum(w[:, k] * e for k, e in enumerate(est)))
        add = lambda x: np.add.reduceat(x, b.first)
        rows = len(b.sizes)
        return pa.table([docs["doc_id"], pa.array(docs["role"].to_numpy() == EVAL), pa.array(b.sizes), pa.array(add(known.astype(np.int64))), pa.array(np.full(rows, n, np.int64)), pa.array(add(plain)), pa.array(np.minimum(add(mixed), 0.0))], names=names)
    return run


def score_texts(docs: DataFrame, order: int = 2, block_chars: int = 6 << 20, fold: int = 2, held_fold: int = 4, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Log10 probability of every whole text: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Lower-case A-Z; tokens are the words and one end. Counts come from all documents whose crc32 of the id modulo 7 is not ``fold``. The
    estimates of the orders up to ``order`` and a uniform one over the vocabulary and one unknown word are mixed by weights per context-frequency bucket
    (powers of two). The weights are learned on the documents of ``held_fold``, with counts of the other training documents; then all
    training documents are counted for the scores. ``base_score`` is the add-one unigram score.

    Null text counts as empty: one end token. Repeated rows count and are scored each. Without training documents every estimate but the
    uniform one is zero. Further columns are ignored.
    """
    spark = docs.sparkSession
    part = id_fold(F.col(doc_id), 7)
    role = F.when(part == fold, EVAL).when(part == held_fold, HELD).otherwise(KEPT).cast("int")
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"), role.alias("role"))
    chars = d.agg(F.sum(F.length("text") + 1)).first()[0] or 0
    blocks = buckets = max(1, -(-chars // block_chars))
    d = d.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)))

    asked = d.groupBy("block").applyInArrow(_requests(order, buckets), "block bigint, bucket bigint, keys array<bigint>, kept array<int>, held array<int>")
    counts = stored(asked.groupBy("bucket").applyInArrow(_sums(buckets), _COUNTS), "counts")
    del asked
    release(spark)
    sizes = counts.filter("block = -1").agg(*[F.sum(F.col(c)[i]) for c in ("kept", "total") for i in (0, 1)]).first()
    v_kept, n_kept, v_total, n_total = (x or 0 for x in sizes)
    counts = counts.filter("block >= 0")

    names = ["bucket", *[f"r{k}" for k in range(1, order + 1)]]
    found = d.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_cells(order, buckets, n_kept, v_kept), ", ".join(f"{c} bigint" for c in [*names, "n"]))
    cells = found.groupBy(*names).agg(F.sum("n").alias("n")).toPandas()  # few: buckets of contexts times rounded ratios
    weights = learn_weights(cells.sort_values(names).to_numpy(np.float64), order)
    del found
    release(spark)
    schema = StructType([d.schema["doc_id"], StructField("held_out", BooleanType()), *[StructField(c, LongType()) for c in ("n_tokens", "n_known", "train_tokens")], StructField("base_score", DoubleType()), StructField("score", DoubleType())])
    return d.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_scores(order, buckets, n_total, v_total, weights), schema)
