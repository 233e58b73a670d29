"""Near-duplicates by meet-in-the-middle ball hashing: SimHash classes, and groups by Jaccard similarity from several seeded fingerprints with an exact check."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagetext.llm.common import release, running_totals, stored
from pagetext.session import cut_lineage

BLOCK = 1 << 16  # shingles hashed at a time, so that a very long text needs no more memory than this
PRINTS, BITS = 12, 32  # seeded fingerprints of a text and their bits; at similarity 0.8 one is within two bits with 0.367, any of them with 0.996
SKETCH = PRINTS * BITS  # seeded minima, one bit of each; bits of two texts differ with (1 - similarity) / 2
SKETCHES = ("a", "b", "c", "d", "e", "f")  # the bits as longs, two fingerprints each
TOGETHER = 4  # fingerprints whose balls are shuffled at a time
VARIANTS = 1 << 20  # rows of a partition of the balls
PIECE = 1 << 12  # members of a bucket held against as many others in one task
FAR = 56  # differing bits of 384; at similarity 0.8 38.4 are expected, with a deviation of 5.9
_SEEDS = np.random.default_rng(42).integers(0, 1 << 63, (2, SKETCH), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: only A-Z change, only ASCII white space splits


def _hashed(words: list[bytes], width: int) -> Iterator[np.ndarray]:
    """XXH64 (seed 42) of all word shingles, in blocks; fewer words than ``width`` are one shingle."""
    from xxhash import xxh64_intdigest

    n = max(len(words) - width + 1, 1) if words else 0
    for at in range(0, n, BLOCK):
        part = words[at:min(at + BLOCK, n) + width - 1]
        shingles = map(b" ".join, zip(*(part[k:] for k in range(width)))) if len(words) >= width else iter([b" ".join(words)])
        yield np.fromiter((xxh64_intdigest(s, 42) for s in shingles), np.uint64)


def _fingerprint(text: str | None, width: int) -> int:
    """Bit majority of the hashes of all word shingles of the whole text; no words: zero. Signed 64 bits."""
    words = _words(text)
    if not words:
        return 0
    ones = np.zeros(64, np.int64)
    for hashes in _hashed(words, width):
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > max(len(words) - width + 1, 1), bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, width: int = 3, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, fp) of every row; ``fp`` is the fingerprint as a signed long. A null text has no words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = pa.array((_fingerprint(t.as_py(), width) for t in b.column(1)), pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), fp], names=["doc_id", "fp"])

    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = d.schema["doc_id"].dataType.simpleString()
    return d.mapInArrow(run, f"doc_id {kind}, fp bigint")


def ball(radius: int, width: int = 64) -> list[int]:
    """Masks of all changes of up to ``radius`` of ``width`` bits, as signed longs, fewest bits first."""
    masks = [sum(1 << b for b in bits) for r in range(radius + 1) for bits in combinations(range(width), r)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def links(fps: DataFrame, distance: int = 2) -> DataFrame:
    """Verified links (u < v) between distinct fingerprints that span all pairs at ``distance`` or fewer bits.

    Every fingerprint emits each variant within half the distance. Two fingerprints at the distance or less share a variant, and a
    variant is shared by at most as many distinct fingerprints as the ball has masks (65 for distance 2), so no
    group grows with the data. Of an even distance, the members of a variant are all within the distance of each other, so linking each to
    the smallest one keeps every pair connected; of an odd one, all pairs of the bounded group are compared.
    """
    half = (distance + 1) // 2
    f = fps.select("fp").distinct()
    masks = F.array(*[F.lit(m) for m in ball(half)])
    variants = f.select("fp", F.explode(masks).alias("m")).select("fp", F.col("fp").bitwiseXOR(F.col("m")).alias("variant"))
    if distance % 2 == 0:
        low = Window.partitionBy("variant")
        pairs = variants.select("fp", F.min("fp").over(low).alias("u")).filter("u <> fp").select("u", F.col("fp").alias("v"))
    else:
        groups = variants.groupBy("variant").agg(F.collect_list("fp").alias("g")).filter(F.size("g") > 1)
        pairs = (groups.select("g", F.explode("g").alias("u")).select("u", F.explode("g").alias("v")).filter("u < v"))
    return pairs.distinct().filter(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= distance)


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of every node with an edge (u, v); the component is its smallest node.

    Star contraction: every node is hooked to the smallest neighbour of its neighbourhood, larger ones first, then smaller
    ones. The number of rounds is logarithmic; settled leaves leave the loop early.
    """
    e = cut_lineage(edges.select(F.least("u", "v").alias("v"), F.greatest("u", "v").alias("u")).filter("u <> v").distinct())
    if e.isEmpty():
        return e.select(F.col("u").alias("node"), F.col("v").alias("component"))
    while True:
        both = e.unionByName(e.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("n"))
        small = large.join(least, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        e = cut_lineage(small.filter("u <> v").distinct())
        # A star forest: every node has one parent and no parent has one itself.
        nodes = e.groupBy("u").agg(F.count(F.lit(1)).alias("n"))
        if nodes.filter("n > 1").isEmpty() and e.join(e.select(F.col("u").alias("v")), "v", "left_semi").isEmpty():
            break
    return (e.select(F.col("u").alias("node"), F.col("v").alias("component"))
            .unionByName(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()))


def near_duplicates(docs: DataFrame, width: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Every document with its class: doc_id, fingerprint, component_id.

    Lower-case A-Z words in shingles of ``width``; fingerprints link at ``distance`` or fewer differing bits, and ``component_id`` is the
    smallest doc_id reachable. Equal fingerprints are one node of the search, so copies are never expanded into pairs. Null and empty texts
    have fingerprint zero and link like any other; repeated rows keep their rows; a null doc_id is never the
    smallest unless its class has no other. No rows: no rows. Further columns are ignored.
    """
    fps = stored(fingerprints(docs, width, doc_id, text), "fingerprints")
    first = fps.groupBy("fp").agg(F.min("doc_id").alias("least"))
    comp = components(links(fps, distance))
    classes = first.join(comp, F.col("fp") == F.col("node"), "left").select("fp", "least", F.coalesce("component", "fp").alias("component"))
    smallest = classes.groupBy("component").agg(F.min("least").alias("component_id"))
    # Only classes of several fingerprints need the second look-up, but both tables are one row per fingerprint at most.
    ids = classes.join(smallest, "component").select("fp", "component_id")
    return fps.join(ids, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def one_per_group(docs: DataFrame, width: int = 3, distance: int = 2, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each class, that of the smallest doc_id.

    A row that repeats both id and text goes; an id with several texts goes only if another document stands for all of them.
    Rows whose id is null are kept: without an id they can't be told apart.
    """
    classes = near_duplicates(docs, width, distance, doc_id, text).filter("doc_id is not null")
    gone = classes.groupBy("doc_id").agg(F.max(F.col("doc_id") == F.col("component_id")).alias("own")).filter("not own").select(F.col("doc_id").alias("__gone"))
    stay = docs.filter(F.col(doc_id).isNotNull()).join(gone, F.col(doc_id) == F.col("__gone"), "left_anti")
    stay = stay.withColumn("__same", F.xxhash64(text)).dropDuplicates([doc_id, "__same"]).drop("__same")
    return stay.unionByName(docs.filter(F.col(doc_id).isNull()))


def _sketch(text: str | None, width: int) -> tuple[bytes, list[int]]:
    """(digest of the words, one bit of each seeded minimum as longs) of a whole text."""
    from xxhash import xxh128_digest

    words = _words(text)
    low = np.full(SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for hashes in _hashed(words, width):
        for at in range(0, len(hashes), 512):
            low = np.minimum(low, ((hashes[at:at + 512, None] ^ _SEEDS[0]) * _SEEDS[1]).min(axis=0))
    return xxh128_digest(b" ".join(words)), np.packbits((low >> np.uint64(17)).astype(np.uint8) & 1).view("<i8").tolist()


def _sketches(rows: DataFrame, width: int, doc_id: str, text: str) -> DataFrame:
    """(__row, __id, __text, digest, *SKETCHES) of every row of ``rows`` (with ``__row``); ``__text`` is a hash of the text as it stands."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = [_sketch(t.as_py(), width) for t in b.column(3)]
            bits = np.array([m[1] for m in made], np.int64).reshape(-1, len(SKETCHES))
            more = [pa.array([m[0] for m in made], pa.binary()), *(pa.array(x) for x in bits.T)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], *more], names=["__row", "__id", "__text", "digest", *SKETCHES])

    d = rows.select("__row", F.col(doc_id).alias("__id"), F.xxhash64(text).alias("__text"), F.col(text).alias("t"))
    kind = d.schema["__id"].dataType.simpleString()
    return d.mapInArrow(run, f"__row bigint, __id {kind}, __text bigint, digest binary, " + ", ".join(f"{c} bigint" for c in SKETCHES))


def _balls(prints: DataFrame, nodes: int) -> DataFrame:
    """(bucket, node): the nodes whose fingerprint (``node``, ``fp``) lies within one bit of ``bucket``, for every bucket that can join two of them.

    Two fingerprints at two or fewer differing bits meet in the middle, in a variant one bit from both. Every distinct fingerprint emits its ball
    once; a variant keeps one long that says which of its neighbours occur, so only those that several share, or that several nodes have
    themselves, are looked up again.
    """
    values = prints.groupBy("fp").agg(F.count(F.lit(1)).alias("n"))
    masks = F.array(*[F.lit(m) for m in ball(1, BITS)])
    emitted = values.select("fp", "n", F.posexplode(masks).alias("i", "m"))
    emitted = emitted.select(F.col("fp").bitwiseXOR(F.col("m")).alias("bucket"), F.expr(f"shiftleft(1L, i) | if(i = 0 and n > 1, {1 << BITS + 1}L, 0L)").alias("who"))
    parts = nodes * TOGETHER * (BITS + 1) // VARIANTS + 1
    shared = emitted.repartition(parts, "bucket").groupBy("bucket").agg(F.bit_or("who").alias("who")).filter(F.bit_count("who") > 1)
    met = shared.select("bucket", F.expr(f"explode(filter(sequence(0, {BITS}), i -> (shiftrightunsigned(who, i) & 1L) = 1L))").alias("i"))
    met = met.select("bucket", F.col("bucket").bitwiseXOR(F.expr("if(i = 0, 0L, shiftleft(1L, i - 1))")).alias("fp"))
    return met.join(prints, "fp").select("bucket", "node")


def _candidates(nodes: DataFrame) -> DataFrame:
    """(bucket, node, *SKETCHES): buckets of nodes with a fingerprint within one bit of the bucket. A bucket tells its fingerprint by its upper half."""
    halves = [h for c in SKETCHES for h in (F.col(c).bitwiseAND(F.lit((1 << BITS) - 1)), F.shiftrightunsigned(c, BITS))]
    n, found = nodes.count(), None
    for at in range(0, PRINTS, TOGETHER):
        prints = nodes.select("node", F.explode(F.array(*[halves[k].bitwiseOR(F.lit(k << BITS)) for k in range(at, at + TOGETHER)])).alias("fp"))
        some = stored(_balls(prints, n), "balls")
        release(nodes.sparkSession)  # the balls are the largest shuffle of the stage
        found = some if found is None else found.unionByName(some)
    return found.join(nodes.select("node", *SKETCHES), "node")


def _shingle_sets(texts: DataFrame, width: int) -> DataFrame:
    """(node, set): the sorted distinct hashes of all shingles of each whole text ``t``, eight bytes each."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = (np.unique(np.concatenate([np.zeros(0, np.uint64), *_hashed(_words(t.as_py()), width)])).tobytes() for t in b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sets, pa.binary())], names=["node", "set"])

    return texts.select("node", "t").mapInArrow(run, "node bigint, set binary")


def _similar(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Those of ``pairs`` (u, v) whose sets of shingles (node, set) have a Jaccard similarity of ``least`` or more."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            same = []
            for x, y in zip(b.column(2), b.column(3)):
                x, y = np.frombuffer(x.as_py(), np.uint64), np.frombuffer(y.as_py(), np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                same.append(both >= least * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(same, pa.bool_()))

    d = (pairs.join(sets.select(F.col("node").alias("v"), F.col("set").alias("sv")), "v")
         .join(sets.select(F.col("node").alias("u"), F.col("set").alias("su")), "u"))
    return d.select("u", "v", "su", "sv").mapInArrow(run, "u bigint, v bigint")


def _asked_centres(buckets: DataFrame) -> DataFrame:
    """One pair (u < v) a node: the node and, of all that share a bucket with it, the one whose buckets are largest, which lies in the middle of a group."""
    sizes = buckets.groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
    weight = buckets.join(sizes, "bucket").groupBy("node").agg(F.sum("n").alias("n"))
    heads = buckets.join(weight, "node").groupBy("bucket").agg(F.max(F.struct("n", (-F.col("node")).alias("x"))).alias("head"))
    asked = buckets.join(heads, "bucket").groupBy("node").agg(F.max("head").alias("head")).select("node", (-F.col("head.x")).alias("x"))
    return asked.filter("node <> x").select(F.least("node", "x").alias("u"), F.greatest("node", "x").alias("v")).distinct()


def _close_pairs(node: np.ndarray, component: np.ndarray, asks: np.ndarray, own: np.ndarray, bits: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, ...]]:
    """(x, y, differing bits) of the asking nodes and the nodes of other components that are close; at most the ``most`` closest of each."""
    lie = np.flatnonzero(asks)
    for at in range(0, len(lie), 256):
        x = lie[at:at + 256]
        far = sum(np.bitwise_count(bits[x, None, k] ^ bits[None, :, k]).astype(np.int32) for k in range(bits.shape[1]))
        ok = (far <= FAR) & (component[x, None] != component[None, :])
        if own[0] != own[-1]:  # two pieces of a bucket; each meets itself elsewhere
            ok &= own[x, None] != own[None, :]
        if len(node) > most:
            far = np.where(ok, far, FAR + 1)
            ok &= far <= np.partition(far, most - 1, axis=1)[:, most - 1, None]
        i, j = np.nonzero(ok)
        yield node[x[i]], node[j], far[i, j]


def _met(state: DataFrame, bits: list[str], most: int | None) -> DataFrame:
    """Pairs (u < v) of different components that share a bucket and have close sketches, one of them outside of the bucket's largest component.

    A bucket is dealt by hash into pieces of about ``PIECE`` members; each two pieces meet in one task, where all sketches are compared at once, so
    only close pairs become rows. With ``most`` a node asks only that many, the closest of all its buckets.
    """
    parts = F.ceil(F.col("n") / PIECE)
    d = state.withColumn("own", F.pmod(F.xxhash64("node"), parts)).withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), parts - 1)))
    d = d.withColumns({"i": F.least("own", "other"), "j": F.greatest("own", "other"), "asks": F.col("component") != F.col("top")})
    step = F.row_number().over(Window.partitionBy("bucket", "i", "j").orderBy("own", "node"))
    d = d.select(step.alias("step"), "node", "component", "asks", "own", *bits)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(cols: list[np.ndarray], starts: np.ndarray, end: int) -> Iterator[pa.RecordBatch]:
            node, component, asks, own = cols[1:5]
            sketch, out = np.stack(cols[5:], axis=1).view(np.uint64), []
            for a, b in zip(starts, [*starts[1:], end]):
                if asks[a:b].any():
                    out += _close_pairs(node[a:b], component[a:b], asks[a:b], own[a:b], sketch[a:b], most or PIECE * 4)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*out)], names=["x", "y", "far"])

        held = None
        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            cols = cols if held is None else [np.concatenate(c) for c in zip(held, cols)]
            starts = np.flatnonzero(cols[0] == 1)
            if len(starts):
                yield from pairs([c[:starts[-1]] for c in cols], starts[:-1], starts[-1])
                cols = [c[starts[-1]:] for c in cols]
            held = cols
        if held is not None and len(held[0]):
            yield from pairs(held, np.zeros(1, np.int64), len(held[0]))

    met = d.mapInArrow(run, "x bigint, y bigint, far int")
    if most is not None:
        met = met.distinct().withColumn("k", F.row_number().over(Window.partitionBy("x").orderBy("far", "y"))).filter(F.col("k") <= most)
    return met.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")).distinct()


def similar_components(buckets: DataFrame, sets: DataFrame, least: float = 0.8) -> DataFrame:
    """(node, component) of the nodes that share a bucket (``bucket``, ``node`` and longs of sketch bits), linked by a Jaccard similarity of ``least`` or more.

    First every node asks one node in the middle of its buckets, then those outside of the largest component of a bucket ask the eight closest, then all close ones;
    the links found are contracted in between. A pair of one component is never compared and a bucket of one component is done. Two nodes of
    different components are never both in the largest one, so in the end every close pair is either compared or linked by others: no chain is lost, while
    a large group of similar nodes costs a few comparisons each, not one per pair. Close are sketches that do not rule the similarity out (``FAR``).
    """
    bits = [c for c in buckets.columns if c not in ("bucket", "node")]
    labels = buckets.select("node").distinct().withColumn("component", F.col("node"))
    pairs = tested = stored(_asked_centres(buckets.select("bucket", "node")), "pairs")
    state = buckets
    for most in (8, None, 0):
        found = stored(_similar(pairs, sets, least), "links")
        of = labels.select(F.col("node").alias("v"), F.col("component").alias("cv"))
        ends = found.join(of, "v").join(of.select(F.col("v").alias("u"), F.col("cv").alias("cu")), "u").select(F.col("cu").alias("u"), F.col("cv").alias("v"))
        joined = components(ends).select(F.col("node").alias("component"), F.col("component").alias("__to"))
        labels = stored(labels.join(joined, "component", "left").select("node", F.coalesce("__to", "component").alias("component")), "labels")
        if most == 0:
            break
        state = state.select("bucket", "node", *bits).join(labels, "node")
        sizes = state.groupBy("bucket", "component").agg(F.count(F.lit(1)).alias("m"))
        tops = (sizes.groupBy("bucket").agg(F.max_by("component", F.struct("m", "component")).alias("top"), F.count(F.lit(1)).alias("parts"), F.sum("m").alias("n"))
                .filter("parts > 1").select("bucket", "top", "n"))
        state = stored(state.join(tops, "bucket"), "open")
        pairs = stored(_met(state, bits, most).join(tested, ["u", "v"], "left_anti"), "pairs")
        tested = tested.unionByName(pairs)
    return labels


def one_per_similar_group(docs: DataFrame, least: float = 0.8, width: int = 5, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one row of each group of texts whose sets of ``width``-word shingles are linked by a Jaccard similarity of ``least`` or more.

    Every row counts on its own, whether its id is null, repeated or unique; that of the smallest id stays, of rows without one only if the group has no other,
    of equal ids that of the smallest text hash. Candidates have one of ``PRINTS`` seeded fingerprints at two or fewer differing bits, found by ball hashing, and are verified on all their shingles. Texts with
    the same words are one node of the search; texts without words are one group. Words are those of ``near_duplicates``.
    """
    rows = stored(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")
    marked = stored(_sketches(rows, width, doc_id, text), "sketches")
    order = ["__none", "__id", "__text", "__row"]
    first = marked.groupBy("digest").agg(F.min(F.struct(F.col("__id").isNull().alias("__none"), "__id", "__text", "__row")).alias("x")).select("x.*")
    first = running_totals(first, [], order, {"node": F.lit(1).cast("long")}).select("__row", "node")
    nodes = stored(marked.join(first, "__row").select("__row", "node", *SKETCHES), "nodes")
    buckets = stored(_candidates(nodes), "buckets")
    close = nodes.join(buckets.select("node").distinct(), "node", "left_semi").select("__row", "node")
    texts = rows.select("__row", F.col(text).alias("t")).join(close, "__row").select("node", "t")
    sets = stored(_shingle_sets(texts, width), "sets")
    gone = similar_components(buckets, sets, least).filter("node <> component").select("node")
    stay = nodes.select("__row", "node").join(gone, "node", "left_anti").select("__row")
    return rows.join(stay, "__row", "left_semi").drop("__row")
