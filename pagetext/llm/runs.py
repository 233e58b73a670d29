"""Periodic runs of words by recompression.

The words of a batch of texts are compressed into one run-length grammar: block compression replaces a stretch of one symbol, pair compression replaces
neighbours whose symbols lie in the two halves of the alphabet, in turn, until no symbol repeats. Equal stretches are parsed
alike but for their borders, so the longest common extension of two positions takes a few steps a level, up and down again.
Positions on a grid of three periods are extended to both sides this way; whatever is long enough is a run.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

BATCH_WORDS = 400_000  # words of one grammar, unless a single text has more
QUERIES = 1_000_000  # extensions asked at a time
_BLANK = r"[\x20\x09-\x0D]+"


@dataclass
class Level:
    """One string of the grammar: symbols, where they start in the text, and the index of their parent on the next level."""

    symbol: np.ndarray
    start: np.ndarray  # one more at the end: the length of the text
    block: bool = False  # whether the next level comes from block compression
    parent: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    first: np.ndarray = field(default_factory=lambda: np.zeros(0, bool))  # whether a symbol is its parent's first
    heads: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # every parent's first symbol; one more at the end
    stretch: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))  # block levels: where the symbol's stretch begins; one more at the end


def _side(symbol: np.ndarray, seed: int) -> np.ndarray:
    """A fixed half of the alphabet, another one for every seed."""
    with np.errstate(over="ignore"):
        x = (symbol.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        x = (x ^ (x >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return (x >> np.uint64(40)) & np.uint64(1) == 1


def _named(keys: np.ndarray, free: int) -> tuple[np.ndarray, int, bool]:
    """(a new symbol for every distinct key, next free symbol, whether any key repeats)."""
    distinct, at = np.unique(keys, return_inverse=True)
    return at + free, free + len(distinct), len(distinct) < len(keys)


def recompress(symbols: np.ndarray) -> list[Level]:
    """The levels of the run-length grammar of ``symbols`` (numbers from 0), up to one without repeated symbols."""
    levels = [Level(symbols.astype(np.int64), np.arange(len(symbols) + 1))]
    free = int(symbols.max()) + 1 if len(symbols) else 1
    seed = 0
    while True:
        low = levels[-1]
        s = low.symbol
        again = False
        if not seed % 2:  # blocks; symbols that stand alone keep their name
            begins = np.concatenate([[True], s[1:] != s[:-1]]) if len(s) else np.zeros(0, bool)
            heads = np.flatnonzero(begins)
            counts = np.diff(np.append(heads, len(s)))
            name, many = s[heads].copy(), np.flatnonzero(counts > 1)
            if len(many):
                name[many], free, again = _named(name[many] * (int(counts.max()) + 1) + counts[many], free)
            low.block, low.first = True, begins
            low.stretch = np.append(heads[np.cumsum(begins) - 1], len(s)) if len(s) else np.zeros(1, np.int64)
        else:
            left = _side(s, seed)
            paired = left[:-1] & ~left[1:] if len(s) else np.zeros(0, bool)
            begins = np.concatenate([[True], ~paired]) if len(s) else np.zeros(0, bool)
            heads = np.flatnonzero(begins)
            name, pairs = s[heads].copy(), np.flatnonzero(paired)
            if len(pairs):
                at = np.cumsum(begins)[pairs] - 1
                name[at], free, again = _named(s[pairs] * free + s[pairs + 1], free)
            low.first = begins
        low.parent, low.heads = np.cumsum(begins) - 1, np.append(heads, len(s))
        levels.append(Level(name, np.append(low.start[heads], low.start[-1])))
        seed += 1
        if not again and len(np.unique(name)) == len(name):
            return levels


def extensions(levels: list[Level], a: np.ndarray, b: np.ndarray, back: bool = False) -> np.ndarray:
    """How many symbols the text shares from positions ``a`` and ``b`` (a < b) on; ``back``: up to and including them, leftwards.

    Climbs while both positions head equal symbols, then descends to the first difference. A unique symbol must stand at both ends of the text.
    """
    way = -1 if back else 1
    x, y = a.astype(np.int64).copy(), b.astype(np.int64).copy()
    level = np.zeros(len(x), np.int64)  # where the climb of a query ended

    def step(low: Level, p: np.ndarray, q: np.ndarray) -> np.ndarray:
        """Equal symbols are passed one by one, of stretches as many as both still have."""
        if not low.block:
            return np.ones(len(p), np.int64)
        if back:
            return np.minimum(p - low.stretch[p], q - low.stretch[q]) + 1
        return np.minimum(low.heads[low.parent[p] + 1] - p, low.heads[low.parent[q] + 1] - q)

    def heads(low: Level, p: np.ndarray) -> np.ndarray:
        """Whether a symbol is its parent's first, or backwards its last."""
        if not back:
            return low.first[p]
        nxt = np.minimum(p + 1, len(low.first) - 1)
        return low.first[nxt] | (p == len(low.first) - 1)

    live = np.arange(len(x))
    for h, low in enumerate(levels):
        top = h == len(levels) - 1
        climbing = []
        while len(live):
            p, q = x[live], y[live]
            same = low.symbol[p] == low.symbol[q]
            level[live[~same]] = h
            live, p, q = live[same], p[same], q[same]
            if not top:
                up = heads(low, p) & heads(low, q)
                climbing.append(live[up])
                x[live[up]], y[live[up]] = low.parent[p[up]], low.parent[q[up]]
                live, p, q = live[~up], p[~up], q[~up]
            move = step(low, p, q)
            x[live], y[live] = p + way * move, q + way * move
        live = np.concatenate(climbing) if climbing else np.zeros(0, np.int64)
    for h in range(len(levels) - 2, -1, -1):
        low = levels[h]
        down = np.flatnonzero(level > h)
        if not len(down):
            continue
        # the first (backwards: the last) child of the differing symbols
        x[down], y[down] = (low.heads[z[down] + 1] - 1 if back else low.heads[z[down]] for z in (x, y))
        live = down
        while len(live):
            p, q = x[live], y[live]
            same = low.symbol[p] == low.symbol[q]
            live, p, q = live[same], p[same], q[same]
            move = step(low, p, q)
            x[live], y[live] = p + way * move, q + way * move
    return a - x if back else x - a


def runs_of(symbols: np.ndarray, sizes: np.ndarray, periods: int = 4, least: int = 6) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All runs of texts laid end to end: (text, start, length, period), sorted by text, start and period.

    ``symbols`` are the words of all texts as numbers, ``sizes`` the words of each. A run is a stretch of smallest period q and length at least
    max(``least``, ``periods`` * q) that cannot be extended.
    """
    texts = len(sizes)
    base = np.cumsum(sizes) - sizes + np.arange(texts) + 1  # where a text begins between the separators
    words = int(symbols.max()) + 1 if len(symbols) else 0
    laid = np.empty(len(symbols) + texts + 1, np.int64)
    laid[0] = words + texts
    laid[base + sizes] = words + np.arange(texts)
    inside = np.ones(len(laid), bool)
    inside[0], inside[base + sizes] = False, False
    laid[inside] = symbols
    levels = None
    # every (text, period) with room for a run; positions i on a grid no wider than a run less its period
    most = np.where(sizes >= least, sizes // periods, 0)
    owner = np.repeat(np.arange(texts), most)
    period = np.arange(len(owner)) - np.repeat(np.cumsum(most) - most, most) + 1
    grid = np.maximum((periods - 1) * period, least - period)
    points = -(-(sizes[owner] - period) // grid)
    found = []
    cuts = np.searchsorted(np.cumsum(points), np.arange(QUERIES, int(points.sum()) + QUERIES, QUERIES), side="right")
    at = 0
    for end in np.unique(np.append(cuts, len(points))):
        n = points[at:end]
        q, g, own = (np.repeat(z[at:end], n) for z in (period, grid, owner))
        i = (np.arange(len(q)) - np.repeat(np.cumsum(n) - n, n)) * g + base[own]
        at = end
        hit = np.flatnonzero(laid[i] == laid[i + q])
        if not len(hit):
            continue
        levels = levels or recompress(laid)
        i, q, own = i[hit], q[hit], own[hit]
        ahead = extensions(levels, i, i + q)
        behind = extensions(levels, i - 1, i + q - 1, back=True)
        length = ahead + behind + q
        ok = length >= np.maximum(least, periods * q)
        rows = np.stack([own, i - behind - base[own], length, q])[:, ok]
        found.append(np.unique(rows, axis=1) if rows.shape[1] else rows)
    if not found:
        return (np.zeros(0, np.int64),) * 4
    rows = np.concatenate(found, axis=1)
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    # a stretch found with several periods has the smallest; the others are its multiples
    new = np.ones(rows.shape[1], bool)
    new[1:] = (np.diff(rows[:3], axis=1) != 0).any(axis=0)
    rows = rows[:, new]
    return tuple(rows[:, np.lexsort((rows[3], rows[1], rows[0]))])


def _words(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(all words one after another, words of each text)."""
    parts = pc.split_pattern_regex(pc.fill_null(texts, ""), _BLANK)
    sizes = pc.list_value_length(parts).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = parts.flatten()
    real = pc.not_equal(flat, "")
    row = np.repeat(np.arange(len(sizes)), sizes)
    return flat.filter(real), np.bincount(row[real.to_numpy(zero_copy_only=False)], minlength=len(sizes))


def _cuts(sizes: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of texts of bounded size together, a larger text alone."""
    at, total = 0, 0
    for k, n in enumerate(sizes):
        if k > at and total + n > BATCH_WORDS:
            yield at, k
            at, total = k, 0
        total += n
    if at < len(sizes):
        yield at, len(sizes)


def _text_runs(periods: int, least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            lengths = pc.fill_null(pc.binary_length(whole.column(1)), 0).to_numpy(zero_copy_only=False) // 4  # about the words
            for a, b in _cuts(lengths):
                part = whole.slice(a, b - a)
                words, sizes = _words(part.column(1))
                codes = words.dictionary_encode().indices.to_numpy(zero_copy_only=False).astype(np.int64)
                own, start, length, period = runs_of(codes, sizes, periods, least)
                base = np.cumsum(sizes) - sizes
                change = np.zeros(len(codes) + 1, np.int64)
                np.add.at(change, base[own] + start + period, 1)
                np.add.at(change, base[own] + start + length, -1)
                keep = np.cumsum(change[:-1]) == 0
                row = np.repeat(np.arange(len(sizes)), sizes)
                kept = np.append(0, np.cumsum(np.bincount(row[keep], minlength=len(sizes)))).astype(np.int32)
                joined = pc.binary_join(pa.ListArray.from_arrays(pa.array(kept), words.filter(pa.array(keep))), " ")
                spans = pa.StructArray.from_arrays([pa.array(start), pa.array(length), pa.array(period)], names=["start", "length", "period"])
                off = np.append(0, np.cumsum(np.bincount(own, minlength=len(sizes)))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes), pa.ListArray.from_arrays(pa.array(off), spans), joined], names=["doc_id", "n_words", "runs", "collapsed"])
    return run


def periodic_runs(docs: DataFrame, periods: int = 4, least: int = 6, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_words, runs (array of start, length, period, sorted by start and period) and collapsed for every whole text.

    Words are runs without ASCII white space, numbered from 0. A run is a stretch of consecutive words whose smallest period q gives
    a length of at least max(``least``, ``periods`` * q) and that no neighbouring word extends. ``collapsed`` joins by one space the words
    that no run holds after its first q words. ``periods`` is 2 or more and ``least`` is ``periods`` or more.

    Null, empty and blank texts have no words, no runs and an empty ``collapsed``; repeated rows each give a row, ids may be null, and
    further columns are ignored. A batch of texts shares a grammar; a very long text has one of its own.
    """
    d = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    spans = StructType([StructField(c, LongType()) for c in ("start", "length", "period")])
    schema = StructType([d.schema["doc_id"], StructField("n_words", LongType()), StructField("runs", ArrayType(spans)), StructField("collapsed", StringType())])
    return d.mapInArrow(_text_runs(periods, least), schema)


def with_planted_periods(text: Column, doc_id: Column) -> Column:
    """The text; of a tenth of the ids (by crc32 h of the decimal id) the words from a = (h/10) % n on repeat the first p of them,
    p = 1 + (n-a) / (3 + (h/10) % 8). Such a text's words are joined by one space. Texts without words or id stay."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def periodic(ws: Column) -> Column:
        n = F.size(ws).cast("long")
        a = g % n
        p = F.floor((n - a) / (3 + g % 8)) + 1
        facts = F.struct(a.alias("a"), p.alias("p"), ws.alias("ws"))
        word = lambda f: lambda w, i: F.when(i < f["a"], w).otherwise(F.get(f["ws"], (f["a"] + (i - f["a"]) % f["p"]).cast("int")))
        return F.transform(F.array(facts), lambda f: F.array_join(F.transform(f["ws"], word(f)), " "))[0]

    words = F.filter(F.split(text, _BLANK), lambda w: w != "")
    planted = F.transform(F.array(words), lambda ws: F.when(F.size(ws) > 0, periodic(ws)).otherwise(""))[0]
    return F.when((h % 10 == 0) & text.isNotNull(), planted).otherwise(text)


def digest_runs(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the run with the greatest length/period (ties: smallest start, then period) and the digests of runs and collapsed text."""
    def better(s: Column, r: Column) -> Column:
        return s.isNull() | (r["length"] * s["period"] > s["length"] * r["period"])  # exact; runs come by start, then period

    empty = F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>")
    best = F.aggregate("runs", empty, lambda s, r: F.when(better(s, r), r).otherwise(s))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    d = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), best.alias("best"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return d.select("doc_id", "n_runs", *[F.col(f"best.{c}").alias(c) for c in ("start", "length", "period")],
                    F.expr("1000 * best.length div best.period").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
