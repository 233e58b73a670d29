"""Order-dependent rules against plain Python: repeats, insertion of regions, ranges."""

import random
import re
import time
from collections import namedtuple

from pyspark.sql import functions as F

from pagetext.functions import text as T
from pagetext.operators.order import _insert_sorted, _Placed
from pagetext.operators.prefix import expand_ranges

Region = namedtuple("Region", "page block_id band cx cy y1 y2 rtl")


def plain_repeats(text, threshold):
    """The shortest unit by back references; shorter repetitions are passed over whole."""
    for k in range(1, len(text) // threshold + 1):
        for m in re.finditer(r"(.{%d})\1+" % k, text):
            count = len(m.group()) // k
            if count >= threshold:
                return True, m.group(1), count, text[:m.start()] + text[m.end():], count
    return False, None, 0, text, threshold


def test_repeats_against_back_references():
    rng, hits = random.Random(4), 0
    for _ in range(800):
        threshold = rng.choice([2, 3, 5, 20])
        texts = []
        for _ in range(rng.randrange(1, 5)):
            t = "".join(rng.choice("ab\n") for _ in range(rng.randrange(30)))
            if rng.random() < 0.7:
                t += "".join(rng.choice("abé") for _ in range(rng.randrange(1, 9))) * rng.randrange(1, threshold + 4)
            texts.append(t + "".join(rng.choice("ab") for _ in range(rng.randrange(30))))
        want = [plain_repeats(t, threshold) for t in texts]
        hits += sum(w[0] for w in want)
        assert T.repeats_of(texts, threshold) == want
    assert hits > 500


def plain_insertion(rows):
    placed = []
    for r in rows:
        at = next((k for k, e in enumerate(placed) if r.cy <= e.y2 and (r.cy < e.y1 or (r.cx > e.cx if r.rtl else r.cx < e.cx))), None)
        placed.insert(len(placed) if at is None else at + (r.cy < placed[at].y1), r)
    return [(r.page, r.block_id, r.band, i) for i, r in enumerate(placed, 1)]


def regions(rng, n, rtl, swapped):
    rows = []
    for i in range(n):
        y1 = rng.randrange(n)
        y2 = y1 + rng.randrange(n)
        y1, y2 = (y2, y1) if rng.random() < swapped else (y1, y2)
        rows.append(Region(1, i, 1, rng.randrange(1000), (y1 + y2) / 2, y1, y2, rtl))
    return sorted(rows, key=lambda r: (r.cy, r.block_id))


def test_insertion_in_blocks(monkeypatch):
    rng = random.Random(1)
    for width in (2, 5, 128):
        monkeypatch.setattr(_Placed, "WIDTH", width)
        for _ in range(100):
            rows = regions(rng, rng.randrange(1, 80), rng.random() < 0.5, rng.choice([0, 0.3]))
            assert _insert_sorted(rows) == plain_insertion(rows)


def test_insertion_of_a_large_band():
    rows = regions(random.Random(2), 30000, True, 0)
    start = time.time()
    assert len(_insert_sorted(rows)) == 30000
    assert time.time() - start < 60


def test_expand_ranges(spark):
    df = spark.createDataFrame([("a", 1, 50000), ("b", 5, 5), ("c", 5, 4), ("d", None, 4)], "k string, a int, b int")
    got = expand_ranges(df, F.col("a"), F.col("b"), "n", piece=64).groupBy("k").agg(F.count("n").alias("c"), F.countDistinct("n").alias("d"), F.min("n").alias("a"), F.max("n").alias("b"))
    assert sorted(map(tuple, got.collect())) == [("a", 50000, 50000, 1, 50000), ("b", 1, 1, 5, 5)]
