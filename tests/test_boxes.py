"""Box operators against plain Python on random pages, with one hot page."""

import math
import random
import time
from collections import namedtuple

import pytest
from pyspark.sql import functions as F

from pagetext.operators import boxes as B
from pagetext.operators import merge as M
from pagetext.operators import order as O
from pagetext.operators import tiles as T
from pagetext.operators.graph import connected_components
from pagetext.operators.tiles import box_pairs

SCHEMA = "page long, block_id int, x1 int, y1 int, x2 int, y2 int, vertical boolean, label string, font_size int"


def make_pages(seed, hot=260):
    """Thirty small pages and one that holds most of the rows."""
    rnd = random.Random(seed)
    pages = {}
    for page in range(31):
        n = hot if page == 30 else rnd.randint(1, 14)
        tall = 6000 if page == 30 else 900
        rows = []
        for i in range(1, n + 1):
            x, y, w, h = rnd.randint(0, 500), rnd.randint(0, tall), rnd.randint(4, 160), rnd.randint(4, 160)
            rows.append((page, i, x, y, x + w, y + h, rnd.random() < 0.02, rnd.choice("ABN"), rnd.randint(8, 40)))
        pages[page] = rows
    return pages


def frame(spark, pages):
    return spark.createDataFrame([r for p in pages.values() for r in p], SCHEMA)


def inter(a, b):
    return max(0, min(a[4], b[4]) - max(a[2], b[2])) * max(0, min(a[5], b[5]) - max(a[3], b[3]))


def area(a):
    return (a[4] - a[2]) * (a[5] - a[3])


def iou(a, b):
    u = area(a) + area(b) - inter(a, b)
    return inter(a, b) / u if u > 0 else 0.0


@pytest.fixture(scope="module")
def pages():
    return make_pages(7)


@pytest.fixture(scope="module")
def df(spark, pages):
    return frame(spark, pages).cache()


def test_pairs_are_complete_and_unique(df, pages):
    got = [(r.page, r.block_id, r.r_block_id) for r in box_pairs(df, df, gap_x=30, gap_y=10).select("page", "block_id", "r_block_id").collect()]
    want = {(p, a[1], b[1]) for p, rows in pages.items() for a in rows for b in rows
            if b[2] <= a[4] + 30 and a[2] - 30 <= b[4] and b[3] <= a[5] + 10 and a[3] - 10 <= b[5]}
    assert len(got) == len(set(got)) and set(got) == want


def test_nearest_panel(df, pages):
    panels = df.filter("block_id % 9 = 1 and page <> 3").select("page", F.col("block_id").alias("panel_id"), "x1", "y1", "x2", "y2")
    got = {(r.page, r.block_id): r.panel_id for r in B.nearest_panel(df, panels).collect()}
    for p, rows in pages.items():
        for a in rows:
            best = None
            for b in rows:
                if b[1] % 9 == 1 and p != 3:
                    d = math.hypot(max(0, b[2] - a[4], a[2] - b[4]), max(0, b[3] - a[5], a[3] - b[5]))
                    best = min(best, (d, b[1])) if best else (d, b[1])
            assert got[p, a[1]] == (best[1] if best else None)


@pytest.mark.parametrize("few", [1, 3])
def test_pages_with_many_panels_are_searched_by_tiles(df, pages, monkeypatch, few):
    """Lists and tiles give the same panels, also side by side; pages above the bound keep none of their panels in a list."""
    panels = df.filter("block_id % 9 = 1 and page <> 3").select("page", F.col("block_id").alias("panel_id"), "x1", "y1", "x2", "y2")
    listed = {tuple(r) for r in B.nearest_panel(df, panels).select("page", "block_id", "panel_id", "distance").collect()}
    monkeypatch.setattr(B, "FEW", few)
    assert {tuple(r) for r in B.nearest_panel(df, panels).select("page", "block_id", "panel_id", "distance").collect()} == listed


def test_nearest_panel_moves_each_table_once(spark):
    """Blocks and panels of ordinary pages meet where they lie: no tiles, no ranges."""
    import __spark_entry__ as entry

    for name in ("j4_nearest_panel", "w4_panel_text_order"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning") <= 3 and "rangepartitioning" not in plan and "Generate explode" not in plan


def test_far_panel_is_found(spark):
    b = spark.createDataFrame([(1, 1, 0, 0, 10, 10, True, "A", 10)], SCHEMA)
    p = spark.createDataFrame([(1, 5, 90000, 90000, 90010, 90010), (1, 6, 80000, 90000, 80010, 90010)], "page long, panel_id int, x1 int, y1 int, x2 int, y2 int")
    assert B.nearest_panel(b, p).first().panel_id == 6


def test_boxes_of_all_sizes_pair_once_and_take_few_rows(spark):
    """Sides from 1 to two million, negative corners, gaps: every touching pair once; a huge box is a few rows."""
    rng = random.Random(12)
    rows = []
    for i in range(160):
        w, h = (int(10 ** rng.uniform(0, 6.3)) for _ in range(2))
        x, y = rng.randrange(-10 ** rng.randrange(1, 7), 10 ** 6), rng.randrange(-1000, 10 ** rng.randrange(1, 7))
        rows.append((i % 2, i, x, y, x + w, y + h))
    d = spark.createDataFrame(rows, "page long, block_id int, x1 int, y1 int, x2 int, y2 int").repartition(4)
    left, right = d.filter("block_id % 3 < 2"), d.filter("block_id % 3 > 0")
    got = [(r.block_id, r.r_block_id) for r in T.box_pairs(left, right, gap_x=F.col("block_id") * 10, gap_y=7).collect()]
    want = [(a[1], b[1]) for a in rows for b in rows if a[1] % 3 < 2 and b[1] % 3 > 0 and a[0] == b[0] and b[2] <= a[4] + a[1] * 10 and a[2] - a[1] * 10 <= b[4]
            and b[3] <= a[5] + 7 and a[3] - 7 <= b[5]]
    assert len(want) > 300 and sorted(got) == sorted(want)
    huge = spark.createDataFrame([(1, 1, 0, 0, 2_000_000, 2_000_000)], d.schema)
    none = F.lit(0)
    own = huge.withColumn("__own", T._level("", T.TILE_W, T.TILE_H, none, none))
    levels = own.agg(F.array(F.first("__own"), F.lit(T.LEVELS - 1)).alias("__levels"))
    assert T._tiles(own, levels, "", T.TILE_W, T.TILE_H, none, none).count() <= T.MOST + 4


def _sorted_regions(rows, rtl):
    placed = []
    for r in sorted(rows, key=lambda r: ((r[3] + r[5]) / 2, r[1])):
        cx, cy = (r[2] + r[4]) / 2, (r[3] + r[5]) / 2
        for i, s in enumerate(placed):
            if cy > s[5]:
                continue
            if cy < s[3]:
                placed.insert(i + 1, r)
                break
            if cx > (s[2] + s[4]) / 2 if rtl else cx < (s[2] + s[4]) / 2:
                placed.insert(i, r)
                break
        else:
            placed.append(r)
    return placed


def test_sort_regions(df, pages):
    got = {(r.page, r.block_id): r.position for r in O.sort_regions(df).collect()}
    for p, rows in pages.items():
        placed = _sorted_regions(rows, any(r[6] for r in rows))
        assert [got[p, r[1]] for r in placed] == list(range(1, len(rows) + 1))


def test_sort_regions_with_swapped_edges(df, pages):
    swapped = df.withColumns({"y1": F.when(F.col("block_id") % 2 == 0, F.col("y2")).otherwise(F.col("y1")), "y2": F.when(F.col("block_id") % 2 == 0, F.col("y1")).otherwise(F.col("y2"))})
    got = {(r.page, r.block_id): r.position for r in O.sort_regions(swapped, rtl=False).collect()}
    for p, rows in pages.items():
        turned = [r if r[1] % 2 else (*r[:3], r[5], r[4], r[3], *r[6:]) for r in rows]
        assert [got[p, r[1]] for r in _sorted_regions(turned, False)] == list(range(1, len(rows) + 1))


@pytest.mark.parametrize("by", ["area", "arrival"])
def test_remove_contained(df, pages, by):
    got = {(r.page, r.block_id) for r in M.remove_contained(df, 0.4, by=by).collect()}
    want = set()
    for p, rows in pages.items():
        kept = []
        for a in sorted(rows, key=lambda r: (-area(r), r[1])) if by == "area" else rows:
            hit = any(inter(a, k) / area(a) >= 0.4 for k in kept) if by == "area" else any(inter(a, k) / (area(a) + 1e-6) > 0.4 for k in kept)
            if not hit:
                kept.append(a)
        want |= {(p, k[1]) for k in kept}
    assert got == want


def test_greedy_detections(spark, df, pages):
    det = make_pages(7)
    rnd = random.Random(3)
    det = {p: [(r[0], r[1], r[2] + rnd.randint(-9, 9), r[3] + rnd.randint(-9, 9), r[4] + rnd.randint(0, 9), r[5] + rnd.randint(0, 9), *r[6:]) for r in rows] for p, rows in det.items()}
    pairs, _ = M.match_detections(df.withColumn("ignore", F.col("label") == "N"), frame(spark, det), min_iou=0.1)
    got = {(r.page, r.gt, r.det) for r in pairs.collect()}
    want = set()
    for p, rows in pages.items():
        skip = {d[1] for d in det[p] for g in rows if g[7] == "N" and area(d) > 0 and inter(g, d) / area(d) > 0.5}
        used = set()
        for g in rows:
            if g[7] == "N":
                continue
            for d in det[p]:
                if d[1] not in used and d[1] not in skip and iou(g, d) > 0.1:
                    used.add(d[1])
                    want.add((p, g[1], d[1]))
                    break
    assert got == want


def plain_stitch(boxes, dist, contain, dup, overlap):
    """The first box of the list takes in the next ones that touch it until none does, then comes the turn of the rest."""
    size = lambda b: (b[2] - b[0]) * (b[3] - b[1])

    def joined(a, b):
        w, h = max(0, min(a[2], b[2]) - max(a[0], b[0])), max(0, min(a[3], b[3]) - max(a[1], b[1]))
        less, more = sorted((size(a), size(b)))
        union = less + more - w * h
        if (less > 0 and w * h / less >= contain) or (union > 0 and w * h / union >= dup):
            return a if size(a) >= size(b) else b
        narrow = min(a[2] - a[0], b[2] - b[0])
        hull = (min(a[0], b[0]), min(a[1], b[1]), max(a[2], b[2]), max(a[3], b[3]))
        close = min(abs(a[1] - b[3]), abs(a[3] - b[1])) < dist and w / (narrow if narrow > 0 else 1) > overlap
        return hull if close and more > 0 and max(less, 0) / more > 0.3 and size(hull) <= 3 * more else None

    if not boxes:
        return []
    head, rest = boxes[0], boxes[1:]
    k = 0
    while k < len(rest) and rest[k][1] <= head[3] + 2 * dist:
        new = joined(head, rest[k])
        if new is None:
            k += 1
            continue
        inside = size(head) > 0 and size(rest[k]) > 0 and new == head and size(head) >= size(rest[k])
        w = max(0, min(head[2], rest[k][2]) - max(head[0], rest[k][0])) * max(0, min(head[3], rest[k][3]) - max(head[1], rest[k][1]))
        inside = inside and w / min(size(head), size(rest[k])) >= contain
        head = new
        del rest[k]
        k = k if inside else 0
    return [head, *plain_stitch(rest, dist, contain, dup, overlap)]


def test_stitch_slices(df, pages):
    """Islands folded one by one give what the rule gives on each whole page."""
    got = {}
    for r in M.stitch_slices(df.withColumn("start_y", F.col("block_id") % 3 * 40), 1500, 0.01, 0.85, 0.5, 0.1).collect():
        got.setdefault(r.page, []).append((r.x1, r.y1, r.x2, r.y2))
    for p, rows in pages.items():
        moved = sorted(rows, key=lambda r: (r[3] + r[1] % 3 * 40, r[1]))
        want = plain_stitch([(r[2], r[3] + r[1] % 3 * 40, r[4], r[5] + r[1] % 3 * 40) for r in moved], 15, 0.85, 0.5, 0.1)
        assert sorted(got[p]) == sorted(map(tuple, want))


def test_stitch_fold_on_random_islands():
    Row, rnd = namedtuple("Row", "page island x1 y1 x2 y2"), random.Random(3)
    for n in range(1, 300):
        boxes = []
        for _ in range(n % 60 + 1):
            x, y = rnd.randrange(60), rnd.randrange(rnd.choice([40, 400]))
            boxes.append((x, y, x + rnd.randrange(40), y + rnd.randrange(40)))
        boxes.sort(key=lambda b: b[1])
        rule = (rnd.choice([2, 9]), rnd.choice([0.6, 0.85]), rnd.choice([0.3, 0.5]), rnd.choice([0.0, 0.1]))
        got = M._stitcher(*rule)([Row(1, 1, *b) for b in boxes])
        assert [t[3:] for t in got] == plain_stitch(boxes, *rule)


def test_stitch_fold_on_a_large_island():
    """A column of many boxes, each of which reaches the next few only."""
    Row = namedtuple("Row", "page island x1 y1 x2 y2")
    rows = [Row(1, 1, 50 * (i % 40), i // 4, 50 * (i % 40) + 20, i // 4 + 30) for i in range(20000)]
    start = time.time()
    assert M._stitcher(15, 0.85, 0.5, 0.1)(rows)
    assert time.time() - start < 60


@pytest.mark.parametrize("second,want", [
    ((10, 10, 90, 90), [(0, 0, 100, 100)]),  # inside the first
    ((0, 0, 300, 300), [(0, 0, 300, 300)]),  # around the first
    ((10, 20, 110, 120), [(0, 0, 100, 100)]),  # the same box twice, equal size
    ((0, 105, 100, 180), [(0, 0, 100, 180)]),  # next below
    ((0, 105, 20, 110), [(0, 0, 100, 100), (0, 105, 20, 110)]),  # too small to join
    ((0, 140, 100, 240), [(0, 0, 100, 100), (0, 140, 100, 240)]),  # too far
])
def test_stitch_outcomes(spark, second, want):
    d = spark.createDataFrame([(1, 1, 0, 0, 100, 100, True, "A", 9), (1, 2, *second, True, "A", 9)], SCHEMA).withColumn("start_y", F.lit(0))
    assert sorted((r.x1, r.y1, r.x2, r.y2) for r in M.stitch_slices(d).collect()) == want


def test_merge_textlines(spark):
    """Three stacked lines are one region, a far line and a crossed line are not; an uneven gap splits."""
    rows = [(1, 1, 0, 0, 100, 20), (1, 2, 0, 24, 100, 44), (1, 3, 0, 48, 100, 68), (1, 4, 400, 400, 500, 420), (1, 5, 110, 0, 125, 200)]
    d = spark.createDataFrame([(*r, True, "A", 10) for r in rows], SCHEMA)
    got = {r.block_id: r.region for r in M.merge_textlines(d).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}


def test_components_long_chain(spark):
    rnd = random.Random(5)
    edges = [(0, i, i + 1) for i in range(1, 400)] + [(1, rnd.randint(1, 300), rnd.randint(1, 300)) for _ in range(200)] + [(2, 1, i) for i in range(2, 300)]
    got = {(r.page, r.node): r.component for r in connected_components(spark.createDataFrame(edges, "page int, a int, b int"), ["page"], "a", "b").collect()}
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for p, a, b in edges:
        if a != b:
            ra, rb = sorted((find((p, a)), find((p, b))))
            parent[rb] = ra
    assert got == {n: find(n)[1] for n in parent}


def test_duplicate_boxes(spark):
    d = spark.createDataFrame([(1, 1, 20, 20, 80, 80, True, "A", 9), (1, 2, 22, 18, 81, 79, True, "A", 9), (1, 3, 200, 0, 260, 90, True, "A", 9)], SCHEMA)
    got = sorted((r.x1, r.y1, r.x2, r.y2) for r in M.merge_duplicate_boxes(d, 0.7).collect())
    assert got == [(20, 18, 81, 80), (200, 0, 260, 90)]


@pytest.mark.parametrize("strategy,want", [("FIRST", "label"), ("COMBINE", "label+xx+b"), ("PREFER_NON_DEFAULT", "xx"), ("PREFER_SHORTER", "b")])
def test_label_strategies(spark, strategy, want):
    rows = [(1, 1, 0, 0, 10, 10, "label", "a"), (1, 2, 0, 12, 10, 20, "xx", "b"), (1, 3, 0, 22, 10, 30, "b", "c")]
    d = spark.createDataFrame(rows, "page long, block_id int, x1 int, y1 int, x2 int, y2 int, label string, text string")
    got = M.merge_boxes(d, "VERTICAL", max_vertical_gap=5, min_width_overlap_ratio=50, label_strategy=strategy, direction="TTB").collect()
    assert [(r.label, r.text, r.members) for r in got] == [(want, "abc", 3)]


def test_merge_with_overlap_epsilon(spark):
    """A positive epsilon merges thin boxes however far apart they lie on the overlap axis."""
    d = spark.createDataFrame([(1, 1, 0, 0, 1, 10, "A", "a"), (1, 2, 9000, 12, 9001, 20, "A", "b")], "page long, block_id int, x1 int, y1 int, x2 int, y2 int, label string, text string")
    assert M.merge_boxes(d, max_vertical_gap=5, min_width_overlap_ratio=50, overlap_epsilon=1.0).count() == 1
    assert M.merge_boxes(d, max_vertical_gap=5, min_width_overlap_ratio=50).count() == 2


def test_order_is_a_permutation_on_a_hot_page(df):
    m = B.match_boxes(df, df.withColumnRenamed("block_id", "cand_id"))
    bad = O.reading_order(m).groupBy("page").agg(F.sort_array(F.collect_list("position")).alias("p"), F.count("*").alias("n")).filter("p <> sequence(1, int(n))")
    assert bad.count() == 0


def test_short_and_large_pages_are_worked_alike(df, monkeypatch):
    """Joins by page and by tile, windows and ranges, folded and contracted components give the same rows, also side by side."""
    from pagetext.operators import graph, prefix

    def results():
        pairs = box_pairs(df, df, gap_x=F.col("font_size"), gap_y=10).filter("block_id < r_block_id").select("page", "block_id", "r_block_id")
        cand = df.withColumnRenamed("block_id", "cand_id")
        frames = [pairs, box_pairs(df, cand).select("page", "block_id", "r_cand_id"), connected_components(pairs, ["page"], "block_id", "r_block_id"), O.sort_regions(df), O.sort_regions(df, rtl=False),
                  O.reading_order(B.match_boxes(df, cand)).select("page", "block_id", "match_id", "position", "method"), M.merge_duplicate_boxes(df, 0.2)]
        return [sorted(map(tuple, d.collect())) for d in frames]

    want = None
    for few, whole, edges in ((10**6, 10**6, 10**6), (20, 20, 20), (0, 0, 0)):
        monkeypatch.setattr(T, "FEW", few)
        monkeypatch.setattr(T, "WHOLE", whole)
        monkeypatch.setattr(prefix, "WHOLE", whole)
        monkeypatch.setattr(graph, "FOLD_EDGES", edges)
        got = results()
        assert want is None or got == want
        want = got


def test_ordinary_pages_need_no_tiles_and_no_ranges(spark):
    import __spark_entry__ as entry

    for name in ("c1_order_pages", "w1_reading_order", "w2_sort_regions"):
        plan = entry.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
        assert not [x for x in ("Generate explode", "rangepartitioning", "ExistingRDD") if x in plan], (name, plan)
