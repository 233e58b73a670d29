"""Merging and pruning of boxes: pair rules, components, hulls, stitching, detection evaluation."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from itertools import chain

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.functions import geometry as g
from pagetext.operators.folds import fold_groups
from pagetext.operators.graph import greedy_dropped, greedy_one_to_one, label_components
from pagetext.operators.prefix import per_key, prefix_scan
from pagetext.operators.tiles import TILE_H, TILE_W, box_pairs, self_pairs
from pagetext.session import cut_lineage


def _label_rule(exclude: Sequence[str], same: bool, groups: Sequence[Sequence[str]] | None) -> Column:
    a, b = F.col("label"), F.col("r_label")
    rule = F.lit(True)
    if exclude:
        rule = ~a.isin(list(exclude)) & ~b.isin(list(exclude))
    if groups is not None:
        def index(c: Column) -> Column:
            expr = F.lit(-1)
            for i in reversed(range(len(groups))):
                expr = F.when(c.isin(list(groups[i])), i).otherwise(expr)
            return expr
        return rule & (index(a) != -1) & (index(a) == index(b))
    return rule & (a == b) if same else rule


def _direction_rule(vertical: bool, min_overlap: float, max_gap: float, eps: float, allow_negative: bool) -> Column:
    lo, hi = ("x1", "x2") if vertical else ("y1", "y2")
    glo, ghi = ("y1", "y2") if vertical else ("x1", "x2")
    over = F.greatest(F.lit(0.0), F.least(F.col(hi), F.col("r_" + hi)) - F.greatest(F.col(lo), F.col("r_" + lo)))
    size = lambda p: F.greatest(F.lit(0.0), F.col(p + hi) - F.col(p + lo))
    ratio = F.greatest(F.lit(0.0), over + eps) / F.greatest(F.lit(1e-6), F.least(size(""), size("r_"))) * 100.0
    gap = F.greatest(F.col(glo), F.col("r_" + glo)) - F.least(F.col(ghi), F.col("r_" + ghi))
    rule = (ratio >= min_overlap) & (gap <= max_gap)
    return rule if allow_negative else rule & (gap >= 0)


def _fold_label(strategy: str) -> Column:
    """Label of a component from its members in id order."""
    first = F.min_by("label", "block_id")
    if strategy == "PREFER_NON_DEFAULT":
        return F.coalesce(F.min_by(F.when(~F.col("label").isin("label", ""), F.col("label")),
                                   F.when(~F.col("label").isin("label", ""), F.col("block_id"))), first)
    if strategy == "PREFER_SHORTER":
        return F.min_by("label", F.struct(F.length("label"), F.col("block_id")))
    if strategy == "COMBINE":
        ordered = F.transform(F.array_sort(F.collect_list(F.struct("block_id", "label"))), lambda s: s["label"])
        return F.aggregate(ordered, F.lit(None).cast("string"), lambda acc, x: F.when(acc.isNull() | (acc == x), x)
                           .otherwise(F.concat(acc, F.lit("+"), x)))
    return first


def _merge_pass(df: DataFrame, vertical: bool, p: Mapping) -> DataFrame:
    max_gap = p["max_vertical_gap" if vertical else "max_horizontal_gap"]
    min_overlap = p["min_width_overlap_ratio" if vertical else "min_height_overlap_ratio"]
    reach = max(0.0, float(max_gap))
    if min_overlap <= 0:
        raise ValueError("the minimum overlap ratio must be positive")
    eps = float(p.get("overlap_epsilon", 0.0))
    # A positive epsilon lets thin boxes merge however far apart they are on the overlap axis.
    lo, hi = ("x1", "x2") if vertical else ("y1", "y2")
    ends = df.agg(F.min(F.least(lo, hi)), F.max(F.greatest(lo, hi))).first() if eps > 0 else (0, 0)
    far = float(ends[1] - ends[0] + 1) if eps > 0 and ends[0] is not None else 0.0
    gx, gy = (far, reach) if vertical else (reach, far)
    wide = int(2 * far) + 2
    tile = (TILE_W, TILE_H) if eps <= 0 else ((wide, TILE_H) if vertical else (TILE_W, wide))
    rule = _direction_rule(vertical, min_overlap, max_gap, eps, p.get("allow_negative_gap", True))
    rule = rule & _label_rule(p.get("exclude", ()), p.get("require_same_label", False), p.get("groups"))
    pairs = self_pairs(df, "block_id", gap_x=gx, gap_y=gy, tile=tile).filter(rule).select("page", "block_id", "r_block_id")
    d = label_components(df, pairs, ["page"], "block_id")
    direction = p.get("direction", "LTR")
    rank = {"RTL": -F.col("x1"), "TTB": F.col("y1")}.get(direction, F.col("x1"))
    return (d.groupBy("page", "component").agg(
        _fold_label(p.get("label_strategy", "FIRST")).alias("label"),
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), F.col("block_id"), F.trim("text").alias("t")))),
                                 lambda s: s["t"]), "").alias("text"),
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.sum("members").alias("members")).withColumnRenamed("component", "block_id"))


def merge_boxes(df: DataFrame, mode: str = "VERTICAL", **params) -> DataFrame:
    """Merge boxes that line up; ``mode`` VERTICAL, HORIZONTAL or one THEN the other.

    Input: page, block_id, label, text, box. Output: one row per region with the smallest member id, the label by
    strategy, the texts joined in reading direction, the hull and the number of members.
    """
    d = df.select("page", "block_id", "label", "text", *g.BOX).withColumn("members", F.lit(1).cast("long"))
    for k, step in enumerate(mode.split("_THEN_")):
        # a second pass asks for the regions of the first several times
        d = _merge_pass(cut_lineage(d) if k else d, step == "VERTICAL", params)
    return d


def merge_duplicate_boxes(df: DataFrame, iou: float, key: Sequence[str] = ("page",)) -> DataFrame:
    """Hull of every group of boxes linked by IoU at or above the threshold."""
    key = list(key)
    pairs = self_pairs(df, "block_id", key).filter(g.plain_iou() >= iou).select(*key, "block_id", "r_block_id")
    d = label_components(df, pairs, key, "block_id")
    return d.groupBy(*key, F.col("component").alias("block_id")).agg(
        F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"),
        F.count(F.lit(1)).alias("members"))


def remove_contained(df: DataFrame, threshold: float, by: str = "area", key: Sequence[str] = ("page",)) -> DataFrame:
    """Drop boxes covered by a kept box, largest first (``by='area'``) or in arrival order (``by='arrival'``)."""
    key = list(key)
    src = df.filter(g.raw_area() > 0) if by == "area" else df
    pairs = self_pairs(src, "block_id", key)
    inter, a, ra = g.inter_area(), g.raw_area(), g.raw_area("r_")
    first = (a >= ra) if by == "area" else F.lit(True)  # the left box has the smaller id and so wins ties
    win = F.when(first, F.col("block_id")).otherwise(F.col("r_block_id"))
    lose = F.when(first, F.col("r_block_id")).otherwise(F.col("block_id"))
    own = F.when(first, ra).otherwise(a)
    covers = inter / own >= threshold if by == "area" else inter / (own + 1e-6) > threshold
    edges = pairs.filter(covers).select(*key, win.alias("win"), lose.alias("lose"))
    gone = greedy_dropped(edges, key).withColumnRenamed("n", "block_id")
    return src.join(gone, [*key, "block_id"], "left_anti")


def remove_fully_contained(df: DataFrame, key: Sequence[str] = ("page",)) -> DataFrame:
    """Drop boxes that lie inside another, different box; equal boxes all stay."""
    key = list(key)
    same = (F.col("x1") == F.col("r_x1")) & (F.col("y1") == F.col("r_y1")) & (F.col("x2") == F.col("r_x2")) & (F.col("y2") == F.col("r_y2"))
    pairs = box_pairs(df, df, key).filter(
        (F.col("block_id") != F.col("r_block_id")) & g.contains("r_", "") & ~same)
    return df.join(pairs.select(*key, "block_id").distinct(), [*key, "block_id"], "left_anti")


NOTHING, INNER, LARGER, HULL = range(4)
ONE_BY_ONE = 16  # boxes of an island that are weighed one by one


def _meetings(base: np.ndarray, others: np.ndarray, dist: float, contain: float, dup: float, overlap: float) -> np.ndarray:
    """What each of ``others`` means to ``base``: nothing, it is inside and goes, the larger of both stays, or their hull does."""
    low, high = np.maximum(base[:2], others[:, :2]), np.minimum(base[2:], others[:, 2:])
    wide, tall = np.maximum(0, high - low).T
    sides, own = others[:, 2:] - others[:, :2], base[2:] - base[:2]
    area, mine, both = sides[:, 0] * sides[:, 1], own[0] * own[1], wide * tall
    with np.errstate(divide="ignore", invalid="ignore"):
        contained = (mine > 0) & (area > 0) & (both / np.minimum(mine, area) >= contain)
        same = (mine + area - both > 0) & (both / (mine + area - both) >= dup)
        narrow = np.minimum(own[0], sides[:, 0])
        share = wide / np.where(narrow > 0, narrow, 1.0)
        big = np.maximum(0, np.maximum(mine, area))
        alike = (big > 0) & (np.maximum(0, np.minimum(mine, area)) / big > 0.3)
    near = np.minimum(np.abs(base[1] - others[:, 3]), np.abs(base[3] - others[:, 1])) < dist
    grown = np.prod(np.maximum(base[2:], others[:, 2:]) - np.minimum(base[:2], others[:, :2]), axis=1)
    hull = near & (share > overlap) & alike & (grown <= 3 * big)
    return np.select([contained & (mine >= area), contained | same, hull], [INNER, LARGER, HULL], NOTHING)


def _meeting(base: Sequence[float], other: Sequence[float], dist: float, contain: float, dup: float, overlap: float) -> int:
    """``_meetings`` of one box, for short islands."""
    (a, b, c, d), (x, y, z, t) = base, other
    area, mine = (z - x) * (t - y), (c - a) * (d - b)
    wide = max(0.0, min(c, z) - max(a, x))
    both = wide * max(0.0, min(d, t) - max(b, y))
    small, union, big = min(mine, area), mine + area - both, max(mine, area)
    contained = mine > 0 and area > 0 and both / small >= contain
    if contained and mine >= area:
        return INNER
    if contained or (union > 0 and both / union >= dup):
        return LARGER
    narrow = min(c - a, z - x)
    alike = big > 0 and max(0.0, small) / big > 0.3
    near = min(abs(b - t), abs(d - y)) < dist and wide / (narrow if narrow > 0 else 1.0) > overlap
    return HULL if near and alike and (max(c, z) - min(a, x)) * (max(d, t) - min(b, y)) <= 3 * big else NOTHING


def _stitched_one_by_one(boxes: list[tuple], *rule: float) -> list[tuple]:
    """The sweep of ``_stitcher`` over a few boxes, which a call of numpy for each would only slow down."""
    standing, kept = [True] * len(boxes), []
    for first, base in enumerate(boxes):
        if not standing[first]:
            continue
        at = first + 1
        while at < len(boxes) and boxes[at][1] <= base[3] + 2 * rule[0]:
            other, at = boxes[at], at + 1
            if not (standing[at - 1] and other[0] < base[2] and other[2] > base[0]):
                continue
            means = _meeting(base, other, *rule)
            standing[at - 1] = means == NOTHING
            if means == HULL:
                base, at = (min(base[0], other[0]), min(base[1], other[1]), max(base[2], other[2]), max(base[3], other[3])), first + 1
            elif means == LARGER:
                base = other if (other[2] - other[0]) * (other[3] - other[1]) > (base[2] - base[0]) * (base[3] - base[1]) else base
                at = first + 1
        kept.append(base)
    return kept


def _stitcher(dist: float, contain: float, dup: float, overlap: float):
    """Sweep over the boxes of an island by their top edge; each box meets those still standing that begin before its reach ends.

    Those it meets are weighed together, some at first and then twice as many, up to the first that changes the box. The box then starts anew.
    """
    def fold(rows: list) -> list[tuple]:
        page, island = rows[0].page, rows[0].island
        listed = [(float(r.x1), float(r.y1), float(r.x2), float(r.y2)) for r in rows]
        if len(rows) <= ONE_BY_ONE and not any(map(math.isnan, chain.from_iterable(listed))):
            return [(page, island, k, *b) for k, b in enumerate(_stitched_one_by_one(listed, dist, contain, dup, overlap), 1)]
        boxes = np.array(listed, float)
        left, tops, right = (np.ascontiguousarray(boxes[:, k]) for k in range(3))
        standing, kept = np.ones(len(boxes), bool), []
        for first in range(len(boxes)):
            if not standing[first]:
                continue
            base, at, width = boxes[first], first + 1, 16
            while at < (end := int(np.searchsorted(tops, base[3] + 2 * dist, side="right"))):
                upto = min(at + width, end)
                met = at + np.flatnonzero(standing[at:upto] & (left[at:upto] < base[2]) & (right[at:upto] > base[0]))  # the others mean nothing
                at, width = upto, 2 * width
                if not len(met):
                    continue
                means = _meetings(base, boxes[met], dist, contain, dup, overlap)
                change = np.flatnonzero(means >= LARGER)
                k = int(change[0]) if len(change) else len(met)
                standing[met[:k][means[:k] == INNER]] = False
                if k == len(met):
                    continue
                other = boxes[met[k]]
                standing[met[k]] = False
                if means[k] == HULL:
                    base = np.concatenate([np.minimum(base[:2], other[:2]), np.maximum(base[2:], other[2:])])
                elif np.prod(other[2:] - other[:2]) > np.prod(base[2:] - base[:2]):
                    base = other
                at, width = first + 1, 16
            kept.append(base.tolist())
        return [(page, island, k, *b) for k, b in enumerate(kept, 1)]

    return fold


def stitch_slices(df: DataFrame, page_h: float = 1500, y_ratio: float = 0.01, contain: float = 0.85, duplicate: float = 0.5,
                  overlap: float = 0.1) -> DataFrame:
    """Merge boxes found in overlapping slices of a long page. Input: page, block_id, slice box, ``start_y``.

    Slice boxes are shifted to page coordinates, then folded top-down. A box starting more than twice the merge
    distance below everything before it opens an island the fold cannot cross, so islands run independently.
    """
    dist = y_ratio * page_h
    d = df.withColumns({"y1": F.col("y1") + F.col("start_y"), "y2": F.col("y2") + F.col("start_y")})
    order = [F.col("y1"), F.col("block_id")]
    d = prefix_scan(d, ["page"], order, maxes_before={"__b": F.col("y2")})
    new = F.when(F.col("__b").isNull() | (F.col("y1") > F.col("__b") + 2 * dist), 1).otherwise(0)
    d = prefix_scan(d, ["page"], order, sums={"island": new})
    # an island is folded in one task, so it is counted there too, without a join
    d = d.select("page", "block_id", "island", *g.BOX, F.count(F.lit(1)).over(Window.partitionBy("page", "island")).alias("n"))
    schema = "page long, island long, part int, x1 double, y1 double, x2 double, y2 double"
    many = fold_groups(d.filter("n > 1"), ["page", "island"], ["y1", "block_id"], _stitcher(dist, contain, duplicate, overlap), schema)
    return many.unionByName(d.filter("n = 1").select("page", "island", F.lit(1).alias("part"),
                                                     *[F.col(c).cast("double").alias(c) for c in g.BOX]))


def match_detections(truth: DataFrame, found: DataFrame, min_iou: float = 0.5, min_cover: float = 0.5) -> tuple[DataFrame, DataFrame]:
    """Greedy one-to-one matches and the detections covered by "don't care" truth: (pairs, ignored)."""
    pairs = box_pairs(truth.withColumnRenamed("block_id", "gt"), found.withColumnRenamed("block_id", "det"))
    pairs = pairs.filter(g.inter_area() > 0)
    ignored = (pairs.filter(F.col("ignore") & (g.raw_area("r_") > 0) & (g.inter_area() / g.raw_area("r_") > min_cover))
               .select("page", F.col("r_det").alias("det")).distinct())
    cand = (pairs.filter(~F.col("ignore") & (g.plain_iou() > min_iou)).select("page", "gt", F.col("r_det").alias("det"))
            .join(ignored, ["page", "det"], "left_anti"))
    return greedy_one_to_one(cand, ["page"], "gt", "det"), ignored


def _region_splitter(rows: list) -> list[tuple]:
    """Split one region at its longest tree edge while the gaps deviate too much (axis-aligned lines)."""
    page, region = rows[0].page, rows[0].component
    size = [min(r.x2 - r.x1, r.y2 - r.y1) for r in rows]

    def apart(i: int, j: int) -> float:
        a, b = rows[i], rows[j]
        fs = max(size[i], size[j])
        mean_w = ((a.x2 - a.x1) + (b.x2 - b.x1)) / 2
        top, bottom = abs(a.y1 - b.y1) * mean_w / fs, abs(a.y2 - b.y2) * mean_w / fs
        if bottom < fs * 0.5 and bottom < top:
            return math.hypot(a.x2 - b.x2, a.y2 - b.y2)
        return math.hypot(a.x1 - b.x1, a.y1 - b.y1)

    def tree(nodes: list[int]) -> list[tuple[float, int, int]]:
        """Smallest spanning tree in quadratic time and linear memory."""
        best = {n: (apart(nodes[0], n), *sorted((nodes[0], n))) for n in nodes[1:]}
        edges = []
        while best:
            n = min(best, key=best.get)
            edges.append(best.pop(n))
            for m in best:
                best[m] = min(best[m], (apart(n, m), *sorted((n, m))))
        return edges

    def together(nodes: list[int], edges: list[tuple[float, int, int]]) -> bool:
        gaps = sorted((e[0] for e in edges), reverse=True)
        mean = sum(gaps) / len(gaps)
        std = math.sqrt(sum((x - mean) ** 2 for x in gaps) / len(gaps))
        font = sum(size[n] for n in nodes) / len(nodes)
        _, u, v = min(edges, key=lambda e: (-e[0], e[1], e[2]))
        a, b = rows[u], rows[v]
        touching = max(a.x1, b.x1) <= min(a.x2, b.x2) and max(a.y1, b.y1) <= min(a.y2, b.y2)
        shift = min(abs(a.x1 + a.x2 - b.x1 - b.x2), abs(a.y1 + a.y2 - b.y1 - b.y2)) / 2
        even = gaps[0] <= mean + 2 * std or gaps[0] <= 1.5 * font
        return even and (std < max(0.3 * font + 5, 5) or (touching and shift < 5))

    done, todo = [], [list(range(len(rows)))]
    while todo:
        nodes = todo.pop()
        if len(nodes) == 1:
            done.append(nodes)
        elif len(nodes) == 2:
            close = apart(*nodes) < 1.5 * max(size[nodes[0]], size[nodes[1]])
            done.extend([nodes] if close else [[n] for n in nodes])
        else:
            edges = tree(nodes)
            if together(nodes, edges):
                done.append(nodes)
                continue
            cut = min(edges, key=lambda e: (-e[0], e[1], e[2]))
            near = {n: [] for n in nodes}
            for e in edges:
                if e is not cut:
                    near[e[1]].append(e[2])
                    near[e[2]].append(e[1])
            side, stack = {cut[1]}, [cut[1]]
            while stack:
                for m in near[stack.pop()]:
                    if m not in side:
                        side.add(m)
                        stack.append(m)
            todo += [[n for n in nodes if n in side], [n for n in nodes if n not in side]]
    return [(page, rows[n].block_id, region, min(rows[m].block_id for m in part)) for part in done for n in part]


def textline_pairs(df: DataFrame) -> DataFrame:
    """Line pairs that belong to one region (axis-aligned): near, similar size, compatible shape, aligned edges."""
    d = df.withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    d = d.filter((F.col("w") > 0) & (F.col("h") > 0)).withColumns({"fs": F.least("w", "h"), "asp": F.col("w") / F.col("h")})
    p = self_pairs(d.select("page", "block_id", *g.BOX, "w", "h", "fs", "asp"), "block_id", gap_x=F.col("fs"), gap_y=F.col("fs"))
    c = F.col
    char = F.least("fs", "r_fs")
    lim = char * 3
    sideways = (c("w") > c("h") * 1.9) | (c("r_w") > c("r_h") * 1.9)
    upright = (c("h") > c("w") * 1.9) | (c("r_h") > c("r_w") * 1.9)
    crossed = ((c("w") > c("h") * 1.9) & (c("r_h") > c("r_w") * 1.9)) | ((c("r_w") > c("r_h") * 1.9) & (c("h") > c("w") * 1.9))
    centred = F.abs(c("x1") + F.floor(c("w") / 2) - c("r_x1") - F.floor(c("r_w") / 2)) < 3
    aligned = (F.when(crossed, False)
               .when(sideways, (F.abs(c("x1") - c("r_x1")) < lim) | (F.abs(c("x2") - c("r_x2")) < lim))
               .when(upright, (F.abs(c("y1") - c("r_y1")) < lim) | (F.abs(c("y2") - c("r_y2")) < lim)).otherwise(False))
    shapes = ~((c("asp") > 1.3) & (c("r_asp") < 1 / 1.3)) & ~((c("r_asp") > 1.3) & (c("asp") < 1 / 1.3))
    return (p.filter((g.rect_distance() < char) & (F.greatest("fs", "r_fs") / char <= 2) & shapes & (centred | aligned))
            .select("page", "block_id", "r_block_id"))


def merge_textlines(df: DataFrame) -> DataFrame:
    """Region of every line: components of the pair rule, split where the gaps deviate too much.

    The split runs per component, a set of lines each within one letter size of the next, never per page.
    Lines are axis-aligned boxes, so angles are not compared.
    """
    d = label_components(df.filter(g.raw_area() > 0), textline_pairs(df), ["page"], "block_id")
    d = per_key(d.select("page", "block_id", "component", *g.BOX), ["page", "component"], F.count(F.lit(1)).alias("n"))
    schema = "page long, block_id int, component int, region int"
    many = fold_groups(d.filter("n > 1"), ["page", "component"], ["block_id"], _region_splitter, schema)
    return many.unionByName(d.filter("n = 1").select("page", "block_id", "component", F.col("block_id").alias("region")))
