"""Spatial pair joins inside a page.

Pages with few boxes are joined as they are: each box is held against at most ``FEW`` others, and no table has to move that lies by page already. On
larger pages pairs come from a join on (page, tile), never from all pairs of a page: boxes are listed under each tile they
touch, and a pair is reported only by the tile that holds the upper-left corner of the (grown) intersection, so
no duplicate has to be removed. A page with very many boxes is spread over its tiles. Boxes too large for their
tiles live on a coarser level, so a box of any size is a few rows; a pair meets on the coarser of its two levels.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetext.operators.prefix import WHOLE, keys_over

FEW = 64  # boxes of a key that each box of the other side is held against
TILE_W, TILE_H = 1024, 256


STEP, LEVELS = 8, 8  # each level's tiles are eight times wider and higher than the last one's
MOST = 16  # tiles a box may touch on its own level


def _span(p: str, lo: str, hi: str, g: Column, size: Column | int) -> tuple[Column, Column]:
    """First and last tile of a grown box along one axis."""
    a, b = F.floor((F.col(p + lo) - g) / size), F.floor((F.col(p + hi) + g) / size)
    return F.least(a, b), F.greatest(a, b)


def _level(p: str, tw: int, th: int, gx: Column, gy: Column) -> Column:
    """The finest level on which a grown box touches at most ``MOST`` tiles (the coarsest if none)."""
    out = F.lit(LEVELS - 1)
    for k in range(LEVELS - 2, -1, -1):
        (xa, xb), (ya, yb) = _span(p, "x1", "x2", gx, tw * STEP ** k), _span(p, "y1", "y2", gy, th * STEP ** k)
        out = F.when((xb - xa + 1) * (yb - ya + 1) <= MOST, k).otherwise(out)
    return out


def _tiles(df: DataFrame, levels: DataFrame, p: str, tw: int, th: int, gx: Column, gy: Column) -> DataFrame:
    """Each row under its tiles on its own level ``__own`` and on every coarser one that ``levels`` holds."""
    d = df.join(F.broadcast(levels)).withColumn("__level", F.explode(F.filter("__levels", lambda x: x >= F.col("__own")))).drop("__levels")
    scale = F.pow(F.lit(STEP), F.col("__level"))
    return (d.withColumn("__ty", F.explode(F.sequence(*_span(p, "y1", "y2", gy, th * scale))))
            .withColumn("__tx", F.explode(F.sequence(*_span(p, "x1", "x2", gx, tw * scale)))))


def prefixed(df: DataFrame, prefix: str, keep: Sequence[str] = ()) -> DataFrame:
    return df.select(*[F.col(c) if c in keep else F.col(c).alias(prefix + c) for c in df.columns])


def box_pairs(left: DataFrame, right: DataFrame, keys: Sequence[str] = ("page",), gap_x: float | Column = 0,
              gap_y: float | Column = 0, tile: tuple[int, int] = (TILE_W, TILE_H)) -> DataFrame:
    """All pairs whose boxes touch once the left box is grown by the gaps; right columns get ``r_``.

    Every pair appears exactly once. Gap columns may depend on the left row.
    """
    keys = list(keys)
    gx = gap_x if isinstance(gap_x, Column) else F.lit(gap_x)
    gy = gap_y if isinstance(gap_y, Column) else F.lit(gap_y)
    large = keys_over(right, keys, FEW)
    crowded = None if left is right else keys_over(left, keys, WHOLE)
    if crowded is not None:
        large = crowded if large is None else large.unionByName(crowded).distinct()
    if large is None:
        return _pairs_of_few(left, right, keys, gx, gy)
    large = F.broadcast(large)
    few, many = ([d.join(large, keys, how) for d in (left, right)] for how in ("left_anti", "left_semi"))
    return _pairs_of_few(*few, keys, gx, gy).unionByName(_pairs_by_tile(*many, keys, gx, gy, tile))


def _touching() -> Column:
    return ((F.col("r_x1") <= F.col("x2") + F.col("__gx")) & (F.col("x1") - F.col("__gx") <= F.col("r_x2"))
            & (F.col("r_y1") <= F.col("y2") + F.col("__gy")) & (F.col("y1") - F.col("__gy") <= F.col("r_y2")))


def _pairs_of_few(left: DataFrame, right: DataFrame, keys: list[str], gx: Column, gy: Column) -> DataFrame:
    pairs = left.withColumn("__gx", gx).withColumn("__gy", gy).join(prefixed(right, "r_", keys).hint("merge"), keys)
    return pairs.filter(_touching()).drop("__gx", "__gy")


def _pairs_by_tile(left: DataFrame, right: DataFrame, keys: list[str], gx: Column, gy: Column, tile: tuple[int, int]) -> DataFrame:
    tw, th = tile
    left = left.withColumn("__gx", gx).withColumn("__gy", gy)
    left = left.withColumn("__own", _level("", tw, th, F.col("__gx"), F.col("__gy")))
    right = prefixed(right, "r_", keys).withColumn("__own", _level("r_", tw, th, F.lit(0), F.lit(0)))
    # One row: the levels in use, nearly always only the finest.
    levels = left.select("__own").unionByName(right.select("__own")).agg(F.array_sort(F.collect_set("__own")).alias("__levels"))
    lt = _tiles(left, levels, "", tw, th, F.col("__gx"), F.col("__gy"))
    rt = _tiles(right, levels, "r_", tw, th, F.lit(0), F.lit(0)).withColumnRenamed("__own", "__r_own")
    scale = F.pow(F.lit(STEP), F.col("__level"))
    ox = F.greatest(F.col("x1") - F.col("__gx"), F.col("r_x1"))
    oy = F.greatest(F.col("y1") - F.col("__gy"), F.col("r_y1"))
    owner = (F.floor(ox / (tw * scale)) == F.col("__tx")) & (F.floor(oy / (th * scale)) == F.col("__ty"))
    return (lt.join(rt, [*keys, "__level", "__tx", "__ty"])
            .filter((F.col("__level") == F.greatest("__own", "__r_own")) & _touching() & owner)
            .drop("__tx", "__ty", "__gx", "__gy", "__level", "__own", "__r_own"))


def self_pairs(df: DataFrame, uid: str, keys: Sequence[str] = ("page",), gap_x: float | Column = 0,
               gap_y: float | Column = 0, tile: tuple[int, int] = (TILE_W, TILE_H)) -> DataFrame:
    """Unordered pairs of one table (``uid < r_uid``) that touch once grown by the gaps."""
    return box_pairs(df, df, keys, gap_x, gap_y, tile).filter(F.col(uid) < F.col("r_" + uid))
