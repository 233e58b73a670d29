"""Region and page aggregates over lines."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetext.functions import geometry as g
from pagetext.operators.prefix import per_key, prefix_scan


def vote_direction(lines: DataFrame, key: Sequence[str], line_id: str = "block_id") -> DataFrame:
    """Majority direction; a tie goes to the line with the most extreme aspect. Also the simple half rule."""
    aspect = (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1"))
    extreme = F.greatest(aspect, 1 / aspect)
    d = lines.filter(g.raw_area() > 0).groupBy(*key).agg(
        F.count(F.lit(1)).alias("n"), F.count_if("vertical").alias("nv"),
        F.max_by("vertical", F.struct(extreme, -F.col(line_id))).alias("__tie"))
    return (d.withColumn("majority", F.when(F.col("nv") * 2 == F.col("n"), F.col("__tie")).otherwise(F.col("nv") * 2 > F.col("n")))
            .withColumn("simple", F.col("nv") >= F.floor(F.col("n") / 2)).drop("__tie"))


def mean_colour(lines: DataFrame, key: Sequence[str], channels: Sequence[str]) -> DataFrame:
    return lines.groupBy(*key).agg(*[F.bround(F.avg(c), 0).cast("int").alias(c) for c in channels])


def region_confidence(lines: DataFrame, region: Sequence[str], page: Sequence[str] = ("page",)) -> DataFrame:
    """Area-weighted log confidence over the page's area, smallest font, mean angle (snapped to 0 below 3 degrees)."""
    d = lines.groupBy(*region).agg(F.sum(F.log("prob") * g.area()).alias("s"), F.sum(g.area()).alias("area"),
                                   F.min("font_size").alias("font_size"), (F.degrees(F.avg("angle")) - 90).alias("deg"))
    total = d.groupBy(*page).agg(F.sum("area").alias("total"))
    return d.join(total, list(page)).select(
        *region, (F.col("s") / F.col("total")).alias("log_confidence"), "font_size",
        F.when(F.abs("deg") < 3, 0.0).otherwise(F.col("deg")).alias("angle"))


def detection_scores(per_page: DataFrame) -> DataFrame:
    """Precision, recall and their harmonic mean per page and pooled (``page`` null). Input: matched, n_gt, n_det."""
    m, gt, det = F.col("matched"), F.col("n_gt"), F.col("n_det")
    pooled = F.col("page").isNull()
    d = per_page.rollup("page").agg(F.sum("matched").alias("matched"), F.sum("n_gt").alias("n_gt"), F.sum("n_det").alias("n_det"))
    recall = F.when(gt > 0, m / gt).otherwise(F.when(pooled, 0.0).otherwise(1.0))
    precision = (F.when(det > 0, F.when((gt == 0) & ~pooled, 0.0).otherwise(m / det))
                 .otherwise(F.when((gt == 0) & ~pooled, 1.0).otherwise(0.0)))
    d = d.withColumns({"recall": recall, "precision": precision})
    both = F.col("precision") + F.col("recall")
    return d.withColumn("hmean", F.when(both > 0, 2 * F.col("precision") * F.col("recall") / both).otherwise(0.0))


def line_scale(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    return lines.groupBy(*key).agg(F.median(F.least(g.width(), g.height())).cast("double").alias("scale"))


def block_hull(lines: DataFrame, key: Sequence[str], blocks: DataFrame | None = None,
               x_range: tuple[int, int] | None = None, y_range: tuple[int, int] | None = None) -> DataFrame:
    """Hull of the lines of each block, united with the old box if ``blocks`` is given, clipped to the ranges."""
    src = lines.select(*key, *g.BOX, F.lit(True).alias("__line"))
    if blocks is not None:  # an old box meets its lines where they are gathered, so that neither table is asked for twice
        src = src.unionByName(blocks.dropna(subset=list(key)).select(*key, *g.BOX, F.lit(False).alias("__line")))
    d = src.groupBy(*key).agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max("__line").alias("__line"))
    d = d.filter("__line").drop("__line")
    for rng, cols in ((x_range, ("x1", "x2")), (y_range, ("y1", "y2"))):
        if rng:
            d = d.withColumns({c: F.greatest(F.lit(rng[0]), F.least(F.lit(rng[1]), F.col(c))) for c in cols})
    return d


def vote_alignment(lines: DataFrame, key: Sequence[str]) -> DataFrame:
    """Left or right only where its spread is strictly the smallest, else centre; spreads compared to 1e-9."""
    d = lines.groupBy(*key).agg(
        F.round(F.stddev_pop("x1"), 9).alias("l"), F.round(F.stddev_pop("x2"), 9).alias("r"),
        F.round(F.stddev_pop((F.col("x1") + F.col("x2")) / 2) * 0.7, 9).alias("c"))
    return d.select(*key, F.when((F.col("l") < F.col("r")) & (F.col("l") < F.col("c")), "left")
                    .when((F.col("r") < F.col("l")) & (F.col("r") < F.col("c")), "right").otherwise("center").alias("alignment"))


def line_stats(lines: DataFrame, key: Sequence[str], page_w: float = 1050) -> tuple[DataFrame, DataFrame]:
    """Per block font size and angle, per line the distance from the page origin and its rank.

    Lines are quadrilaterals ``px0,py0 .. px3,py3`` from the top-left corner clockwise, with ``vertical`` of the
    block. Vertical blocks measure from the right page edge.
    """
    key = list(key)
    c = F.col
    vx, vy = (c("px2") + c("px3") - c("px0") - c("px1")) / 2, (c("py2") + c("py3") - c("py0") - c("py1")) / 2
    hx, hy = (c("px1") + c("px2") - c("px0") - c("px3")) / 2, (c("py1") + c("py2") - c("py0") - c("py3")) / 2
    s = lines.groupBy(*key).agg(F.sum(vx).alias("vx"), F.sum(vy).alias("vy"), F.sum(hx).alias("hx"), F.sum(hy).alias("hy"),
                                F.count(F.lit(1)).alias("n"), F.max("vertical").alias("vertical"))
    norm = lambda a, b: F.sqrt(c(a) * c(a) + c(b) * c(b))
    px, py = F.when(c("vertical"), c("vx")).otherwise(c("hx")), F.when(c("vertical"), c("vy")).otherwise(c("hy"))
    other = F.when(c("vertical"), norm("hx", "hy")).otherwise(norm("vx", "vy"))
    deg = F.degrees(F.atan2(py, px)).cast("int") - F.when(c("vertical"), 90).otherwise(0)
    blocks = s.select(*key, "vertical", "n", px.alias("ux"), py.alias("uy"), F.bround(other / c("n"), 0).cast("int").alias("font_size"),
                      F.when(F.abs(deg) < 3, 0).otherwise(deg).alias("angle"))
    mx = (c("px0") + c("px2")) / 2 - F.when(blocks["vertical"], F.lit(page_w)).otherwise(0.0)
    my = (c("py0") + c("py2")) / 2
    ranked = lines.drop("vertical").join(blocks, key).withColumn(
        "distance", F.round(F.abs(mx * c("uy") - my * c("ux")) / F.sqrt(c("ux") * c("ux") + c("uy") * c("uy")), 6))
    ranked = prefix_scan(ranked, key, [c("distance"), c("line_id")], number="rank")
    return blocks.drop("ux", "uy"), ranked.select(*key, "line_id", "distance", "rank")
