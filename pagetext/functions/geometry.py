"""Box arithmetic as column expressions. A box is the four columns ``<p>x1, <p>y1, <p>x2, <p>y2``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BOX = ("x1", "y1", "x2", "y2")


def cols(p: str = "") -> tuple[Column, Column, Column, Column]:
    return tuple(F.col(p + c) for c in BOX)


def width(p: str = "") -> Column:
    return F.greatest(F.lit(0), F.col(p + "x2") - F.col(p + "x1"))


def height(p: str = "") -> Column:
    return F.greatest(F.lit(0), F.col(p + "y2") - F.col(p + "y1"))


def area(p: str = "") -> Column:
    return width(p) * height(p)


def raw_area(p: str = "") -> Column:
    return (F.col(p + "x2") - F.col(p + "x1")) * (F.col(p + "y2") - F.col(p + "y1"))


def inter_area(a: str = "", b: str = "r_") -> Column:
    w = F.least(F.col(a + "x2"), F.col(b + "x2")) - F.greatest(F.col(a + "x1"), F.col(b + "x1"))
    h = F.least(F.col(a + "y2"), F.col(b + "y2")) - F.greatest(F.col(a + "y1"), F.col(b + "y1"))
    return F.greatest(F.lit(0), w) * F.greatest(F.lit(0), h)


def contains(outer: str, inner: str) -> Column:
    return ((F.col(outer + "x1") <= F.col(inner + "x1")) & (F.col(outer + "y1") <= F.col(inner + "y1"))
            & (F.col(outer + "x2") >= F.col(inner + "x2")) & (F.col(outer + "y2") >= F.col(inner + "y2")))


def plain_iou(a: str = "", b: str = "r_") -> Column:
    """Intersection over union; 0 where the union is not positive."""
    union = raw_area(a) + raw_area(b) - inter_area(a, b)
    return F.when(union > 0, inter_area(a, b) / union).otherwise(F.lit(0.0))


def x_gap(a: str = "", b: str = "r_") -> Column:
    return F.greatest(F.lit(0), F.col(b + "x1") - F.col(a + "x2"), F.col(a + "x1") - F.col(b + "x2"))


def y_gap(a: str = "", b: str = "r_") -> Column:
    return F.greatest(F.lit(0), F.col(b + "y1") - F.col(a + "y2"), F.col(a + "y1") - F.col(b + "y2"))


def rect_distance(a: str = "", b: str = "r_") -> Column:
    dx, dy = x_gap(a, b).cast("double"), y_gap(a, b).cast("double")
    return F.sqrt(dx * dx + dy * dy)
