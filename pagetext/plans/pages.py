"""Page-level plans."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetext.operators.boxes import match_boxes
from pagetext.operators.order import reading_order


def order_pages(blocks: DataFrame, candidates: DataFrame) -> DataFrame:
    """Blocks and order-model candidates to reading order: match, then order with the whole-page fallback."""
    out = reading_order(match_boxes(blocks, candidates))
    return out.select("page", "block_id", "match_id", F.round("coverage", 6).alias("coverage"),
                      F.round("iou", 6).alias("iou"), "position", "method")
