"""Orders inside a page: reading order, panel rows, text in panels, region sort, line islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.operators.boxes import nearest_panel
from pagetext.operators.folds import fold_groups
from pagetext.operators.prefix import by_size, per_key, prefix_scan, previous_row
from pagetext.session import cut_lineage

def reading_order(matched: DataFrame) -> DataFrame:
    """Model order where every block of the page matched, native order for the whole page otherwise."""
    found = F.bool_and(F.col("match_id").isNotNull())
    d = by_size(matched, ["page"], lambda m: m.withColumn("full", found.over(Window.partitionBy("page"))), lambda m: per_key(cut_lineage(m), ["page"], found.alias("full")).select(*m.columns, "full"))
    lead = F.when(F.col("full"), F.col("match_id"))
    order = [lead, F.when(F.col("full"), -F.col("x2")), F.when(F.col("full"), F.col("y1")), F.col("block_id")]
    out = prefix_scan(d, ["page"], order, number="position")
    return out.withColumn("method", F.when(F.col("full"), "model_order").otherwise("native_order")).drop("full")


def panel_order(panels: DataFrame) -> DataFrame:
    """Rows of vertically overlapping panels from the top, inside a row by x - y descending."""
    by_y = [F.col("y1"), F.col("panel_id")]
    d = prefix_scan(panels, ["page"], by_y, maxes_before={"__top": F.col("y2")})
    starts = F.when(F.col("__top").isNull() | (F.col("y1") > F.col("__top")), 1).otherwise(0)
    d = prefix_scan(d, ["page"], by_y, sums={"row_no": starts}).withColumn("row_no", F.col("row_no").cast("int"))
    return prefix_scan(d, ["page"], [F.col("row_no"), (F.col("x1") - F.col("y1")).desc(), F.col("panel_id")], number="position").drop("__top")


def panel_text_order(blocks: DataFrame, panels: DataFrame) -> DataFrame:
    """Text order by nearest panel, then x - y descending; text on pages without panels counts as panel 0."""
    d = nearest_panel(blocks, panels).withColumn("panel_id", F.coalesce("panel_id", F.lit(0)))
    return prefix_scan(d, ["page"], [F.col("panel_id"), (F.col("x1") - F.col("y1")).desc(), F.col("block_id")], number="position")


class _Placed:
    """Regions in order, in short blocks that know the lowest bottom, lowest top edge and nearest side of their members.

    The first region that a new one goes before is sought block by block; a block whose bounds rule all its members out is passed over. Regions come
    by centre y.
    """

    WIDTH = 128

    def __init__(self) -> None:
        self.blocks: list[list[tuple]] = [[]]  # (bottom, top, side, row); a new region goes before a larger side
        self.bounds: list[tuple] = [(float("-inf"),) * 3]

    def insert(self, row, side: float) -> None:
        at = None
        for b, (bottom, top, far) in enumerate(self.bounds):
            if row.cy <= bottom and (row.cy < top or side < far):
                at = next((k for k, m in enumerate(self.blocks[b]) if row.cy <= m[0] and (row.cy < m[1] or side < m[2])), None)
                if at is not None:
                    break
                # the members that raised the bounds end above this region, and so above all later ones
                self.bounds[b] = self._bounds([m for m in self.blocks[b] if row.cy <= m[0]])
        else:
            b = len(self.blocks) - 1
        block = self.blocks[b]
        if at is None:
            at = len(block)
        elif row.cy < block[at][1]:  # above the top edge of a box with swapped edges: behind it
            at += 1
        block.insert(at, (row.y2, row.y1, side, row))
        if len(block) < 2 * self.WIDTH:
            self.bounds[b] = tuple(map(max, self.bounds[b], block[at]))
        else:
            self.blocks[b:b + 1] = block[:self.WIDTH], block[self.WIDTH:]
            self.bounds[b:b + 1] = map(self._bounds, self.blocks[b:b + 2])

    @staticmethod
    def _bounds(members: list[tuple]) -> tuple:
        return tuple(max((m[i] for m in members), default=float("-inf")) for i in range(3))


def _insert_sorted(rows: list) -> list[tuple]:
    """Insert regions of one band by centre y; inside a line the x centre decides.

    A region above the top edge of a placed one (only boxes with swapped edges have it below their centre) goes behind that one.
    """
    placed = _Placed()
    for r in rows:
        placed.insert(r, -r.cx if r.rtl else r.cx)
    return [(m[3].page, m[3].block_id, m[3].band, i) for i, m in enumerate((m for block in placed.blocks for m in block), 1)]


def sort_regions(blocks: DataFrame, rtl: bool | None = None) -> DataFrame:
    """Row-wise region sort. One vertical block makes a page right-to-left unless ``rtl`` is given.

    A region whose centre lies below every earlier bottom edge starts a new band: nothing later can be inserted
    before it. Bands are therefore independent and only a band, not a page, is folded in order.
    """
    return by_size(blocks, ["page"], lambda b: _sort_whole(b, rtl), lambda b: _sort_spread(b, rtl))


def _sort_whole(blocks: DataFrame, rtl: bool | None) -> DataFrame:
    page, band = Window.partitionBy("page"), Window.partitionBy("page", "band")
    by_y = page.orderBy("cy", "block_id")
    d = blocks.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    d = d.withColumn("rtl", F.bool_or(F.coalesce(F.col("vertical"), F.lit(False))).over(page) if rtl is None else F.lit(rtl))
    d = d.withColumn("__bottom", F.max("y2").over(by_y.rowsBetween(Window.unboundedPreceding, -1)))
    new = F.when(F.col("__bottom").isNull() | (F.col("cy") > F.col("__bottom")), 1).otherwise(0)
    d = d.withColumn("band", F.sum(new).over(by_y.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    d = d.withColumns({"n": F.count(F.lit(1)).over(band), "upto": F.count(F.lit(1)).over(page.orderBy("band"))})  # rows of this and earlier bands
    many = d.filter("n > 1").select("page", "block_id", "band", "cx", "cy", "y1", "y2", "rtl", "n", "upto")

    def fold(rows: list) -> list[tuple]:
        before = rows[0].upto - rows[0].n
        return [(page, block, before + i) for page, block, _, i in _insert_sorted(rows)]

    folded = fold_groups(many, ["page", "band"], ["cy", "block_id"], fold, "page long, block_id int, position int")
    return folded.unionByName(d.filter("n = 1").select("page", "block_id", F.col("upto").cast("int").alias("position")))


def _sort_spread(blocks: DataFrame, rtl: bool | None) -> DataFrame:
    d = blocks.withColumns({"cx": (F.col("x1") + F.col("x2")) / 2, "cy": (F.col("y1") + F.col("y2")) / 2})
    if rtl is None:
        d = per_key(d, ["page"], F.bool_or(F.coalesce(F.col("vertical"), F.lit(False))).alias("rtl"))
    else:
        d = d.withColumn("rtl", F.lit(rtl))
    order = [F.col("cy"), F.col("block_id")]
    d = prefix_scan(d, ["page"], order, maxes_before={"__bottom": F.col("y2")})
    new = F.when(F.col("__bottom").isNull() | (F.col("cy") > F.col("__bottom")), 1).otherwise(0)
    d = prefix_scan(d, ["page"], order, sums={"band": new})
    d = cut_lineage(per_key(d.select("page", "block_id", "band", "cx", "cy", "y1", "y2", "rtl"), ["page", "band"], F.count(F.lit(1)).alias("n")))
    many = d.filter("n > 1").select("page", "block_id", "band", "cx", "cy", "y1", "y2", "rtl")
    folded = fold_groups(many, ["page", "band"], ["cy", "block_id"], _insert_sorted,
                         "page long, block_id int, band long, in_band int")
    folded = folded.unionByName(d.filter("n = 1").select("page", "block_id", "band", F.lit(1).alias("in_band")))
    before = prefix_scan(d.groupBy("page", "band").agg(F.count(F.lit(1)).alias("n")), ["page"], [F.col("band")], sums={"upto": F.col("n")})
    return (folded.join(before, ["page", "band"])
            .select("page", "block_id", (F.col("upto") - F.col("n") + F.col("in_band")).cast("int").alias("position")))


def split_blocks(lines: DataFrame) -> DataFrame:
    """Cut the lines of a block where neighbours lie too far apart; adds ``part`` (1-based).

    Lines: page, block_id, line_id, box, distance, font_size, vertical. Touching neighbours never split; a jump of
    more than two font sizes does; vertical neighbours also split on a shifted start, but then a one-line part
    only if the jump exceeds the font size. That last rule looks at the previous outcome, so each row is either
    a fixed outcome or the opposite of the one before; the outcome is the last fixed one, flipped as often.
    """
    return by_size(lines, ["page", "block_id"], _split_whole, _split_spread)


def _outcome() -> Column:
    """The fixed outcome of a line whose previous one is ``p``, null where it is the opposite of the one before."""
    apart = ((F.col("x1") > F.col("p.x2")) | (F.col("p.x1") > F.col("x2"))
             | (F.col("y1") > F.col("p.y2")) | (F.col("p.y1") > F.col("y2")))
    jump = F.abs(F.col("distance") - F.col("p.distance"))
    shifted = F.col("vertical") & (F.abs(F.col("y1") - F.col("p.y1")) > F.col("font_size"))
    return (F.when(F.col("p").isNull(), 1).when(~apart, 0).when(jump > 2 * F.col("font_size"), 1)
            .when(shifted & (jump > F.col("font_size")), 1).when(~shifted, 0))


def _split_whole(lines: DataFrame) -> DataFrame:
    """All columns in the one order of a block, so that its lines are sorted once; the first line is always fixed."""
    rows = Window.partitionBy("page", "block_id").orderBy("distance", "line_id")
    upto = rows.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    d = lines.withColumn("p", F.lag(F.struct("x1", "y1", "x2", "y2", "distance")).over(rows)).withColumn("__fixed", _outcome())
    d = d.withColumn("__f", F.sum(F.col("__fixed").isNull().cast("int")).over(upto))
    last = F.last(F.when(F.col("__fixed").isNotNull(), F.struct("__fixed", "__f")), ignorenulls=True).over(upto)
    d = d.withColumn("__last", last).withColumn("__cut", (F.col("__last.__fixed") + F.col("__f") - F.col("__last.__f")) % 2)
    return d.select(*lines.columns, F.sum("__cut").over(upto).cast("int").alias("part"))


def _split_spread(lines: DataFrame) -> DataFrame:
    key, order = ["page", "block_id"], [F.col("distance"), F.col("line_id")]
    d = previous_row(lines, key, order, F.struct("x1", "y1", "x2", "y2", "distance"), "p")
    d = d.withColumn("__fixed", _outcome()).drop("p")
    d = prefix_scan(d, key, order, sums={"__g": F.col("__fixed").isNotNull().cast("int"),
                                                "__f": F.col("__fixed").isNull().cast("int")})
    d = per_key(d, [*key, "__g"], F.min("__f").alias("__f0"), F.max("__fixed").alias("__base"))
    cut = (F.col("__base") + F.col("__f") - F.col("__f0")) % 2
    d = prefix_scan(d.withColumn("__cut", cut), key, order, sums={"part": F.col("__cut")})
    return d.select(*lines.columns, F.col("part").cast("int").alias("part"))
