"""Scale of a page, fitting of text into boxes, direction by group, layout groups."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.functions import text as tx
from pagetext.operators.prefix import by_size, keys_over, per_key
from pagetext.operators.tiles import FEW, box_pairs
from pagetext.session import cut_lineage


def resolution_scale(page_w: Column, page_h: Column, font: Column) -> Column:
    """Page scale against a 1050 pixel short side, else against a large font, never below 1."""
    short = F.least(page_w, page_h)
    return (F.when(short > 0, F.greatest(F.lit(1.0), short / 1050.0)).when(font > 42, F.greatest(F.lit(1.0), font / 30.0)).otherwise(F.lit(1.0)))


def optical_tier(size: Column, scale: Column, ratios: tuple[float, float, float] = (1.08, 1.12, 1.16)) -> Column:
    """Character ratio of the size tier (below 18, below 30, else) at scale 1."""
    norm = size / F.greatest(F.lit(0.1), scale)
    return F.when(norm < 18, ratios[0]).when(norm < 30, ratios[1]).otherwise(ratios[2])


def scale_metrics(df: DataFrame) -> DataFrame:
    """Scale and spacing per block: char_ratio, letter_spacing, line_spacing (lines = column ``n_lines``)."""
    d = df.withColumn("scale", resolution_scale(F.col("page_w"), F.col("page_h"), F.col("font_size")))
    several = F.col("n_lines") > 1
    return d.withColumns({"char_ratio": optical_tier(F.col("font_size"), F.col("scale")),
                          "letter_spacing": optical_tier(F.col("font_size"), F.col("scale"), (1.0, 1.03, 1.05)),
                          "line_spacing": F.when(several & F.col("vertical"), 1.22).when(several, 1.20).otherwise(1.0)})


def _best_options(vertical: bool, n: np.ndarray, w: np.ndarray, h: np.ndarray, cap: np.ndarray, scale: np.ndarray) -> dict[str, np.ndarray]:
    """Best option of one orientation for each box: size, parts, per, ratio; parts is 0 where none fits.

    Every number of parts from 1 to n is an option. The highest score wins, then the larger size, then fewer parts.
    """
    box = np.repeat(np.arange(len(n)), n)
    k = (np.arange(len(box)) - np.repeat(np.cumsum(n) - n, n) + 1).astype(float)
    n_, w_, h_, cap_, scale_ = (x[box] for x in (n.astype(float), w, h, cap, scale))
    per = np.ceil(n_ / k)
    spread = np.where(k == 1, 1.08, 1.20)
    if vertical:
        room = np.minimum(cap_, w_ / np.where(k == 1, 1.18, k * 1.22 + 0.22))
        probe = np.minimum(room, h_ / (per * 1.13 + 0.25))
        norm = probe / np.maximum(0.1, scale_)
        ratio = np.where(norm < 18, 1.08, np.where(norm < 30, 1.12, 1.16))
    else:
        room = np.minimum(cap_, w_ / (per * 1.08 + 0.25))
        probe = np.minimum(room, h_ / (k * spread + 0.25))
        ratio = spread
    size = np.maximum(1.0, np.floor(np.minimum(room, h_ / ((per if vertical else k) * ratio + 0.25)) * 4) / 4)
    factor = np.where((k > 1) & (n_ % (k if vertical else per) == 1) & (per > 2), 0.95, 1.0)
    if vertical:
        fill = per * size * ratio / h_
        tall = h_ / np.maximum(1.0, w_) >= 1.4
        factor = np.where(tall, np.where(fill < 0.55, np.power(np.minimum(fill / 0.55, 1.0), 0.85), 1.0), factor)
    score = size * factor
    best = np.flatnonzero(probe >= 1)
    for value in (score, size, -k):  # numbers of parts differ, so this leaves one option a box
        top = np.full(len(n), -np.inf)
        np.maximum.at(top, box[best], value[best])
        best = best[value[best] == top[box[best]]]
    out = {x: np.zeros(len(n)) for x in ("size", "parts", "per", "ratio")}
    for name, value in zip(out, (size, k, per, ratio)):
        out[name][box[best]] = value[best]
    return out


OPTIONS = 1 << 20  # options tried at a time
FIT = "vertical boolean, size double, parts int, per int, ratio double"


def _solve(batch: pa.RecordBatch) -> pa.Array:
    """The layout of every distinct (units, width, height, cap, scale) of a batch, dealt back to its rows; null where none fits."""
    asked = np.stack([c.to_numpy(zero_copy_only=False).astype(float) for c in batch], axis=1)
    known = np.isfinite(asked).all(axis=1) & (asked[:, 0] > 0)
    tuples, of_row = np.unique(asked[known], axis=0, return_inverse=True)
    parts = []
    for rows in np.split(tuples, np.flatnonzero(np.diff(np.cumsum(tuples[:, 0]) // OPTIONS)) + 1) if len(tuples) else []:
        n, w, h, cap, scale = rows[:, 0].astype(np.int64), *rows[:, 1:].T
        v, r = _best_options(True, n, w, h, cap, scale), _best_options(False, n, w, h, cap, scale)
        across = (w / np.maximum(1.0, h) >= 1.3) | ((v["size"] < scale * 12.0) & (r["size"] >= v["size"] * 1.2))
        down = (v["parts"] > 0) & ((r["parts"] == 0) | ~across)
        parts.append(np.stack([down, *(np.where(down, v[x], r[x]) for x in v)], axis=1))
    found = np.zeros((len(asked), 5))
    if parts:
        found[known] = np.concatenate(parts)[of_row.reshape(-1)]
    none = found[:, 2] == 0
    kinds = (bool, float, np.int32, np.int32, float)
    return pa.StructArray.from_arrays([pa.array(found[:, i].astype(t)) for i, t in enumerate(kinds)], names=[f.split()[0] for f in FIT.split(", ")], mask=pa.array(none))


def fit_layout(df: DataFrame) -> DataFrame:
    """Best layout of ``text`` in its box: every number of columns and of lines is tried, once per distinct question of a batch.

    Adds ``fit_vertical, fit_size, parts, per_part, laid_out, fit_y1, fit_height, small_text``; null for empty text
    or boxes under six pixels. Without its breaks ``laid_out`` always equals the text.
    """
    c = F.col
    units = tx.clusters(F.regexp_replace("text", "[\r\n]", ""))
    d = df.withColumns({"__u": units, "__w": (c("x2") - c("x1")).cast("double"), "__h": (c("y2") - c("y1")).cast("double"),
                        "__s": resolution_scale(c("page_w"), c("page_h"), c("font_size"))})
    side = F.least("__w", "__h")
    top = F.when(side >= c("__s") * 150.0, 34.0).when(side >= c("__s") * 100.0, 30.0).otherwise(26.0) * c("__s")
    cap = F.when(c("font_size") > 0, F.least(F.greatest(c("font_size") * 1.05, c("__s") * 16.0), top)).otherwise(top)

    @F.arrow_udf(FIT)
    def fit_udf(n: pa.Array, w: pa.Array, h: pa.Array, cap: pa.Array, scale: pa.Array) -> pa.Array:
        return _solve(pa.RecordBatch.from_arrays([n, w, h, cap, scale], names=list("nwhcs")))

    n = F.when(side >= 6, F.size("__u")).otherwise(0).cast("double")
    d = d.withColumn("__f", fit_udf(n, c("__w"), c("__h"), cap.cast("double"), c("__s").cast("double")))
    size, per, ratio = c("__f.size"), c("__f.per"), c("__f.ratio")
    text_h = F.when(c("__f.vertical"), per * size * ratio).otherwise(c("__f.parts") * size * ratio)
    off = F.greatest(F.lit(0.0), (c("__h") - text_h) / 2)
    starts = F.sequence(F.lit(0), F.floor((F.size("__u") - 1) / per).cast("int"))
    cut = F.transform(starts, lambda i: F.array_join(F.slice("__u", i * per + 1, per), ""))
    some = c("__f").isNotNull()
    out = {"fit_vertical": c("__f.vertical"), "fit_size": size, "parts": c("__f.parts"), "per_part": per,
           "laid_out": F.when(some, F.array_join(cut, "\n")), "fit_y1": F.when(some, c("y1") + off),
           "fit_height": F.when(some, c("__h") - off), "small_text": size < c("__s") * 11.0}
    return d.withColumns(out).select(*df.columns, *out)


def inherit_direction(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(decisions, evidence) per block.

    blocks: page, block_id, grp (null = none), box, font_size, vertical (original), known (own direction or null),
    letters, n_lines, geometry_ok. A single-letter block takes the unanimous direction of confident peers of its
    group that lie close enough; a mixed group goes to review. Inherited directions are never evidence. Unanimity
    comes from per-group counts. On pages with at most ``FEW`` blocks the peers of a group are a list behind the page's own order, on larger
    ones only close peers are listed, by a tile join.
    """
    large = keys_over(blocks, ["page"], FEW)
    if large is None:
        return _directions_listed(blocks)
    large = F.broadcast(large)
    few, many = _directions_listed(blocks.join(large, ["page"], "left_anti")), _directions_joined(blocks.join(large, ["page"], "left_semi"))
    return few[0].unionByName(many[0]), few[1].unionByName(many[1])


def _asking(d: DataFrame) -> DataFrame:
    """``single`` and ``vote`` of every block, from the counts ``v`` and ``h`` of its group's directions."""
    c = F.col
    single = c("geometry_ok") & c("known").isNull() & (c("letters") == 1) & (c("n_lines") == 1)
    return d.withColumns({"single": single, "vote": F.when(single & (c("v") > 0) & (c("h") == 0), True).when(single & (c("h") > 0) & (c("v") == 0), False)})


def _close(own: Column, peer: Callable[[str], Column]) -> Column:
    """Whether a peer is near enough to be evidence; ``peer`` gives its columns by name."""
    c = F.col
    size = F.greatest(own, peer("font_size"))
    mid_x = F.abs((c("x1") + c("x2") - peer("x1") - peer("x2")) / 2) <= size * 3
    mid_y = F.abs((c("y1") + c("y2") - peer("y1") - peer("y2")) / 2) <= size * 3
    return F.when(c("vote"), (F.abs(c("y1") - peer("y1")) <= size) & mid_x).otherwise((F.abs(c("x1") - peer("x1")) <= size) & mid_y)


def _own() -> Column:
    return F.greatest(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"), F.col("font_size"))


def _directions_listed(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``inherit_direction`` on pages with few blocks, without a join."""
    c, group = F.col, Window.partitionBy("page", "grp")
    peer = c("known").isNotNull() & c("geometry_ok") & c("grp").isNotNull() & c("page").isNotNull()
    listed = F.when(peer, F.struct("block_id", "x1", "y1", "x2", "y2", "font_size"))
    d = blocks.withColumns({"v": F.count_if(peer & c("known")).over(group), "h": F.count_if(peer & ~c("known")).over(group),
                            "__peers": F.collect_list(listed).over(group)})
    near = F.filter("__peers", lambda p: _close(_own(), lambda name: p[name]))
    d = _asking(d).withColumn("__near", F.when(c("vote").isNotNull(), F.transform(near, lambda p: p["block_id"]))).drop("__peers")
    evidence = d.filter("vote is not null").select("page", "block_id", F.explode("__near").alias("evidence_id"))
    return _decided(d.withColumn("n_evidence", F.coalesce(F.when(c("__near").isNotNull(), F.size("__near")), F.lit(0)).cast("long"))), evidence


def _directions_joined(blocks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``inherit_direction`` on larger pages."""
    c = F.col
    sides = blocks.filter("known is not null and geometry_ok and grp is not null").groupBy("page", "grp").agg(
        F.count_if("known").alias("v"), F.count_if(~c("known")).alias("h"), F.max("font_size").alias("top_font"))
    d = _asking(blocks.join(sides, ["page", "grp"], "left").fillna(0, ["v", "h"]))
    asks = d.filter("vote is not null").select("page", "grp", "block_id", "x1", "y1", "x2", "y2", "font_size", "vote", "top_font")
    asks = asks.withColumn("own", _own())
    peers = blocks.filter("known is not null and geometry_ok and grp is not null").select("page", "grp", "block_id", "x1", "y1", "x2", "y2", "font_size")
    reach = F.greatest("own", "top_font")
    near = box_pairs(asks, peers, ["page", "grp"], gap_x=reach * 3, gap_y=reach * 3, tile=(1024, 1024))
    evidence = near.filter(_close(c("own"), lambda name: c("r_" + name))).select("page", "block_id", c("r_block_id").alias("evidence_id"))
    backed = evidence.groupBy("page", "block_id").agg(F.count(F.lit(1)).alias("n_evidence"))
    return _decided(d.join(backed, ["page", "block_id"], "left").fillna(0, ["n_evidence"])), evidence


def _decided(d: DataFrame) -> DataFrame:
    """Reason and direction of every block from ``single``, ``vote``, ``v``, ``h`` and ``n_evidence``."""
    c = F.col
    reason = (F.when(~c("geometry_ok"), "invalid_or_complex_source_geometry").when(c("known").isNotNull(), "own_multichar_line_geometry")
              .when(c("single") & (c("v") > 0) & (c("h") > 0), "mixed_group_requires_review")
              .when(c("n_evidence") > 0, "single_letter_inherits_supported_group_direction").otherwise("insufficient_direction_evidence"))
    d = d.withColumn("reason", reason)
    inherited = c("reason") == "single_letter_inherits_supported_group_direction"
    d = d.withColumn("direction", F.when(c("reason") == "own_multichar_line_geometry", c("known")).when(inherited, c("vote")))
    return d.select("page", "block_id", "grp", "vertical", "direction", "reason", "n_evidence",
                    (inherited & ~c("direction").eqNullSafe(c("vertical"))).alias("change"))


def layout_groups(decisions: DataFrame, matched: DataFrame) -> DataFrame:
    """Members of groups with a change: ``pending`` for joint fitting or ``needs_review``.

    matched: page, block_id, coverage, iou. Eligible: two to four members, one known direction, confident members
    keep their own direction, all matches good. Whether all share one bubble is a pixel question left to the caller.
    """
    c = F.col
    group = Window.partitionBy("page", "grp")
    d = by_size(decisions.filter("page is not null and grp is not null"), ["page"], lambda x: x.withColumn("any_change", F.bool_or("change").over(group)),
                lambda x: per_key(x, ["page", "grp"], F.bool_or("change").alias("any_change")))
    # Few groups have a change, so only their members are matched; they are kept, as they are asked for twice.
    d = cut_lineage(d.filter("any_change").drop("any_change").join(matched.select("page", "block_id", "coverage", "iou"), ["page", "block_id"], "left"))
    good = F.coalesce(c("coverage").between(0.6, 1), F.lit(False)) | F.coalesce(c("iou").between(0.3, 1), F.lit(False))
    keeps = c("change") | F.coalesce(c("direction") == c("vertical"), F.lit(False))
    d = per_key(d, ["page", "grp"], F.count(F.lit(1)).alias("members"),
                F.count("direction").alias("known"), F.min("direction").alias("lo"), F.max("direction").alias("hi"),
                F.bool_and(keeps & good).alias("sound"))
    fine = c("members").between(2, 4) & (c("known") == c("members")) & (c("lo") == c("hi")) & c("sound")
    return d.select("page", "grp", "block_id", F.when(fine, "pending").otherwise("needs_review").alias("group_fit"))
