"""Prefix scans: running numbers, sums and maxima that do not need a large key in one task.

A plain window puts all rows of a key into one task, which is right for the many short keys: their rows are often together already, and nothing
else has to move. Keys with more than ``WHOLE`` rows, found by one count, go two levels instead: their rows are range-partitioned by key and order and
cut into the checkpoint folder; each range is scanned on its own, and only one total per key and range is carried across. A key with a
third of all rows is thus spread over a third of the ranges, whatever its values look like.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagetext.session import cut_lineage

CHUNK = "__chunk"
WHOLE = 100_000  # rows of a key that one task scans


def keys_over(df: DataFrame, keys: Sequence[str], most: int) -> DataFrame | None:
    """The keys with more than ``most`` rows; none of them: None. At most one row per ``most`` rows of ``df``."""
    large = cut_lineage(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n")).filter(F.col("__n") > most).select(*keys))
    return None if large.isEmpty() else large


def by_size(df: DataFrame, keys: Sequence[str], whole: Callable[[DataFrame], DataFrame], spread: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``whole`` of the rows whose key has at most ``WHOLE`` rows, ``spread`` of those of larger keys."""
    large = keys_over(df, keys, WHOLE)
    if large is None:
        return whole(df)
    large = F.broadcast(large)
    return whole(df.join(large, list(keys), "left_anti")).unionByName(spread(df.join(large, list(keys), "left_semi")))


def _placed(df: DataFrame, keys: Sequence[str], order: Sequence[Column], aggs: Sequence[Column]) -> tuple[DataFrame, DataFrame]:
    """(rows with their range as ``CHUNK``, totals per key and range). The rows are range-partitioned by key and order and cut once."""
    d = cut_lineage(df.repartitionByRange(*keys, *order).withColumn(CHUNK, F.spark_partition_id().cast("long")))
    return d, d.groupBy(*keys, CHUNK).agg(F.count(F.lit(1)).alias("__n"), *aggs)


def _offsets(totals: DataFrame, keys: Sequence[str], exprs: dict[str, tuple[str, object]]) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(CHUNK).rowsBetween(Window.unboundedPreceding, -1)
    cols = []
    for name, (kind, zero) in exprs.items():
        agg = (F.sum if kind == "sum" else F.max)(name).over(w)
        cols.append((F.coalesce(agg, F.lit(zero)) if zero is not None else agg).alias(f"__o_{name}"))
    return totals.select(*keys, CHUNK, *cols)


def prefix_scan(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    number: str | None = None,
    sums: dict[str, Column] | None = None,
    maxes_before: dict[str, Column] | None = None,
) -> DataFrame:
    """Add running columns per key.

    ``number``: 1-based position; ``sums``: inclusive running sums; ``maxes_before``: maximum over all earlier
    rows (null on the first). ``keys`` must not be null.
    """
    sums, maxes_before, keys = sums or {}, maxes_before or {}, list(keys)
    return by_size(df, keys, lambda d: _scan_whole(d, keys, order, number, sums, maxes_before), lambda d: _scan_spread(d, keys, order, number, sums, maxes_before))


def _scan_whole(df: DataFrame, keys: list[str], order: Sequence[Column], number: str | None, sums: dict[str, Column], maxes_before: dict[str, Column]) -> DataFrame:
    local = Window.partitionBy(*keys).orderBy(*order)
    upto, before = local.rowsBetween(Window.unboundedPreceding, Window.currentRow), local.rowsBetween(Window.unboundedPreceding, -1)
    new = {number: F.row_number().over(local).cast("int")} if number else {}
    new |= {f"__s_{k}": F.sum(c).over(upto) for k, c in sums.items()} | {f"__m_{k}": F.max(c).over(before) for k, c in maxes_before.items()}
    out = df.withColumns(new)
    return out.select(*df.columns, *([number] if number else []), *(F.col(f"__s_{k}").alias(k) for k in sums), *(F.col(f"__m_{k}").alias(k) for k in maxes_before))


def _scan_spread(df: DataFrame, keys: list[str], order: Sequence[Column], number: str | None, sums: dict[str, Column], maxes_before: dict[str, Column]) -> DataFrame:
    d = df
    aggs, exprs = [], {}
    if number:
        exprs["__n"] = ("sum", 0)
    for k, c in sums.items():
        d = d.withColumn(f"__s_{k}", c)
        aggs.append(F.sum(f"__s_{k}").alias(f"__t_{k}"))
        exprs[f"__t_{k}"] = ("sum", 0)
    for k, c in maxes_before.items():
        d = d.withColumn(f"__m_{k}", c)
        aggs.append(F.max(f"__m_{k}").alias(f"__x_{k}"))
        exprs[f"__x_{k}"] = ("max", None)
    d, totals = _placed(d, keys, order, aggs)
    offsets = _offsets(totals, keys, exprs)
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = local.rowsBetween(Window.unboundedPreceding, -1)
    out = d.join(offsets, [*keys, CHUNK])
    if number:
        out = out.withColumn(number, (F.row_number().over(local) + F.col("__o___n")).cast("int"))
    for k in sums:
        out = out.withColumn(k, F.sum(f"__s_{k}").over(upto) + F.col(f"__o___t_{k}"))
    for k in maxes_before:
        out = out.withColumn(k, F.greatest(F.max(f"__m_{k}").over(before), F.col(f"__o___x_{k}")))
    return out.select(*df.columns, *([number] if number else []), *sums, *maxes_before)


def previous_row(df: DataFrame, keys: Sequence[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    """``lag(value)`` per key in the same way; of a large key the last row of each range is handed to the next one."""
    keys = list(keys)

    def whole(d: DataFrame) -> DataFrame:
        return d.withColumn(out, F.lag(value).over(Window.partitionBy(*keys).orderBy(*order)))

    return by_size(df, keys, whole, lambda d: _previous_spread(d, keys, order, value, out))


def _previous_spread(df: DataFrame, keys: list[str], order: Sequence[Column], value: Column, out: str) -> DataFrame:
    d, last = _placed(df.withColumn("__v", value), keys, order, [F.max_by(F.struct("__v"), F.struct(*order)).alias("__last")])
    w = Window.partitionBy(*keys).orderBy(CHUNK)
    carried = last.select(*keys, CHUNK, F.lag("__last").over(w).alias("__carry"))
    local = Window.partitionBy(*keys, CHUNK).orderBy(*order)
    return (d.join(carried, [*keys, CHUNK])
            .withColumn("__lag", F.lag(F.struct("__v")).over(local))
            .withColumn(out, F.coalesce("__lag", "__carry")["__v"])
            .select(*df.columns, out))


def per_key(df: DataFrame, keys: Sequence[str], *aggs: Column) -> DataFrame:
    """Whole-key aggregates joined back to the rows: partial aggregation first, then a join AQE can split."""
    return df.join(df.groupBy(*keys).agg(*aggs), list(keys))


def expand_ranges(df: DataFrame, first: Column, last: Column, name: str, piece: int = 1 << 14) -> DataFrame:
    """One row per whole number from ``first`` to ``last`` of each row (none if ``first`` is larger), as column ``name``.

    A wide range is cut into pieces of at most ``piece`` numbers, which are dealt over the tasks before they are expanded, so that no task
    expands a whole range; the only array over a range holds one number per piece.
    """
    d = df.withColumns({"__a": first.cast("long"), "__b": last.cast("long")}).filter("__a <= __b")
    d = d.withColumn("__a", F.explode(F.sequence("__a", "__b", F.lit(piece).cast("long"))))
    d = d.withColumn("__b", F.least("__b", F.col("__a") + (piece - 1))).repartition("__a")
    return d.withColumn(name, F.explode(F.sequence("__a", "__b"))).select(*df.columns, name)
