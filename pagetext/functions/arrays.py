"""Work inside one row's arrays, without turning its elements into rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` computed once, however often and in whatever lambda it is used."""
    return F.transform(F.array(value), use)[0]


def prefix_sums(sizes: Column, block: int = 16, levels: int = 3) -> Column:
    """Exclusive prefix sums of an array of numbers, as longs.

    Each block is summed on its own and starts at the prefix sum of the blocks before it, on ``levels`` levels, so that the work grows
    with the length of the array and not with its square.
    """
    def within(values: Column, start: Column) -> Column:
        def upto(i: Column) -> Column:
            return F.aggregate(F.slice(values, 1, i), start, lambda s, x: s + x)
        return F.transform(values, lambda _, i: upto(i))

    def scan(values: Column, level: int) -> Column:
        zero = F.lit(0).cast("bigint")
        if not level:
            return within(values, zero)

        def joined(blocks: Column) -> Column:
            totals = F.transform(blocks, lambda b: F.aggregate(b, zero, lambda s, x: s + x))
            return F.flatten(F.zip_with(blocks, bound(totals, lambda t: scan(t, level - 1)), within))

        numbers = F.sequence(F.lit(0), F.greatest(F.ceil(F.size(values) / block).cast("int") - 1, F.lit(0)))
        return bound(F.transform(numbers, lambda k: F.slice(values, k * block + 1, F.lit(block))), joined)

    return bound(F.transform(sizes, lambda x: x.cast("bigint")), lambda v: scan(v, levels))
