"""Ordered folds over many small groups, without one pandas frame per group."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Callable, Iterable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

STEP = "__step"


def in_order(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The rows of each group together in one task and in order, numbered from 1 as ``STEP``.

    The window states both as needs of the plan. A ``repartition`` by the keys does not: it is left out where a join by the keys already
    deals the rows, and when that join turns into a broadcast while it runs, the rows of a group stay where they were read.
    """
    return df.withColumn(STEP, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def fold_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column],
                fn: Callable[[list], Iterable[tuple]], schema: str) -> DataFrame:
    """Apply ``fn`` to the rows of every group, in order; Spark shuffles and sorts, tasks stream Arrow batches.

    Callers must make groups small by construction (independent bands or islands of a page), since the rows of
    one group are held together. ``fn`` gets named tuples and yields output tuples.
    """
    columns = df.columns
    out_cols = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row_type = namedtuple("Row", columns)

        buffer: list[tuple] = []
        group: list[tuple] = []
        for pdf in batches:
            for step, *values in zip(pdf[STEP].tolist(), *[pdf[c].tolist() for c in columns]):
                if step == 1 and group:
                    buffer.extend(fn(group))
                    group = []
                    if len(buffer) >= 20000:
                        yield pd.DataFrame(buffer, columns=out_cols)
                        buffer = []
                group.append(row_type(*values))
        if group:
            buffer.extend(fn(group))
        if buffer:
            yield pd.DataFrame(buffer, columns=out_cols)

    return in_order(df, keys, order).mapInPandas(run, schema)


def scan_groups(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column], init: Callable, step: Callable, schema: str) -> DataFrame:
    """Ordered scan with a small state: ``step(state, row) -> (state, output)``, ``init(first row)`` per group.

    Rows stream through in Arrow batches; only the state is held, never a group.
    """
    columns = df.columns
    out_cols = [c.strip().split()[0] for c in schema.split(",")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        row_type = namedtuple("Row", columns)
        state = None
        for pdf in batches:
            out = []
            for number, *values in zip(pdf[STEP].tolist(), *[pdf[c].tolist() for c in columns]):
                row = row_type(*values)
                if number == 1:
                    state = init(row)
                state, made = step(state, row)
                out.append(made)
            yield pd.DataFrame(out, columns=out_cols)

    return in_order(df, keys, order).mapInPandas(run, schema)
