"""Helpers shared by the operators: words, folds, running totals that never need a whole key in one task."""

from __future__ import annotations

import gc
import string
import time
import uuid
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetext.session import cut_lineage, ensure_checkpoint_dir

WORD = r"[^\x20\x09-\x0D]+"
PART = "__part"


def lower_ascii(text: Column) -> Column:
    """Only A-Z become lower case; every other letter stays."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def word_count(text: Column) -> Column:
    """Number of words (runs without ASCII white space) as a long; null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id's decimal text, modulo ``modulus``; a null id counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % modulus


def id_key(doc_id: Column, seed: str) -> Column:
    """A hash-random, reproducible sort key of a document."""
    return F.md5(F.concat(F.lit(seed + ":"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"))


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` below the shared checkpoint folder and read it back: compact columns, no lineage above it.

    A column-wise file is several times smaller than a row checkpoint, and it survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of frames that are no longer referred to, instead of whenever the driver collects garbage.

    The JVM hears of a frame that Python has let go of a moment later, so a second round is what frees its files.
    """
    for _ in range(3):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(0.7)


def running_totals(df: DataFrame, group: Sequence[str], order: Sequence[str], sums: Mapping[str, Column],
                   facts: DataFrame | None = None) -> DataFrame:
    """Add inclusive running sums per ``group`` along ``order``, without a whole group in one task.

    The rows are range-sorted by group and order and cut; each range is summed on its own, and one total per range
    and group is carried across. A group with a third of all rows is spread over a third of the ranges. Rows equal in
    the whole order are told apart by an arrival number, so that even they can be split; their sums are then
    given in an unspecified order. ``facts`` (one row per group) is added on the way. Group columns must not be null.
    """
    group, order = list(group), list(order)
    d = df.withColumns({f"__v_{k}": v for k, v in sums.items()}).withColumn("__arrival", F.monotonically_increasing_id())
    d = cut_lineage(d.repartitionByRange(*group, *order, "__arrival").withColumn(PART, F.spark_partition_id()))
    totals = d.groupBy(PART, *group).agg(*[F.sum(f"__v_{k}").alias(f"__t_{k}") for k in sums])
    earlier = Window.partitionBy(*group).orderBy(PART).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(PART, *group, *[F.coalesce(F.sum(f"__t_{k}").over(earlier), F.lit(0)).alias(f"__o_{k}") for k in sums])
    if facts is not None:
        offsets = offsets.join(facts, group)
    local = Window.partitionBy(PART, *group).orderBy(*order, "__arrival").rowsBetween(Window.unboundedPreceding, 0)
    out = d.join(offsets, [PART, *group]).withColumns({k: F.sum(f"__v_{k}").over(local) + F.col(f"__o_{k}") for k in sums})
    more = [c for c in facts.columns if c not in group] if facts is not None else []
    return out.select(*df.columns, *sums, *more)


def prefix_sums(lengths: Column, block: int = 256) -> Column:
    """Exclusive prefix sums of an array of ints, as longs; built per block, so long arrays don't cost their square."""
    def scan(values: Column, start: Column) -> Column:
        empty = F.struct(start.alias("at"), F.array().cast("array<bigint>").alias("out"))
        return F.aggregate(values, empty, lambda s, x: F.struct((s["at"] + x).alias("at"), F.concat(s["out"], F.array(s["at"])).alias("out")),
                           lambda s: s["out"])

    blocks = F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.size(lengths) / block) - 1, F.lit(0)).cast("int")),
                         lambda k: F.slice(lengths, k * block + 1, block))
    totals = F.transform(blocks, lambda b: F.aggregate(b, F.lit(0).cast("bigint"), lambda s, x: s + x))
    return F.flatten(F.zip_with(blocks, scan(totals, F.lit(0).cast("bigint")), lambda b, at: scan(b, at)))
