"""Page image sources."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from pagetext.operators.ledger import natural_key
from pagetext.session import cut_lineage

# Image suffixes of a page folder.
IMAGE_SUFFIXES = (".png", ".jpg", ".jpeg", ".webp", ".bmp", ".tif", ".tiff", ".gif")


def natural_positions(df: DataFrame, name: str) -> DataFrame:
    """1-based position of every row in natural name order.

    Rows are range-partitioned by the key and cut once; each range is numbered by its own task and shifted by the
    sizes of the ranges before it, so no task sees the whole list.
    """
    d = df.withColumn("__key", natural_key(F.col(name)))
    parts = cut_lineage(d.repartitionByRange("__key", F.col(name))).withColumn("__part", F.spark_partition_id())
    sizes = parts.groupBy("__part").agg(F.count(F.lit(1)).alias("n"))
    # One row per range, so this window only ever sees as many rows as there are partitions.
    before = sizes.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__before"))
    w = Window.partitionBy("__part").orderBy("__key", name)
    return (parts.join(F.broadcast(before), "__part").withColumn("position", (F.col("__before") + F.row_number().over(w)).cast("int"))
            .drop("__key", "__part", "__before"))


def scan_pages(spark: SparkSession, path: str, recursive: bool = False, exclude: Sequence[str] = (), suffixes: Sequence[str] = IMAGE_SUFFIXES) -> DataFrame:
    """Manifest of a page folder: source_name, path, size, source_sha256, position. Fails on an empty folder.

    With ``recursive``, files whose own folder has an excluded name are skipped; deeper folders are still read.
    """
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    # Each folder level is one path segment; the suffix test is the same in any case.
    files = reader.load(path).filter(F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + ")$"))
    segments = F.split("path", "/")
    if exclude:
        files = files.filter(~F.element_at(segments, -2).isin(list(exclude)))
    found = files.select(F.element_at(segments, -1).alias("source_name"), "path", F.col("length").alias("size"), F.sha2("content", 256).alias("source_sha256"))
    out = natural_positions(found, "source_name" if not recursive else "path")
    if out.isEmpty():
        raise ValueError(f"no page image in {path}")
    return out
