"""Sinks: ledgers, marked text, summaries, labelled text, gated publishing."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.functions import text as tx
from pagetext.session import ensure_checkpoint_dir

LEDGER = ("page", "source_id", "reading_order", "source", "translation", "font_size", "small_text_review")


def scratch_dir(spark: SparkSession, name: str) -> str:
    """A new folder next to the checkpoints, where every executor can write."""
    return f"{ensure_checkpoint_dir(spark)}/{name}-{uuid.uuid4().hex}"


def write_ledger(df: DataFrame, path: str, fmt: str = "parquet", columns: Sequence[str] = LEDGER, order: Sequence[str] = ("page", "source_id"), mode: str = "errorifexists") -> None:
    """Ledger with a fixed column order, globally sorted across the part files (a range sort, no single writer).

    CSV parts carry a byte order mark and a header.
    """
    d = df.select(*columns).repartitionByRange(*order).sortWithinPartitions(*order)
    if fmt == "csv":
        d.withColumnRenamed(columns[0], "﻿" + columns[0]).write.mode(mode).option("header", "true").option("escape", '"').option("ignoreLeadingWhiteSpace", "false").option("ignoreTrailingWhiteSpace", "false").csv(path)
    else:
        getattr(d.write.mode(mode), fmt)(path)


def read_ledger_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    first = schema.split()[0]
    d = spark.read.schema(schema).option("header", "true").option("enforceSchema", "true").option("escape", '"').option("multiLine", "true").csv(path)
    return d.withColumnRenamed("﻿" + first, first) if "﻿" + first in d.columns else d


def to_marked_text(blocks: DataFrame, column: str = "text") -> DataFrame:
    """Lines of marked text: (page, seq, line). A page opens with ``### page``; items follow, blank lines between.

    The text stays one row per block, so a page of any size is written by sorted parts.
    """
    head = blocks.select("page").distinct().select("page", F.lit(0).alias("seq"), F.concat(F.lit("### "), F.col("page").cast("string")).alias("line"))
    last = blocks.groupBy("page").agg(F.max("block_id").alias("last"))
    item = F.concat(F.col("block_id").cast("string"), F.lit(". "), tx.strip(F.col(column)), F.when(F.col("block_id") == F.col("last"), "\n").otherwise(""))
    body = blocks.join(last, "page").select("page", F.col("block_id").alias("seq"), item.alias("line"))
    return head.unionByName(body)


def to_summary_md(summaries: DataFrame) -> DataFrame:
    """One section per page in page order: (page_idx, line)."""
    return summaries.select("page_idx", F.concat(F.lit("### "), "page", F.lit("\n\n"), F.coalesce("text", F.lit("")), F.lit("\n")).alias("line"))


def to_labelled_text(blocks: DataFrame) -> DataFrame:
    """Labelled text: a page header, then index, x and y as fractions of the page, text: (page, seq, line)."""
    c = F.col
    head = blocks.select("page").distinct().select("page", F.lit(0).alias("seq"), F.concat(F.lit(">>>>>>>>["), c("page").cast("string"), F.lit("]<<<<<<<<")).alias("line"))
    xy = F.concat(F.lit("["), F.format_string("%.6f", c("x1") / c("page_w")), F.lit(", "), F.format_string("%.6f", c("y1") / c("page_h")), F.lit(", 1]"))
    body = blocks.select("page", c("block_id").alias("seq"), F.concat(F.lit("----------------["), c("block_id"), F.lit("]----------------"), xy, F.lit("\n"), c("text")).alias("line"))
    return head.unionByName(body)


def write_lines(lines: DataFrame, path: str, order: Sequence[str]) -> None:
    """Write ``line`` rows as text parts that follow each other in order."""
    (lines.repartitionByRange(*order).sortWithinPartitions(*order).select(F.col("line").alias("value"))).write.text(path)


def plan_publish(verified: DataFrame, manifest: DataFrame, existing: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(writes, conflicts, new manifest) of publishing verified pages.

    verified: page, sha256; manifest: page, output_name, output_sha256; existing: output_name, existing_sha256. A
    target holding something neither new nor recorded is a conflict and stays untouched. Running it again after the
    write gives no writes.
    """
    c = F.col
    d = manifest.join(verified, "page").join(existing, "output_name", "left")
    clash = c("existing_sha256").isNotNull() & (c("existing_sha256") != c("sha256")) & ~c("existing_sha256").eqNullSafe(c("output_sha256"))
    d = d.withColumn("clash", clash)
    writes = d.filter(~c("clash") & ~c("existing_sha256").eqNullSafe(c("sha256"))).select("page", "output_name", "sha256")
    conflicts = d.filter("clash").select("page", "output_name", "existing_sha256", "sha256")
    recorded = d.filter(~c("clash")).select("page", c("sha256").alias("new_sha"))
    after = manifest.join(recorded, "page", "left").withColumn("output_sha256", F.coalesce("new_sha", "output_sha256")).drop("new_sha")
    return writes, conflicts, after


def write_published(rows: DataFrame, path: str, partition: str) -> None:
    """Replace only the partitions present in ``rows``; a replay writes the same partitions again. Large partitions are written by several tasks."""
    rows.hint("rebalance", F.col(partition)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(partition).parquet(path)
