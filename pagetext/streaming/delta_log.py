"""A keyed table as a log of versions: each write holds changed keys only, and every so many versions a compacted base is written.

Nothing is kept in the driver: what a version sees follows from the files of the versions before it, so a version that is written again,
or by another run after a crash, comes out the same.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, LongType, StructField, StructType


class DeltaLog:
    """The table of ``schema`` below ``path`` with one row for every value of ``keys``.

    Rows lie in ``parts`` folders by the hash of their keys, so that a version reads only the folders its own keys fall into. After every
    ``every`` versions a base holds the latest row of all keys; only younger versions are read besides it. A base counts once its mark is
    written. Versions older than the last base are never read again and may be removed.
    """

    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], schema: StructType, parts: int = 16, every: int = 16):
        self.spark, self.path, self.keys, self.parts, self.every = spark, path, list(keys), parts, every
        self.columns = schema.names
        self.stored = StructType([*schema, StructField("__version", LongType()), StructField("__part", IntegerType())])

    def _part(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.parts)).cast("int")

    def _table(self, folder: str, schema: StructType, spark: SparkSession | None = None) -> DataFrame:
        spark = spark or self.spark
        try:
            return spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException:  # nothing has been written yet
            return spark.createDataFrame([], schema)

    def _save(self, rows: DataFrame, folder: str, version: int) -> None:
        placed = rows.select(*self.columns).withColumn("__part", self._part())
        placed.write.mode("overwrite").partitionBy("__part").parquet(f"{self.path}/{folder}/__version={version}")

    def base_before(self, version: int | None) -> int | None:
        """The youngest base below ``version``."""
        done = self._table("done", StructType([StructField("ok", LongType()), StructField("__version", LongType())]))
        done = done if version is None else done.filter(F.col("__version") < version)
        return done.agg(F.max("__version")).first()[0]

    def read(self, before: int | None = None, like: DataFrame | None = None) -> DataFrame:
        """Latest row of every key (below version ``before``); ``like``, a frame with the key columns, leaves out folders without its keys."""
        base = self.base_before(before)
        spark = self.spark if like is None else like.sparkSession  # a micro-batch has a session of its own
        rows = self._table("delta", self.stored, spark)
        rows = rows if before is None else rows.filter(F.col("__version") < before)
        if base is not None:
            rows = rows.filter(F.col("__version") > base).unionByName(self._table("base", self.stored, spark).filter(F.col("__version") == base))
        if like is not None:
            used = [r[0] for r in like.select(self._part().alias("p")).distinct().collect()]  # ``parts`` numbers at most
            rows = rows.filter(F.col("__part").isin(used) if used else F.lit(False))
        rest = [c for c in self.columns if c not in self.keys]
        last = rows.groupBy(*self.keys).agg(F.max_by(F.struct(*rest), "__version").alias("__row"))
        return last.select(*[F.col(c) if c in self.keys else F.col(f"__row.{c}").alias(c) for c in self.columns])

    def write(self, rows: DataFrame, version: int) -> None:
        """Make ``rows``, one a key, version ``version``; writing a version again replaces it. Versions are written in order."""
        self._save(rows, "delta", version)
        if version >= 0 and (version + 1) % self.every == 0:
            self.compact(version)

    def compact(self, version: int) -> None:
        """Write a base of all versions up to ``version``, then its mark."""
        self._save(self.read(before=version + 1), "base", version)
        self.spark.range(1).select(F.col("id").alias("ok")).write.mode("overwrite").parquet(f"{self.path}/done/__version={version}")
