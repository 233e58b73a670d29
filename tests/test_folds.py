"""Folds see each group whole, however Spark changes the joins before them while it runs."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from pagetext.operators.folds import fold_groups, scan_groups
from pagetext.operators.prefix import per_key

SETTINGS = {"spark.sql.autoBroadcastJoinThreshold": "16000", "spark.sql.adaptive.coalescePartitions.enabled": "false"}


@pytest.fixture
def late(spark):
    """A table of unknown size joined by its key: planned as a shuffle, the join broadcasts the counts once their size is known."""
    before = {k: spark.conf.get(k) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    rows = spark.sparkContext.parallelize([(i % 20, i) for i in range(20000)], 8)
    yield per_key(spark.createDataFrame(rows, "page long, id long"), ["page"], F.count(F.lit(1)).alias("n"))
    for k, v in before.items():
        spark.conf.set(k, v)


def test_fold_sees_whole_groups(late):
    rows = fold_groups(late, ["page"], ["id"], lambda g: [(g[0].page, len(g), g[0].id, g[-1].id)], "page long, n int, first long, last long")
    assert sorted(map(tuple, rows.collect())) == [(p, 1000, p, 19980 + p) for p in range(20)]


def test_scan_sees_whole_groups(late):
    rows = scan_groups(late, ["page"], ["id"], lambda r: 0, lambda k, r: (k + 1, (r.page, k + 1, r.id)), "page long, k int, id long")
    assert sorted(map(tuple, rows.collect())) == [(i % 20, i // 20 + 1, i) for i in sorted(range(20000), key=lambda i: (i % 20, i))]
