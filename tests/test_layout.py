"""Directions and layout groups: few blocks a page are listed, many are joined, both give the same."""

import random

from pagetext.operators import layout as Y
from pagetext.operators.tiles import FEW

BLOCK = "page int, block_id int, grp int, x1 int, y1 int, x2 int, y2 int, font_size int, vertical boolean, known boolean, letters int, n_lines int, geometry_ok boolean"


def _blocks(spark, sizes):
    rng, rows = random.Random(3), []
    for page, n in sizes.items():
        for i in range(n):
            x, y, w, h = rng.randrange(120), rng.randrange(120), rng.randrange(3, 30), rng.randrange(3, 30)
            known = rng.choice([True, True, None, None, False if page % 2 else True])
            rows.append((page, i, rng.choice([0, 1, None]), x, y, x + w, y + h, rng.randrange(8, 20), rng.random() < 0.5, known, rng.choice([1, 1, 5]), 1, rng.random() < 0.9))
    return spark.createDataFrame(rows + [(None, k, 1, 0, 0, 9, 9, 9, False, True if k else None, 1, 1, True) for k in range(2)], BLOCK)


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_directions_of_few_and_many_blocks(spark):
    blocks = _blocks(spark, {p: 3 + p % 9 for p in range(1, 40)} | {50: FEW + 30, 52: FEW + 1})
    got, want = Y.inherit_direction(blocks), Y._directions_joined(blocks)
    assert got[0].schema.simpleString() == want[0].schema.simpleString() and got[1].schema.simpleString() == want[1].schema.simpleString()
    assert _rows(got[0]) == _rows(want[0]) and _rows(got[1]) == _rows(want[1])
    assert got[1].count() > 20 and got[0].filter("change").count() > 5
    matched = blocks.selectExpr("page", "block_id", "if(block_id % 7 = 0, 0.1, 0.7) as coverage", "0.0D as iou")
    assert _rows(Y.layout_groups(got[0], matched)) == _rows(Y.layout_groups(want[0], matched)) != []


def test_directions_of_few_blocks_need_no_join(spark):
    decisions, evidence = Y.inherit_direction(_blocks(spark, {p: 3 + p % 9 for p in range(1, 40)}))
    assert all("Join" not in d._jdf.queryExecution().executedPlan().toString() for d in (decisions, evidence))
