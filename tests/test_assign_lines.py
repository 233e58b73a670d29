"""Lines and their blocks: a list of blocks on small pages, tiles on larger ones, both give the same; hulls ask for each table once."""

import random

from pagetext.operators.aggregates import block_hull
from pagetext.operators.boxes import _assigned_joined, assign_lines
from pagetext.operators.tiles import FEW


def _boxes(spark, sizes, name, seed):
    rng = random.Random(seed)
    rows = [(p, i, x := rng.randrange(200), y := rng.randrange(200), x + rng.randrange(-1, 60), y + rng.randrange(-1, 60)) for p, n in sizes.items() for i in range(n)]
    return spark.createDataFrame([*rows, (None, 0, 0, 0, 9, 9)], f"page int, {name} int, x1 int, y1 int, x2 int, y2 int")


def _rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_lines_of_few_and_many_blocks(spark):
    blocks = _boxes(spark, {p: p % 9 for p in range(30)} | {40: FEW + 40, 41: FEW}, "block_id", 1)
    lines = _boxes(spark, {p: 5 for p in range(33)} | {40: 90, 41: 70}, "line_id", 2)
    for threshold in (0.4, 0.0, 1.0):
        got, want = assign_lines(lines, blocks, threshold=threshold), _assigned_joined(lines, blocks, ["page"], threshold)
        assert got.schema.simpleString() == want.schema.simpleString() and _rows(got) == _rows(want)
    found = assign_lines(lines, blocks, threshold=0.2).filter("block_id is not null")
    hulls = {}
    old = {(b.page, b.block_id): tuple(b)[2:] for b in blocks.collect()}
    for r in found.collect():
        for x in ((r.x1, r.y1, r.x2, r.y2), old[r.page, r.block_id]):
            a = hulls.get((r.page, r.block_id), x)
            hulls[r.page, r.block_id] = (min(a[0], x[0]), min(a[1], x[1]), max(a[2], x[2]), max(a[3], x[3]))
    assert {(r.page, r.block_id): tuple(r)[2:] for r in block_hull(found, ["page", "block_id"], blocks).collect()} == hulls != {}


def test_hulls_on_small_pages_need_one_join(spark):
    blocks, lines = (_boxes(spark, {p: 5 for p in range(30)}, name, 3) for name in ("block_id", "line_id"))
    plan = block_hull(assign_lines(lines, blocks).filter("block_id is not null"), ["page", "block_id"], blocks)._jdf.queryExecution().optimizedPlan().toString()
    assert sum("Join " in row for row in plan.splitlines()) == 1
