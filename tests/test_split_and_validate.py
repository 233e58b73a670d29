import random

from pagetext.operators import order as O
from pagetext.operators import prefix
from pagetext.operators import quality as Q


def joins(df):
    return str(df._jdf.queryExecution().optimizedPlan()).count("Join ")


def test_blocks_are_split_in_one_order(spark, monkeypatch):
    """Ordinary blocks need no join; large ones, which go by ranges, are cut alike."""
    rng = random.Random(5)
    rows = [(page, 1 + n % 2, n, x, y, x + 20, y + 10, rng.randrange(5, 30), rng.random() < 0.7, float(x + y))
            for page in range(6) for n in range(60) for x, y in [(rng.randrange(200), rng.randrange(200))]]
    lines = spark.createDataFrame(rows, "page int, block_id int, line_id int, x1 int, y1 int, x2 int, y2 int, font_size int, vertical boolean, distance double")
    d = O.split_blocks(lines)
    assert joins(d) == 0
    want = sorted((r.page, r.block_id, r.line_id, r.part) for r in d.collect())
    assert len(want) == 360 and max(w[3] for w in want) > 3
    monkeypatch.setattr(prefix, "WHOLE", 10)
    assert sorted((r.page, r.block_id, r.line_id, r.part) for r in O.split_blocks(lines).collect()) == want


def test_blocks_without_an_id_are_rejected(spark, monkeypatch):
    rows = [(1, None, "a"), (1, 2, "b"), (1, 2, "c"), (2, 1, "d"), (2, None, "e"), (2, None, "f")]
    df = spark.createDataFrame([(p, b, 0, 0, 5, 5, t) for p, b, t in rows], "page int, block_id int, x1 int, y1 int, x2 int, y2 int, text string")
    want = {"a": ["bad_id"], "b": ["duplicate_id"], "c": ["duplicate_id"], "e": ["bad_id", "duplicate_id"], "f": ["bad_id", "duplicate_id"]}
    for most in (prefix.WHOLE, 2):
        monkeypatch.setattr(prefix, "WHOLE", most)
        valid, rejects = Q.validate_blocks(df)
        assert [r.text for r in valid.collect()] == ["d"] and {r.text: r.reasons for r in rejects.collect()} == want


def test_dealt_blocks_are_the_blocks_in_more_tasks(spark, monkeypatch):
    from pagetext.catalog import views

    few = int(spark.conf.get("spark.sql.shuffle.partitions"))
    v = views.Views(spark, "/root/testdata/sf0.001")
    assert v.dealt_blocks is v.blocks  # a small table is left to the shuffle partitions
    monkeypatch.setattr(views, "ROWS", v.lineitem.count() // (few + 20))
    d = views.Views(spark, "/root/testdata/sf0.001").dealt_blocks
    assert d.rdd.getNumPartitions() >= few + 20
    assert d.exceptAll(v.blocks).isEmpty() and v.blocks.exceptAll(d).isEmpty()
