from collections import defaultdict

from pyspark.sql import functions as F

from pagetext.llm import mixing as M
from pagetext.llm.common import prefix_sums, running_totals


def fill(sizes, weights, cap=3):
    """Water-filling by repeated sharing."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    target, full = {}, set()
    while True:
        rest, share = sum(sizes.values()) - sum(cap * sizes[s] for s in full), sum(w[s] for s in names if s not in full)
        target = {s: cap * sizes[s] if s in full else rest * w[s] / share for s in names}
        over = {s for s in names if s not in full and target[s] > cap * sizes[s]}
        if not over:
            return target
        full |= over


def test_targets_and_cuts(docs, doc_rows):
    rows = M.mix_sources(docs).collect()
    assert len(rows) == len(doc_rows)
    sizes = defaultdict(int)
    for r in doc_rows:
        sizes[r[3]] += len((r[1] or "").split())
    target = fill(sizes, (1, 2, 3))
    taken = defaultdict(int)
    for r in rows:
        assert r.source_size == sizes[r.source] and abs(r.target - target[r.source]) < 1e-6 * max(1, target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] += r.taken
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in sizes)
    assert any(abs(target[s] - 3 * sizes[s]) < 1e-9 for s in sizes if sizes[s])  # a small source stops at its cap


def test_reruns_agree(docs):
    once = sorted(map(str, M.mix_sources(docs).collect()))
    assert once == sorted(map(str, M.mix_sources(docs.repartition(3)).collect()))
    assert once != sorted(map(str, M.mix_sources(docs, seed="other").collect()))


def test_repeated_rows_of_the_mix(docs, doc_rows):
    got = M.repeat_to_mix(docs)
    assert got.columns == docs.columns
    target = fill({s: sum(len((r[1] or "").split()) for r in doc_rows if r[3] == s) for s in {r[3] for r in doc_rows}}, (1, 2, 3))
    words, times = defaultdict(int), defaultdict(int)
    for r in got.collect():
        words[r.source] += len(r.text.split())
        times[r.doc_id, r.text] += 1
    largest = {s: max(len((r[1] or "").split()) for r in doc_rows if r[3] == s) for s in target}
    assert all(abs(words[s] - target[s]) <= largest[s] for s in target)
    assert max(n for (i, _), n in times.items() if i != 3) <= 3 and not [1 for i, t in times if not t or not t.split()]


def test_rows_without_or_with_one_id_are_cut_one_by_one(spark):
    rows = [(None if i % 3 == 0 else 7 if i % 3 == 1 else i, f"w{i} " * 20, s) for s in "ab" for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string").repartition(4)
    target = fill({"a": 1800, "b": 1800}, (1, 2))
    got = M.repeat_to_mix(docs, weights=(1, 2)).collect()
    for s in "ab":
        mine = [r for r in got if r.source == s]
        assert abs(20 * len(mine) - target[s]) <= 20
        # Each kind of row is taken in part: no kind stands or falls as a whole.
        kinds = [len({r.text for r in mine if kind(r.doc_id)}) for kind in (lambda i: i is None, lambda i: i is not None and i != 7)]
        assert s == "b" or all(0 < n < 30 for n in kinds)


def test_empty(no_docs):
    assert M.mix_sources(no_docs).count() == 0 and M.repeat_to_mix(no_docs).count() == 0


def test_running_totals_split_equal_rows(spark):
    d = spark.range(0, 4000, 1, 8).select(F.lit("hot").alias("g"), F.lit(1).alias("o"), F.lit(2).cast("long").alias("v"))
    out = running_totals(d, ["g"], ["o"], {"s": F.col("v")})
    assert sorted(r.s for r in out.collect()) == list(range(2, 8002, 2))


def test_prefix_sums(spark):
    for n in (0, 1, 5, 256, 257, 1000):
        got = spark.range(1).select(prefix_sums(F.sequence(F.lit(1), F.lit(n)) if n else F.array().cast("array<int>")).alias("p")).first().p
        assert got == [i * (i + 1) // 2 for i in range(n)]
