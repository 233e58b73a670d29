"""Token-budget windows, rolling history and streams against plain Python."""

import random
from itertools import accumulate, dropwhile

import pytest
from pyspark.sql import functions as F

from pagetext.operators import context as X
from pagetext.operators import prefix as P
from pagetext.operators import replies as R
from pagetext.operators.prefix import prefix_scan, previous_row
from pagetext.streaming import events as E
from pagetext.streaming import history as H


def pages_of(seed):
    rnd = random.Random(seed)
    rows = []
    for project in range(8):
        for page in range(rnd.randint(1, 60)):
            rows.append((project, page, rnd.choice([0, 1, 5, 20, 40, 90, 200]) + rnd.randint(0, 9), int(rnd.random() > 0.15), rnd.random() > 0.2))
    return rows


SCHEMA = "project int, page long, tokens long, complete int, requested boolean"


def suffix(rows, page, budget, reserved):
    """Newest complete pages first: drop oversize ones, then one big page alone or all within the running sum."""
    low, high = max(0, budget // 2 - reserved), max(0, budget - reserved)
    newest = [(p, t) for _, p, t, ok, _ in sorted(rows, key=lambda r: -r[1]) if p < page and ok]
    newest = list(dropwhile(lambda x: x[1] > high, newest))
    if newest and newest[0][1] > low:
        return newest[:1]
    sums = accumulate(t for _, t in newest)
    return [x for x, total in zip(newest, sums) if total <= low][::-1]


@pytest.mark.parametrize("budget,reserved", [(200, 0), (120, 30), (60, 40), (10, 10)])
def test_history_suffix(spark, budget, reserved):
    rows = pages_of(budget)
    got = {(r.project, r.request_page, r.page, r.tokens) for r in X.history_suffix(spark.createDataFrame(rows, SCHEMA), budget, reserved).collect()}
    want = {(pr, r[1], p, t) for pr in range(8) for mine in [[x for x in rows if x[0] == pr]] for r in mine for p, t in suffix(mine, r[1], budget, reserved)}
    assert got == want


@pytest.mark.parametrize("budget", [0, 90, 400])
def test_fit_summaries(spark, budget):
    rows = pages_of(3)
    got = {(r.project, r.request_page, r.page) for r in X.fit_summaries(spark.createDataFrame(rows, SCHEMA), budget).collect()}
    want = set()
    for r in rows:
        total = r[2]
        want.add((r[0], r[1], r[1]))
        for o in reversed([x for x in rows if x[0] == r[0] and x[1] < r[1]]):
            total += o[2]
            if total > budget:
                break
            want.add((r[0], r[1], o[1]))
    assert got == want


def rolling_twin(rows, budget, reserved):
    """The rule told once more, on whole lists."""
    low, high, out = max(0, budget // 2 - reserved), max(0, budget - reserved), []
    for pr in sorted({r[0] for r in rows}):
        mine, win, asked = [r for r in rows if r[0] == pr], None, None
        for i, r in enumerate(mine):
            if not r[4]:
                continue
            prev = mine[i - 1] if i else None
            why = "window-empty" if win is None else "non-adjacent" if prev is None or prev[1] != asked else None if prev[3] else "previous-ineligible"
            if why:
                win = [t for _, t in suffix(mine, r[1], budget, reserved)]
                row = ("rebuild" if win else "empty", why, 0, 0)
            elif prev[2] > high:
                cut = 0
                if sum(win) > high:
                    while win and sum(win) > low:
                        win, cut = win[1:], cut + 1
                row = ("evict" if cut else "reuse", "oversized-page", 0, cut)
            elif sum(win) + prev[2] <= high:
                win, row = win + [prev[2]], ("grow", None, 1, 0)
            else:
                cut = 0
                while win and sum(win) + prev[2] > low:
                    win, cut = win[1:], cut + 1
                win, row = win + [prev[2]], ("evict", None, 1, cut)
            asked = r[1]
            out.append((pr, r[1], *row[:2], len(win), sum(win) + reserved, *row[2:]))
    return out


@pytest.mark.parametrize("budget,reserved", [(200, 0), (120, 30), (60, 40)])
def test_rolling_history_batch_equals_rule(spark, budget, reserved):
    rows = pages_of(budget + 1)
    got = sorted(tuple(r) for r in H.rolling_history(spark.createDataFrame(rows, SCHEMA), budget, reserved).collect())
    assert got == sorted(rolling_twin(rows, budget, reserved))


def test_rolling_history_stream_equals_rule(spark, tmp_path):
    rows = pages_of(11)
    d = spark.createDataFrame(rows, SCHEMA)
    for k in range(3):  # three files in page order, so that state crosses micro-batches
        d.filter(f"page >= {k * 20} and page < {k * 20 + 20}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / f"b{k}"))
    stream = spark.readStream.schema(SCHEMA).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    got = sorted(tuple(r) for r in E.run_available(H.stream_history(stream, 120, 10), "h").collect())
    assert got == sorted(rolling_twin(rows, 120, 10))


@pytest.mark.parametrize("whole", [0, 100, 1000])
def test_scans_of_short_and_large_keys(spark, monkeypatch, whole):
    """Keys above the bound are scanned in ranges, the others by a window; nulls and previous rows included."""
    monkeypatch.setattr(P, "WHOLE", whole)
    test_prefix_scan_and_previous_row(spark)
    d = spark.createDataFrame([(1, 1, None), (1, 2, 5), (1, 3, None), (2, 1, None)], "k int, i int, v int")
    s = prefix_scan(d, ["k"], [F.col("i")], sums={"s": F.col("v")}, maxes_before={"m": F.col("v")})
    got = {(r.k, r.i): (r.m, r.p) for r in previous_row(s, ["k"], [F.col("i")], F.col("v"), "p").collect()}
    assert got == {(1, 1): (None, None), (1, 2): (None, None), (1, 3): (5, 5), (2, 1): (None, None)}


def test_prefix_scan_and_previous_row(spark):
    """One key holds most of the rows."""
    rnd = random.Random(9)
    rows = [(k, i, rnd.randint(0, 50)) for k in range(4) for i in rnd.sample(range(100000), 200 if k == 0 else 5)]
    d = spark.createDataFrame(rows, "k int, i int, v int")
    s = prefix_scan(d, ["k"], [F.col("i")], number="n", sums={"s": F.col("v")}, maxes_before={"m": F.col("v")})
    got = {(r.k, r.i): (r.n, r.s, r.m, r.p) for r in previous_row(s, ["k"], [F.col("i")], F.col("v"), "p").collect()}
    for k in range(4):
        mine = sorted(r for r in rows if r[0] == k)
        for j, r in enumerate(mine):
            before = [x[2] for x in mine[:j]]
            assert got[k, r[1]] == (j + 1, sum(before) + r[2], max(before) if before else None, before[-1] if before else None)


def test_reply_shapes(spark):
    cases = [('{"1":"x","2":"y"}', 2, [(1, "x"), (2, "y")], None), ('pre {"translations":{"1":"x"},"page_summary":" a  b "} post', 1, [(1, "x")], None),
             ('{"translations":[{"id":2,"translation":"b"},{"id":1,"translation":"a"}]}', 2, [(1, "a"), (2, "b")], None),
             ('{"translations":[{"id":1,"translation":"b"},{"id":1,"translation":"a"}]}', 1, [], "duplicate_id"), ('{"1":"x"}', 2, [], "wrong_ids"), ("{oops}", 1, [], "invalid_json"),
             ('{"page_summary":"s"}', 0, [], None), ('{"page_summary":7}', 0, [], "no_summary"), ('{"a":"x"}', 1, [], "unsupported_payload"), ("```json\n{\"1\":\"x\"}\n```", 1, [(1, "x")], None)]
    d = spark.createDataFrame([(i, c[0], c[1]) for i, c in enumerate(cases)], "k int, content string, expected int")
    rows, summaries, bad = R.parse_replies(d, ["k"])
    got = {}
    for r in rows.collect():
        got.setdefault(r.k, []).append((r.id, r.text))
    why = {r.k: r.reason for r in bad.collect()}
    for i, c in enumerate(cases):
        assert sorted(got.get(i, [])) == c[2] and why.get(i) == c[3], (c, got.get(i), why.get(i))
    assert {r.k: r.summary for r in summaries.collect()} == {1: "a b", 6: "s"}


def test_batch_functions(spark):
    d = spark.createDataFrame([(1, i, f"t{i}" if i % 4 else "") for i in range(1, 41)] + [(2, 1, "loop"), (2, 2, "boom")], "page int, source_id int, text string")
    ok, bad = R.apply_batch_fn(d, lambda ts: [t + "!" for t in ts], batch_rows=7)
    assert ok.count() == 42 and bad.count() == 0 and ok.filter("result <> concat(text, '!')").count() == 0

    def flaky(ts):
        if "boom" in ts:
            raise RuntimeError
        return ["x" * 50 if t == "loop" else t.upper() for t in ts]

    out = {(r.page, r.source_id): (r.result, r.how) for r in R.retry_by_row(d.filter("text <> ''"), flaky).collect()}
    assert out[2, 1] == ("loop", "source") and out[2, 2] == ("boom", "source") and out[1, 1] == ("T1", "batch")
    routed, _ = R.route_non_empty(d.filter("page = 1"), lambda ts: [t[::-1] for t in ts])
    assert routed.count() == 40 and routed.filter("text = '' and result = ''").count() == 10
