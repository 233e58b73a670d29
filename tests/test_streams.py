"""Streams over several micro-batches: order, late rows, expiry, replay, crashes, compaction."""

import os
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from pagetext.operators.prefix import previous_row
from pagetext.streaming import events as E
from pagetext.streaming.delta_log import DeltaLog
from pagetext.streaming.keyed import fold_stream, keyed_state_store

START = datetime(2026, 1, 1)
EVENT = "run_id string, batch int, worker string, ts timestamp, event_id long, event string, stage string, returncode int"


def minutes(n):
    return START + timedelta(minutes=n)


def files(spark, path, parts, schema):
    """One file a micro-batch, in order."""
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{path}/in/{i}")
        for f in os.listdir(f"{path}/in/{i}"):
            os.utime(f"{path}/in/{i}/{f}", (1_000_000 + i, 1_000_000 + i))
    return lambda: spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{path}/in/*")


def state_rows(spark, path):
    return spark.read.format("statestore").option("stateVarName", "fold").load(path).count()


def run(spark, df, path):
    with keyed_state_store(spark):
        q = df.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(df.schema).parquet(f"{path}/out")


def test_stages_across_micro_batches(spark, tmp_path):
    ev = lambda m, i, e, r=0, w="cpu", run="a": (run, 1, w, minutes(m), i, e, "render", r)
    parts = [[ev(3, 3, "progress"), ev(1, 1, "stage_started"), ev(2, 2, "progress")],
             [ev(5, 5, "stage_finished", 1), ev(4, 4, "progress"), ev(2, 9, "chunk_ready")],  # the last one lies before what was handled
             [ev(6, 6, "progress"), ev(7, 7, "chunk_ready", w="translate"), ev(8, 8, "progress"), ev(1, 1, "stage_started", run="b")]]
    stream = files(spark, tmp_path, parts, EVENT)()
    got = sorted((r.run_id, r.event_id, r.open_stage, r.failed_stage) for r in run(spark, E.track_stages(stream), tmp_path).collect())
    assert got == [("a", 1, "render", None), ("a", 2, "render", None), ("a", 3, "render", None), ("a", 4, "render", None), ("a", 5, None, "render"), ("a", 6, None, "render"),
                   ("a", 7, None, None), ("a", 8, None, None), ("b", 1, "render", None)]
    assert state_rows(spark, f"{tmp_path}/state") == 2


def test_finished_runs_leave_no_state(spark, tmp_path):
    ev = lambda run, m, i: (run, 1, "cpu", minutes(m), i, "stage_started", "ocr", 0)
    parts = [[ev("a", 1, 1), ev("b", 2, 1)], [ev("b", 400, 2)], [ev("b", 401, 3)], [ev("a", 402, 4), ev("b", 403, 4)]]
    make = files(spark, tmp_path, parts, EVENT)
    out = run(spark, E.track_stages(make(), delay="1 minute", idle_ms=60 * 60 * 1000), tmp_path)
    assert out.count() == 6
    assert state_rows(spark, f"{tmp_path}/state") == 2  # a was forgotten and began anew, b went on
    late = files(spark, tmp_path / "late", parts[:2] + [[ev("a", 5, 9)], [ev("b", 404, 9)]], EVENT)
    out = run(spark, E.track_stages(late(), delay="1 minute", idle_ms=60 * 60 * 1000), tmp_path / "late")
    assert ("a", 9) not in {(r.run_id, r.event_id) for r in out.collect()}  # far behind the stream
    assert state_rows(spark, f"{tmp_path}/late/state") == 1


def test_fold_without_time(spark, tmp_path):
    make = files(spark, tmp_path, [[(1, 2), (1, 1)], [(1, 3), (1, 2), (2, 1)]], "k int, seq int")
    step = lambda saved, key, r: ((saved or 0) + r.seq, (key[0], r.seq, (saved or 0) + r.seq))
    got = run(spark, fold_stream(make(), ["k"], step, lambda r: (r.seq,), "k int, seq int, total int"), tmp_path)
    assert sorted(map(tuple, got.collect())) == [(1, 1, 1), (1, 2, 3), (1, 3, 6), (2, 1, 1)]


def versions(spark, path):
    rows = spark.read.parquet(f"{path}/delta").groupBy("__version").count().collect()
    return {r["__version"]: r["count"] for r in rows}


def test_delta_log(spark, tmp_path):
    frame = lambda rows: spark.createDataFrame(rows, "k int, v string")
    log = DeltaLog(spark, str(tmp_path), ["k"], frame([]).schema, parts=4, every=3)
    table = lambda **kw: sorted(map(tuple, log.read(**kw).collect()), key=str)
    assert table() == []
    log.write(frame([(0, "old"), (None, "n")]), -1)
    for version in range(5):
        log.write(frame([(version, f"v{version}"), (99, f"w{version}")]), version)
    want = sorted([(0, "v0"), (1, "v1"), (2, "v2"), (3, "v3"), (4, "v4"), (99, "w4"), (None, "n")], key=str)
    assert table() == want and log.base_before(None) == 2 and log.base_before(2) is None
    assert table(before=2) == sorted([(0, "v0"), (1, "v1"), (99, "w1"), (None, "n")], key=str)
    assert versions(spark, tmp_path) == {-1: 2, 0: 2, 1: 2, 2: 2, 3: 2, 4: 2}  # only what changed
    log.write(frame([(2, "v2"), (99, "w2")]), 2)  # the version of the base again
    assert table() == want
    some = log.read(like=frame([(3, "")])).collect()
    assert (3, "v3") in {tuple(r) for r in some} and len(some) < len(want)
    DeltaLog(spark, str(tmp_path), ["k"], frame([]).schema, parts=4, every=3).write(frame([(4, None)]), 4)  # another driver
    assert table() == sorted([*[w for w in want if w[0] not in (4, 99)], (4, None), (99, "w3")], key=str)


def test_upsert_resumes_after_a_crash(spark, tmp_path):
    make = files(spark, tmp_path, [[(1, "a"), (2, "a")], [(2, "b")], [(3, "c"), (1, "c")]], "k int, v string")
    counted = lambda: make().groupBy("k").agg(F.count("*").alias("n"), F.max("v").alias("v"))
    log = DeltaLog(spark, f"{tmp_path}/table", ["k"], counted().schema, every=2)

    class Dying(DeltaLog):
        def write(self, rows, version):
            super().write(rows, version)
            if version == 1:
                raise RuntimeError("killed")

    with pytest.raises(Exception, match="killed"):
        E.upsert_stream(counted(), Dying(spark, f"{tmp_path}/table", ["k"], counted().schema, every=2), f"{tmp_path}/state")
    E.upsert_stream(counted(), log, f"{tmp_path}/state")
    assert sorted(map(tuple, log.read().collect())) == [(1, 2, "c"), (2, 2, "b"), (3, 1, "c")]
    assert versions(spark, f"{tmp_path}/table") == {0: 2, 1: 1, 2: 2}


def test_publish_stream_replay(spark, tmp_path):
    pages = spark.createDataFrame([(i, f"o{i}", None) for i in range(6)], "page int, output_name string, output_sha256 string")
    make = files(spark, tmp_path, [[(p, k, f"h{p}") for p in range(k * 3, k * 3 + 3)] for k in range(2)], "page int, batch int, sha256 string")
    target, manifest = E.page_log(spark, f"{tmp_path}/t"), E.manifest_log(spark, f"{tmp_path}/m")
    target.write(spark.createDataFrame([("o4", "foreign", 4, -1)], "output_name string, sha256 string, page int, batch int"), -1)
    manifest.write(pages, -1)
    for checkpoint in ("c1", "c2"):  # a lost checkpoint replays everything
        E.publish_stream(make(), manifest, target, f"{tmp_path}/conflicts", f"{tmp_path}/{checkpoint}")
        assert sorted((r.page, r.sha256) for r in target.read().collect()) == [(p, "foreign" if p == 4 else f"h{p}") for p in range(6)]
        assert {r.page: r.output_sha256 for r in manifest.read().collect()} == {p: None if p == 4 else f"h{p}" for p in range(6)}
        assert [r.output_name for r in spark.read.parquet(f"{tmp_path}/conflicts").collect()] == ["o4"]

def test_trailing_repeats_shuffle_only_the_ends(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, k, rng.choice(["a", "b", " b ", "", None, "  "]) if k < 300 + i * 7 else "z") for i in range(12) for k in range(300 + i * 9)]
    rows += [(50, k, "x") for k in range(700)] + [(51, k, str(k)) for k in range(700)] + [(52, 0, None)]
    want = {}
    for reply, _, piece in rows:
        if piece:
            token, (last, n) = piece.strip(" "), want.get(reply, (None, 0))
            want[reply] = (token, n + 1 if token == last else 1)
    handed = []
    monkeypatch.setattr(E, "previous_row", lambda d, *more: (handed.append(d.count()), previous_row(d, *more))[1])
    for shuffled in (False, True):
        listed = rng.sample(rows, len(rows)) if shuffled else rows
        d = spark.createDataFrame(listed, "reply long, seq int, piece string").repartition(7) if shuffled else spark.createDataFrame(listed, "reply long, seq int, piece string")
        got = {r.reply: (r.run, r.looping) for r in E.trailing_repeats(d, repeats=20).collect()}
        assert got == {reply: (n, n >= 20) for reply, (_, n) in want.items()}
    assert handed[0] < 2500 < 5000 < len(rows)  # the long final runs and a few more
