"""Event streams: live progress, resources, attempts, deduplication, stages, repeats, publishing.

The surveyed event log has no event time. Event time, watermarks and windows are added here.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.operators.prefix import previous_row
from pagetext.session import cut_lineage
from pagetext.sources.sinks import plan_publish, scratch_dir
from pagetext.streaming.delta_log import DeltaLog
from pagetext.streaming.keyed import fold_stream, keyed_state_store

GIB = 1 << 30
DAY_MS = 24 * 3600 * 1000


def _by_time(r) -> tuple:
    """Place of an event in its key's order."""
    return r["__at"], r["event_id"]


def run_available(df: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is available now and read its output back (exactly-once file sink, shared folder)."""
    spark = df.sparkSession
    out = scratch_dir(spark, name)
    with keyed_state_store(spark):
        started = (df.writeStream.format("parquet").outputMode(mode).option("path", out + "/data").option("checkpointLocation", out + "/state")
                   .trigger(availableNow=True).start())
    started.awaitTermination()
    return spark.read.schema(df.schema).parquet(out + "/data")


def upsert_stream(df: DataFrame, log: DeltaLog, checkpoint: str) -> None:
    """Run a stream in update mode over what is available into a keyed log; each micro-batch writes only the keys it changed.

    A micro-batch that is run again, also by a new driver after a crash, replaces its own version.
    """
    (df.writeStream.outputMode("update").foreachBatch(log.write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())


def run_upsert(df: DataFrame, name: str, keys: list[str]) -> DataFrame:
    """Run a stream over what is available and read its table back: the last row of every key, open windows included."""
    out = scratch_dir(df.sparkSession, name)
    log = DeltaLog(df.sparkSession, out + "/table", keys, df.schema)
    upsert_stream(df, log, out + "/state")
    return log.read()


def live_progress(events: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Event counts per batch and tumbling window."""
    d = events.withWatermark("ts", delay).groupBy(F.window("ts", window).alias("w"), "batch", "event").agg(F.count(F.lit(1)).alias("n"))
    return d.select(F.col("w.start").alias("window_start"), "batch", "event", "n")


def resource_monitor(samples: DataFrame, window: str = "1 hour", slide: str = "30 minutes", delay: str = "10 minutes", stop: float = 4 * GIB, wait: float = 6.5 * GIB) -> DataFrame:
    """Smallest free memory per job and sliding window with the decision: stop, wait or run."""
    d = samples.withWatermark("ts", delay).groupBy(F.window("ts", window, slide).alias("w"), "job_id").agg(F.min("value").alias("min_available"))
    choice = F.when(F.col("min_available") < stop, "stop").when(F.col("min_available") < wait, "wait").otherwise("run")
    return d.select(F.col("w.start").alias("window_start"), "job_id", "min_available", choice.alias("decision"))


CHAIN_OUT = "label string, event_id long, chain int, attempt int, level int, outcome string"


def attempt_chains(attempts: DataFrame, most: int = 3, delay: str = "1 hour", idle_ms: int = DAY_MS) -> DataFrame:
    """Every attempt with its place in a chain of retries: (label, event_id, chain, attempt, level, outcome).

    attempts: label, ts, event_id, failure_kind (null = success). A success ends its chain (``done``), so does the third failure
    (``failed``); other failures are followed by a ``retry``. ``level`` is the recovery level of the attempt: a repetition loop
    raises that of the next attempt, to at most 2; a new chain starts at 0. Attempts before the last one handled, or more than ``delay``
    behind the stream, are late and left out; a label is forgotten ``idle_ms`` after its last attempt.
    """

    def step(saved, key: tuple, r) -> tuple:
        chain, attempt, level = saved or (1, 0, 0)
        attempt += 1
        outcome = "done" if r.failure_kind is None else "failed" if attempt == most else "retry"
        made = (key[0], r.event_id, chain, attempt, level, outcome)
        if outcome == "retry":
            return (chain, attempt, min(level + (r.failure_kind == "repetition_loop"), 2)), made
        return (chain + 1, 0, 0), made

    return fold_stream(attempts, ["label"], step, _by_time, CHAIN_OUT, "ts", delay, idle_ms)


def attempt_sessions(attempts: DataFrame, gap: str = "30 minutes", delay: str = "10 minutes") -> DataFrame:
    """Attempts of one label grouped by pauses: counts, outcome and recovery level.

    attempts: ts, label, failure_kind (null = success). Three failures without a success end in ``failed``; every
    repetition loop raises the level, to at most 2.
    """
    c = F.col
    d = attempts.withWatermark("ts", delay).groupBy(F.session_window("ts", gap).alias("w"), "label").agg(
        F.count(F.lit(1)).alias("attempts"), F.count("failure_kind").alias("failures"), F.count_if(c("failure_kind") == "repetition_loop").alias("loops"))
    outcome = F.when(c("failures") < c("attempts"), "done").when(c("failures") >= 3, "failed").otherwise("open")
    return d.select(c("w.start").alias("session_start"), "label", "attempts", "failures", outcome.alias("outcome"), F.least("loops", F.lit(2).cast("long")).alias("level"))


def dedupe_issues(events: DataFrame, completed: DataFrame, delay: str | None = None) -> DataFrame:
    """One page failure per page; non-live failures of pages verified complete are dropped. completed: page.

    Without ``delay`` a page is remembered for good (one id of state per failed page); with it only as long as the watermark.
    """
    d = events.filter("event in ('page_failed', 'page_review_required')")
    d = d.withWatermark("ts", delay) if delay else d
    known = completed.select("page", F.lit(True).alias("complete")).distinct()
    d = d.join(known, "page", "left").filter(F.col("live") | F.col("complete").isNull()).drop("complete")
    return d.dropDuplicatesWithinWatermark(["page"]) if delay else d.dropDuplicates(["page"])


STAGE_OUT = "run_id string, batch int, worker string, event_id long, event string, open_stage string, failed_stage string"


def track_stages(events: DataFrame, delay: str = "1 hour", idle_ms: int = DAY_MS) -> DataFrame:
    """Open and failed stage of every (run, batch, worker) after each event. A restart is a new ``run_id``.

    events: run_id, batch, worker, ts, event_id, event, stage, returncode. ``chunk_ready`` clears the failures of all
    workers of its batch. Events before the last one handled of their batch, or more than ``delay`` behind the stream, are late and left
    out; a batch is forgotten ``idle_ms`` after its last event, so finished runs leave no state.
    """

    def step(saved, key: tuple, r) -> tuple:
        opened, failed = saved or ({}, {})
        if r.event == "stage_started":
            opened[r.worker] = r.stage
            failed.pop(r.worker, None)
        elif r.event == "stage_finished":
            opened.pop(r.worker, None)
            failed.pop(r.worker, None)
            if r.returncode:
                failed[r.worker] = r.stage
        elif r.event == "chunk_ready":
            failed.clear()
        return (opened, failed), (*key, r.worker, r.event_id, r.event, opened.get(r.worker), failed.get(r.worker))

    return fold_stream(events, ["run_id", "batch"], step, _by_time, STAGE_OUT, "ts", delay, idle_ms)


GUARD_OUT = "reply long, seq long, run int, looping boolean"


def repeat_guard(chunks: DataFrame, repeats: int = 31) -> DataFrame:
    """Running count of identical consecutive chunks of each reply: (reply, seq, run, looping). chunks: reply, seq, piece.

    Chunks have no event time, so a reply's last chunk and count are kept; a chunk before the last one handled is late and left out.
    """

    def step(saved, key: tuple, r) -> tuple:
        last, run = saved or (None, 0)
        token = (r.piece or "").strip()
        if r.piece:
            run, last = (run + 1 if token == last else 1), token
        return (last, run), (key[0], r.seq, run, run >= repeats)

    return fold_stream(chunks, ["reply"], step, lambda r: (r.seq,), GUARD_OUT)


def _ends(chunks: DataFrame) -> DataFrame:
    """(reply, seq, token) without the rows that no trailing run can hold: of the rows of a reply in an Arrow batch, the last run and the row before it stay.

    That row and the run differ, so one of them differs from the chunk that ends the reply, and the reply's run begins behind it, whatever other
    batches hold. Rows of a reply that come together shrink to a few, in any order and however they are dealt the result is the same.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in filter(len, batches):
            reply, token = (b.column(k).dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False) for k in (0, 2))
            place = pc.rank(b.column(1), "ascending", null_placement="at_start", tiebreaker="dense").to_numpy(zero_copy_only=False)
            order = np.lexsort((place, reply))
            reply, token = reply[order], token[order]
            first = np.append(True, reply[1:] != reply[:-1])
            starts = np.flatnonzero(first | np.append(True, token[1:] != token[:-1]))
            final = np.append(first[starts[1:]], True)  # runs that end their reply here
            ends = np.append(starts[1:], len(order))[final]
            begins = starts[final] - ~first[starts[final]]
            inside = np.zeros(len(order) + 1, np.int64)
            np.add.at(inside, begins, 1)
            np.add.at(inside, ends, -1)
            stay = np.empty(len(order), bool)
            stay[order] = np.cumsum(inside[:-1]) > 0
            yield b.filter(pc.or_(pa.array(stay), b.column(1).is_null()))

    d = chunks.select("reply", "seq", F.trim("piece").alias("token"))
    return d.mapInArrow(run, d.schema)


def trailing_repeats(chunks: DataFrame, repeats: int = 31) -> DataFrame:
    """Batch twin: length of the run of identical chunks that ends each reply, from the last change of chunk.

    Only the ends of replies are shuffled, see ``_ends``.
    """
    c = F.col
    d = cut_lineage(_ends(chunks.filter(F.coalesce("piece", F.lit("")) != "")))
    d = previous_row(d, ["reply"], [c("seq")], c("token"), "before").withColumn("changed", ~c("token").eqNullSafe(c("before")))
    last = d.filter("changed").groupBy("reply").agg(F.max("seq").alias("from_seq"))
    n = d.join(last, "reply").filter("seq >= from_seq").groupBy("reply").agg(F.count(F.lit(1)).alias("run"))
    return n.withColumn("looping", c("run") >= repeats)


def page_log(spark: SparkSession, target: str, more: str = "batch int") -> DeltaLog:
    """What lies at a destination: the latest content of every output, with the page and ``more`` columns it came with."""
    schema = spark.createDataFrame([], f"output_name string, sha256 string, page bigint, {more}").schema
    return DeltaLog(spark, f"{target}/pages", ["output_name"], schema)


def manifest_log(spark: SparkSession, path: str) -> DeltaLog:
    return DeltaLog(spark, path, ["page"], spark.createDataFrame([], "page bigint, output_name string, output_sha256 string").schema)


def publish_stream(finished: DataFrame, manifest: DeltaLog, target: DeltaLog, conflicts_path: str, checkpoint: str) -> None:
    """Publish every micro-batch of verified pages (page, sha256 and the further columns of ``target``), idempotent on replay.

    What lies at the destination is read there: an output holding neither the new nor the recorded content is a conflict, stays as it is
    and goes to ``conflicts_path`` under the batch id. Manifest and destination are keyed logs whose earlier content has versions below 0: a micro-batch
    reads the folders of its own pages, below its own version, and writes only what it changes.
    """

    def publish(df: DataFrame, batch_id: int) -> None:
        known = manifest.read(before=batch_id, like=df.select("page")).join(df.select("page"), "page", "left_semi")
        there = target.read(before=batch_id, like=known.select("output_name")).select("output_name", F.col("sha256").alias("existing_sha256"))
        writes, conflicts, after = plan_publish(df.select("page", "sha256"), known, there)
        target.write(df.join(writes.select("page", "output_name"), "page"), batch_id)
        conflicts.write.mode("overwrite").parquet(f"{conflicts_path}/batch={batch_id}")
        manifest.write(after, batch_id)

    (finished.writeStream.foreachBatch(publish).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination())
