"""Run-level plans: incremental runs, review gate, diagnosis, reading reviews, context requests."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetext.functions import text as tx
from pagetext.operators import context as X
from pagetext.operators import ledger as L
from pagetext.operators import replies as R
from pagetext.operators.prefix import prefix_scan


def incremental_run(pages: DataFrame, status: DataFrame, previous: DataFrame, requests: DataFrame, cache: DataFrame, process: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Skip finished pages, reuse cached replies, process the rest, merge: (page, content, origin).

    previous: page, content; requests/cache as in ``reuse_responses``; ``process`` gets the missing (page,
    payload_hash) and returns (page, content).
    """
    todo = L.unfinished(pages, status).select("page")
    asked = L.reuse_responses(requests.join(todo, "page", "left_semi"), cache)
    hits = asked.filter("reason is null").select("page", "content", F.lit("cache").alias("origin"))
    fresh = process(asked.filter("reason is not null").select("page", "payload_hash")).select("page", "content", F.lit("processed").alias("origin"))
    done = hits.unionByName(fresh)
    return L.merge_projects(previous.join(todo, "page", "left_anti").select("page", "content", F.lit("kept").alias("origin")), done)


def review_gate(records: DataFrame, blocks: DataFrame, status: DataFrame, images: DataFrame, receipts: DataFrame, digests: DataFrame) -> DataFrame:
    """Whether each reviewed page may be published: (page, status, publishable, reason).

    records: page, status, sealed_digest; blocks: page, block_id, confirmed; status: page, state; images: page,
    sha256; receipts: page, output_sha256; digests: page, digest of the page's rows now. A pending page is never
    publishable; an approved one needs every block confirmed and all hashes equal.
    """
    c = F.col
    conf = blocks.groupBy("page").agg(F.bool_and("confirmed").alias("all_confirmed"))
    st = status.groupBy("page").agg(F.bool_or(c("state") == "completed").alias("completed"), F.bool_or(c("state") == "failed").alias("failed"), F.bool_or(c("state") == "review").alias("in_review"))
    im = images.groupBy("page").agg(F.count(F.lit(1)).alias("n_images"), F.min("sha256").alias("image_sha"))
    d = records
    for other in (conf, st, im, receipts.select("page", "output_sha256"), digests.select("page", "digest")):
        d = d.join(other, "page", "left")
    d = d.fillna(False, ["all_confirmed", "completed", "failed", "in_review"]).fillna(0, ["n_images"])
    changed = ~c("digest").eqNullSafe(c("sealed_digest"))
    image_bad = (c("n_images") != 1) | ~c("image_sha").eqNullSafe(c("output_sha256"))
    reason = (F.when(~c("status").isin("pending", "approved_preview", "applied"), "unknown_status")
              .when((c("status") == "pending") & ~c("in_review"), "missing_review_state")
              .when((c("status") == "pending") & (c("completed") | (c("n_images") > 0)), "pending_but_published")
              .when((c("status") == "pending") & changed, "rows_changed")
              .when(c("status") == "pending", "waiting")
              .when(c("failed") | c("in_review"), "conflicting_state")
              .when(c("output_sha256").isNull(), "missing_receipt")
              .when((c("status") == "approved_preview") & ~c("all_confirmed"), "unconfirmed_blocks")
              .when((c("status") == "approved_preview") & changed, "rows_changed")
              .when(image_bad, "image_differs")
              .when(~c("completed"), "not_completed"))
    return d.select("page", "status", reason.isNull().alias("publishable"), reason.alias("reason"))


def crop_text_review(readings: DataFrame) -> DataFrame:
    """Adopt a new reading only if two independent ones agree and are not empty; otherwise review or unchanged.

    readings: page, block_id, text, padded, unpadded, has_candidate, suspicious. Nothing but the text changes.
    """
    c = F.col
    agree = F.coalesce((c("padded") != "") & (c("padded") == c("unpadded")), F.lit(False))
    fix = c("has_candidate") & agree & ~c("padded").eqNullSafe(c("text"))
    status = F.when(fix, "corrected").when(c("has_candidate") & ~agree, "needs_review").when(~c("has_candidate") & c("suspicious"), "needs_review").otherwise("unchanged")
    reason = (F.when(fix, "complete_crop_and_2px_agree").when(c("has_candidate") & agree, "complete_crop_matches_original_text")
              .when(c("has_candidate"), "complete_crop_readings_disagree").when(c("suspicious"), "no_candidate"))
    return readings.withColumns({"new_text": F.when(fix, c("padded")).otherwise(c("text")), "status": status, "reason": reason})


def stage_at_events(events: DataFrame) -> DataFrame:
    """Events with ``open_stage``: the stage open for their (batch, worker) just before them, null if none.

    A start opens, a finish closes, ``folder_started`` resets its job (``epoch`` counts these per ``job_id``, if there is one). Batch twin of the
    stream tracker.
    """
    c = F.col
    d = prefix_scan(events.withColumn("__job", _job(events)), ["__job"], [c("ts"), c("event_id")], sums={"epoch": (c("event") == "folder_started").cast("int")})
    mark = F.when(c("event").isin("stage_started", "stage_finished"), F.struct("ts", "event_id", F.when(c("event") == "stage_started", c("stage")).alias("s")))
    d = prefix_scan(d, ["__job", "epoch", "batch", "worker"], [c("ts"), c("event_id")], maxes_before={"__last": mark})
    return d.withColumn("open_stage", c("__last.s")).drop("__last", "__job")


def _job(events: DataFrame) -> Column:
    """The job of an event; events without ``job_id`` belong to one job, 0."""
    return F.col("job_id") if "job_id" in events.columns else F.lit(0)


def failed_stages(events: DataFrame) -> DataFrame:
    """Stages that ended with a non-zero code and were not started, finished well or cleared since: (job_id, epoch, batch, worker, stage).

    ``chunk_ready`` clears a batch of its own job and epoch only; jobs may share batches and workers. Without ``job_id`` all events are of job 0;
    rows whose job, batch or worker is null take no part.
    """
    c = F.col
    d = stage_at_events(events).withColumn("job_id", _job(events))
    cleared = d.filter("event = 'chunk_ready'").groupBy("job_id", "epoch", "batch").agg(F.max(F.struct("ts", "event_id")).alias("cleared"))
    last = d.filter("event in ('stage_started', 'stage_finished')").groupBy("job_id", "epoch", "batch", "worker").agg(
        F.max_by(F.struct("event", "stage", "returncode", F.struct("ts", "event_id").alias("at")), F.struct("ts", "event_id")).alias("l"))
    on = [last[k].eqNullSafe(cleared[k]) for k in ("job_id", "epoch", "batch")]
    d = last.join(cleared, on, "left").select(*[last[k] for k in ("job_id", "epoch", "batch", "worker", "l")], "cleared")
    bad = (c("l.event") == "stage_finished") & (c("l.returncode") != 0) & (c("cleared").isNull() | (c("l.at") > c("cleared")))
    return d.filter(bad).select("job_id", "epoch", "batch", "worker", c("l.stage").alias("stage"))


def diagnose(manifest: DataFrame, failures: DataFrame, chunks: DataFrame, verification: DataFrame, events: DataFrame, job_completed: bool = False) -> DataFrame:
    """Issue rows: page, source_name, page_index, kind, type, batch, stage, evidence.

    manifest: page, source_name, page_index; failures: page, type, reason, context_stage, context_batch, path, operation,
    message, priority (larger wins: status, schedule, explicit record); chunks: page, batch; verification: page,
    state (completed, failed, review); events as in ``stage_at_events`` with ``live``. A page verified complete drops
    saved failures and old events, never live ones.
    """
    c = F.col
    cols = ["type", "reason", "context_stage", "context_batch", "path", "operation", "message"]
    saved = L.latest(failures.select("page", *cols, "priority"), ["page"], [c("priority")]).drop("priority")
    ver = verification.groupBy("page").agg(F.bool_or(c("state") == "completed").alias("v_done"), F.bool_or(c("state") == "failed").alias("v_failed"), F.bool_or(c("state") == "review").alias("v_review"))
    told = stage_at_events(events).filter("event in ('page_failed', 'page_review_required')")
    ignore = F.lit(True) if job_completed else F.coalesce(c("v_done"), F.lit(False))
    told = told.join(ver.select("page", "v_done"), "page", "left").filter(c("live") | ~ignore)
    told = told.groupBy("page").agg(F.max_by(F.struct("event", "batch", "worker", "open_stage"), F.struct("ts", "event_id")).alias("ev"))
    d = saved.withColumn("saved", F.lit(True)).join(ver, "page", "full_outer").join(told, "page", "full_outer").fillna(False, ["saved", "v_done", "v_failed", "v_review"])
    d = d.withColumn("keep_saved", (c("saved") & ~c("v_done")) | c("v_failed") | c("v_review"))
    d = d.filter(c("keep_saved") | c("ev").isNotNull())
    kept = lambda x: F.when(c("saved") & ~c("v_done"), c(x))
    from_event = F.when(c("ev.event") == "page_review_required", "ReviewRequired").when(c("ev").isNotNull(), "PageFailure")
    kind_type = F.when(c("v_review"), "ReviewRequired").otherwise(F.coalesce(kept("type"), F.when(c("v_failed"), "PageFailure"), from_event))
    d = d.withColumn("type", kind_type)
    stage, proof = tx.infer_stage(kept("context_stage"), kept("path"), kept("operation"), kept("message"))
    realigned = (c("type") == "ReviewRequired") & F.coalesce(kept("reason") == "line_alignment_recovery", F.lit(False))
    d = d.withColumns({"s": F.when(realigned, "translate").otherwise(stage), "p": F.when(realigned, "reason:line_alignment_recovery").otherwise(proof)})
    event_stage = F.coalesce("ev.open_stage", F.when(c("ev.worker") == "translate", "translate").otherwise("unknown"))
    use_event = (c("s") == "unknown") & c("ev").isNotNull()
    d = d.join(chunks, "page", "left").join(manifest, "page", "left")
    return d.select("page", "source_name", "page_index", F.when(c("type") == "ReviewRequired", "review").otherwise("page_failure").alias("kind"), "type",
                    F.coalesce("ev.batch", kept("context_batch"), c("chunk_batch")).alias("batch"), F.when(use_event, event_stage).otherwise(c("s")).alias("stage"),
                    F.when(use_event, F.concat(F.lit("event:"), "ev.event")).otherwise(c("p")).alias("evidence"))


def diagnose_job(job: DataFrame, events: DataFrame) -> DataFrame:
    """Job failures: (job_id, type, message, batch, stage, evidence); none for cancelled or interrupted jobs.

    job: job_id, status, error_type, error, context_stage, context_batch; events: job_id and the event columns. An
    unknown stage is taken from the failed stages, else the open ones, if there is exactly one.
    """
    c = F.col
    d = job.filter(c("error").isNotNull() & (c("status") != "cancelled") & ~F.coalesce(c("error_type") == "InterruptedError", F.lit(False)))
    ends = events.filter("event in ('stage_started', 'stage_finished')").groupBy("job_id", "batch", "worker").agg(
        F.max_by(F.struct("event", "stage", "returncode"), F.struct("ts", "event_id")).alias("l"))
    state = F.when(c("l.event") == "stage_started", "open").when(c("l.returncode") != 0, "failed")
    ends = ends.select("job_id", "batch", c("l.stage").alias("stage"), state.alias("state")).filter("state is not null")
    one = ends.groupBy("job_id", "state").agg(F.count(F.lit(1)).alias("n"), F.min("stage").alias("stage"), F.min("batch").alias("batch"))
    pick = one.groupBy("job_id").agg(F.min_by(F.struct("n", "state", "stage", "batch"), "state").alias("k"))
    stage, proof = tx.infer_stage(c("context_stage"), c("error"))
    d = d.withColumns({"s": stage, "p": proof}).join(pick, "job_id", "left")
    use = (c("s") == "unknown") & F.coalesce(c("k.n") == 1, F.lit(False))
    return d.select("job_id", c("error_type").alias("type"), c("error").alias("message"), F.when(use, c("k.batch")).otherwise(c("context_batch")).alias("batch"),
                    F.when(use, c("k.stage")).otherwise(c("s")).alias("stage"), F.when(use, F.concat(F.lit("stage:"), "k.state")).otherwise(c("p")).alias("evidence"))


def context_requests(pages: DataFrame, budget: int, reserved: int, summaries: DataFrame, summary_budget: int, matches: DataFrame) -> DataFrame:
    """Per page: history pages and tokens, summaries, glossary terms and the token total of its context.

    pages: project, page, tokens, complete; summaries: project, page, tokens; matches: page, entry_idx.
    """
    key = ["project", "request_page"]
    h = X.history_suffix(pages, budget, reserved).groupBy(*key).agg(F.count(F.lit(1)).alias("history_pages"), F.sum("tokens").alias("history_tokens"), F.min("page").alias("first_page"))
    s = X.fit_summaries(summaries, summary_budget).groupBy(*key).agg(F.count(F.lit(1)).alias("summary_pages"), F.sum("tokens").alias("summary_tokens"))
    g = matches.groupBy(F.col("page").alias("request_page")).agg(F.count(F.lit(1)).alias("terms"))
    d = pages.select("project", F.col("page").alias("request_page")).join(h, key, "left").join(s, key, "left").join(g, "request_page", "left")
    d = d.fillna(0, ["history_pages", "history_tokens", "summary_pages", "summary_tokens", "terms"])
    return d.withColumn("context_tokens", F.col("history_tokens") + F.col("summary_tokens") + F.lit(reserved))
