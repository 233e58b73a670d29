"""Plans the given tables cannot exercise in full."""

from datetime import datetime

from pagetext.operators import context as X
from pagetext.plans import runs as P
from pagetext.plans import volumes as V


def test_harmonise(spark):
    ledger = spark.createDataFrame([(1, 1, "アリス", "Alice"), (2, 1, "アリス", "Alis"), (3, 1, "アリス", "Alice")], "page int, source_id int, source string, translation string")
    glossary = spark.createDataFrame([(1, "ボブ", "Bob", "")], "entry_idx int, source string, translation string, note string")
    cand = spark.createDataFrame([("アリス", "Alice"), ("アリス", "Alis"), ("アリス", "Alice")], "entity string, candidate string")
    audit = V.audit_volume(ledger, glossary, cand)
    row = audit.first()
    assert (row.entity, row.occurrences, row.pages, row.winner, row.conflict, row.standard) == ("アリス", 3, 3, "Alice", True, "Alice")
    assert {r.translation for r in V.harmonise(ledger, audit, cand).collect()} == {"Alice"}


def test_eligible_pages(spark):
    info = spark.createDataFrame([(1, 15, "en"), (2, 15, "de"), (3, 7, "en"), (4, 15, None), (5, 15, "en"), (6, 15, "en")], "page int, finish_code int, translation_target string")
    blocks = spark.createDataFrame([(1, "a", "x"), (1, " ", ""), (2, "a", "x"), (3, "a", "x"), (4, "a", "x"), (5, "a", "x"), (5, "b", " "), (6, " ", "")], "page int, source string, translation string")
    assert {r.page for r in X.eligible_pages(blocks, info, "en").collect()} == {1, 4}


def test_diagnose_job(spark):
    job = spark.createDataFrame([(1, "failed", "RuntimeError", "boom", None, None), (2, "cancelled", "X", "y", None, None), (3, "failed", "X", "see render.log", None, 7), (4, "failed", "X", "two", None, None)],
                                "job_id int, status string, error_type string, error string, context_stage string, context_batch int")
    t = datetime(2026, 1, 1)
    ev = [(1, t, 1, 4, "cpu", "stage_started", "prepare", 0), (1, t, 2, 4, "cpu", "stage_finished", "prepare", 1), (1, t, 3, 5, "translate", "stage_started", "translate", 0),
          (4, t, 4, 1, "cpu", "stage_started", "prepare", 0), (4, t, 5, 2, "cpu", "stage_started", "render", 0)]
    events = spark.createDataFrame(ev, "job_id int, ts timestamp, event_id int, batch int, worker string, event string, stage string, returncode int")
    got = {r.job_id: (r.batch, r.stage, r.evidence) for r in P.diagnose_job(job, events).collect()}
    assert got == {1: (4, "prepare", "stage:failed"), 3: (7, "render", "token:render.log"), 4: (None, "unknown", "none")}


def test_failed_stages_of_jobs_that_share_batch_and_worker(spark):
    t = datetime(2026, 1, 1)
    ev = [("a", 1, "stage_started", "render", 0), ("a", 2, "stage_finished", "render", 1), ("b", 3, "stage_started", "ocr", 0), ("b", 4, "stage_finished", "ocr", 0), ("b", 5, "chunk_ready", None, 0),
          ("c", 6, "stage_finished", "ocr", 2), ("c", 7, "folder_started", None, 0)]
    events = spark.createDataFrame([(j, t, i, 4, "cpu", e, s, r) for j, i, e, s, r in ev], "job_id string, ts timestamp, event_id int, batch int, worker string, event string, stage string, returncode int")
    got = sorted(map(tuple, P.failed_stages(events).collect()), key=str)
    assert got == sorted([("a", 0, 4, "cpu", "render"), ("c", 0, 4, "cpu", "ocr")], key=str)
    alone = P.failed_stages(events.filter("job_id = 'a'").drop("job_id"))
    assert [tuple(r) for r in alone.collect()] == [(0, 0, 4, "cpu", "render")]
