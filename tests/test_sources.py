"""Readers and writers on real files."""

import hashlib
import json

import pytest
from pyspark.sql import functions as F

from pagetext.operators import ledger as L
from pagetext.sources import documents as D
from pagetext.sources import sinks as K
from pagetext.sources.pages import scan_pages


def test_scan_pages(spark, tmp_path):
    for name in ["p10.PNG", "p2.jpg", "P1.webp", "notes.txt", "p02.tif"]:
        (tmp_path / name).write_bytes(name.encode())
    sub = tmp_path / "mask"
    sub.mkdir()
    (sub / "x.png").write_bytes(b"x")
    (sub / "deep").mkdir()
    (sub / "deep" / "y.png").write_bytes(b"y")
    got = scan_pages(spark, str(tmp_path)).orderBy("position").collect()
    assert [r.source_name for r in got] == ["P1.webp", "p2.jpg", "p02.tif", "p10.PNG"]
    assert got[0].source_sha256 == hashlib.sha256(b"P1.webp").hexdigest()
    assert [r.source_name for r in scan_pages(spark, str(tmp_path), suffixes=(".png", ".jpg")).orderBy("position").collect()] == ["p2.jpg", "p10.PNG"]
    deep = {r.source_name for r in scan_pages(spark, str(tmp_path), recursive=True, exclude=["mask"]).collect()}
    assert "y.png" in deep and "x.png" not in deep
    empty = tmp_path / "none"
    empty.mkdir()
    (empty / "a.txt").write_text("x")
    with pytest.raises(ValueError):
        scan_pages(spark, str(empty))


def test_project(spark, tmp_path):
    doc = {"directory": "d", "pages": {"b.png": [{"xyxy": [1, 2, 3, 4], "text": ["あ", "い"], "translation": "x"}, {"xyxy": [0, 0, 5, 5], "text": "plain", "src_is_vertical": True}],
                                       "a.png": [], "c.png": [{"xyxy": [1, 1, 2, 2], "text": ""}]},
           "image_info": {"a.png": {"finish_code": 3, "llm_visual_summary": {"version": 1, "text": "s"}}, "b.png": {"llm_visual_summary": "bad"}}, "llm_compact_memory": {"version": "1"}}
    (tmp_path / "p.json").write_text(json.dumps(doc, ensure_ascii=False), encoding="utf-8")
    (tmp_path / "q.json").write_text("{ broken", encoding="utf-8")
    blocks, pages, warn = D.read_project(spark, str(tmp_path))
    rows = blocks.orderBy("page_idx", "block_id").collect()
    assert [(r.page_idx, r.page, r.block_id, r.text) for r in rows] == [(0, "b.png", 1, ["あ", "い"]), (0, "b.png", 2, ["plain"]), (2, "c.png", 1, [""])]
    assert {(r.page, r.finish_code, r.summary) for r in pages.collect()} == {("a.png", 3, "s"), ("b.png", 15, None), ("c.png", 0, None)}
    assert {(r.page, r.warning) for r in warn.collect()} == {("b.png", "invalid_summary"), (None, "invalid_memory"), (None, "not_a_project")}


def test_glossary(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps([{"src": " Hero ", "dst": "H", "info": "i"}, {"src": "x"}, {"src": " ", "dst": "y"}, 5]))
    (tmp_path / "b.txt").write_text("# c\n// c\n\\\\ c\n\nA->B->C # n # m\nT\tU\tV\nbroken\n->x\n")
    (tmp_path / "c.tsv").write_text("one\ttwo\nonly\n")
    (tmp_path / "d.json").write_text("[{]")
    good, bad = D.read_glossary(spark, str(tmp_path))
    assert {(r.entry_idx, r.source, r.translation, r.note) for r in good.collect()} == {(1, "Hero", "H", "i"), (5, "A", "B->C", "n # m"), (6, "T", "U", "V"), (1, "one", "two", "")}
    assert {(r.path[-6:], r.location, r.reason) for r in bad.collect()} == {
        ("a.json", "entry 2", "missing or wrong dst"), ("a.json", "entry 3", "empty source"), ("a.json", "entry 4", "expected an object"),
        ("/b.txt", "line 7", "expected an arrow or tabs"), ("/b.txt", "line 8", "empty source"), ("/c.tsv", "line 2", "expected two or three fields"), ("d.json", "line 1", "invalid JSON")}


def test_marked_text_round_trip(spark, tmp_path):
    b = spark.createDataFrame([(1, 1, " a\nb "), (1, 2, ""), (2, 1, "c")], "page long, block_id int, text string")
    K.write_lines(K.to_marked_text(b), str(tmp_path / "out"), ["page", "seq"])
    content = "".join(p.read_text() for p in sorted((tmp_path / "out").glob("part*")))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "x.txt").write_text(content)
    got = {(r.page, r.pos, r.text) for r in D.read_marked_text(spark, str(tmp_path / "in")).collect()}
    assert got == {("1", 1, "a\nb"), ("1", 2, ""), ("2", 1, "c")}


def test_events_and_stream(spark, tmp_path):
    from pagetext.streaming.events import run_available

    (tmp_path / "a.log").write_text('{"event":"stage_started","batch":1,"worker":"cpu","more":{"x":1}}\n[1]\n{"event":5}\nnot json\n{"event":"done","ts":"2026-01-01T00:00:00Z"}\n')
    batch = D.read_events(spark, str(tmp_path))
    assert {(r.event, r.batch, str(r.extras)) for r in batch.collect()} == {("stage_started", 1, "{'more': '{\"x\":1}'}"), ("done", None, "{}")}
    stream = run_available(D.stream_events(spark, str(tmp_path)).drop("extras"), "ev")
    assert stream.exceptAll(batch.drop("extras")).count() == 0 and stream.count() == 2


def test_ledger_csv_keeps_text(spark, tmp_path):
    rows = [(2, 1, 1, 'say "hi",\nthere', "あ", 12, False), (1, 1, 1, " x ", "", 10, True)]
    schema = "page bigint, source_id int, reading_order int, source string, translation string, font_size int, small_text_review boolean"
    d = spark.createDataFrame(rows, schema)
    K.write_ledger(d, str(tmp_path / "l"), "csv")
    assert any(p.read_bytes().startswith(b"\xef\xbb\xbfpage,") for p in (tmp_path / "l").glob("part*"))
    back = K.read_ledger_csv(spark, str(tmp_path / "l"), schema).collect()
    assert sorted((r.page, r.source) for r in back) == [(1, " x "), (2, 'say "hi",\nthere')]


def test_publish_twice_is_publish_once(spark):
    m = spark.createDataFrame([(1, "a", None), (2, "b", "old"), (3, "c", "old")], "page int, output_name string, output_sha256 string")
    v = spark.createDataFrame([(1, "n1"), (2, "n2"), (3, "n3")], "page int, sha256 string")
    files = spark.createDataFrame([("b", "old"), ("c", "edited")], "output_name string, existing_sha256 string")
    w, clash, after = K.plan_publish(v, m, files)
    assert {r.page for r in w.collect()} == {1, 2} and {r.page for r in clash.collect()} == {3}
    files2 = w.select("output_name", F.col("sha256").alias("existing_sha256")).union(files.filter("output_name = 'c'"))
    assert K.plan_publish(v, after, files2)[0].count() == 0


def test_unique_names_like_first_come(spark):
    names = ["a.png", "A.jpg", "a.png(2).x", "b.png", "b.png", "b.png", "b.png(2).png", "B.png.tif", "c.png", "c.png.png", ".hidden", "b.png(3).gif"]
    got = {r.ordinal: r.output_name for r in L.unique_names(spark.createDataFrame(list(enumerate(names)), "ordinal int, name string")).collect()}
    want = dict(enumerate(["a.png.png", "A.jpg.png", "a.png(2).png", "b.png.png", "b.png(2).png", "b.png(3).png", "b.png(2)(2).png", "B.png(4).png", "c.png", "c.png.png",
                           ".hidden.png", "b.png(3)(2).png"]))
    assert got == want


def test_digest_blocks(spark):
    d = spark.range(1, 11).select(F.lit("k").alias("k"), F.col("id").cast("int").alias("o"), F.lit("é").alias("t"))
    whole = L.digest_rows(d, ["k"], "o", ["o", "t"]).first().digest
    text = "[" + ",".join('{"o":%d,"t":"é"}' % i for i in range(1, 11)) + "]"
    assert whole == hashlib.sha256(text.encode()).hexdigest()
    many = spark.range(1, 9001).select((F.col("id") % 3).alias("k"), F.col("id").alias("o"))
    want = {k: hashlib.sha256(("[" + ",".join('{"o":%d}' % i for i in range(1, 9001) if i % 3 == k) + "]").encode()).hexdigest() for k in range(3)}
    assert {r.k: r.digest for r in L.digest_rows(many, ["k"], "o", ["o"]).collect()} == want


def test_settings_at_any_depth(spark):
    deep = lambda n, x: {"a": deep(n - 1, x)} if n else x
    cases = [({"a": deep(12, 1)}, {"a": deep(12, 1)}, True), ({"a": deep(12, 1)}, {"a": deep(12, 2)}, False), ({"a": {}}, {}, False), ({"a": {}}, {"a": {"b": 1}}, True), ({"a": {}}, {"a": 1}, False),
             ({"a": "{x"}, {"a": "{x"}, True), ({"a": "{x"}, {}, False), ({"n": 1}, {"n": 1.0}, True), ({"n": 1}, {"n": "1"}, False), ({"a.b": 1}, {"a": {"b": 1}}, False), ({"l": [1, {"x": 2.0}]}, {"l": [1.0, {"x": 2}]}, True),
             ({"skip": {"x": {"y": 1}}, "n": None}, {"n": None}, True), ({"n": None}, {}, False)]
    frame = lambda k: L.flatten_settings(spark.createDataFrame([(i, json.dumps(x[k])) for i, x in enumerate(cases)], "i int, j string"), ["i"], "j")
    bad = {r.i for r in L.config_contains(frame(0), frame(1), ["i"], ignore=["skip"]).collect()}
    assert bad == {i for i, x in enumerate(cases) if not x[2]}


def test_settings_are_never_broadcast(spark):
    """Spark expects a few bytes where the settings of a small JSON column unfold to a hundred times as many."""
    import __spark_entry__ as entry

    plan = entry.queries()["j12_config_contains"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_natural_key_of_long_numbers(spark):
    names = ["p" + "9" * 60, "p1" + "0" * 60, "p2", "p010", "p" + "1" * 41, "P3"]
    d = spark.createDataFrame([(n,) for n in names], "n string")
    got = [r.n for r in d.orderBy(L.natural_key(F.col("n"))).collect()]
    assert got == ["p2", "P3", "p010", "p" + "1" * 41, "p" + "9" * 60, "p1" + "0" * 60]


def test_documents_are_built_page_by_page(spark, monkeypatch):
    """No document that s5 and s10b parse holds more than one page."""
    import __spark_entry__ as entry

    seen = []
    for name in ("parse_marked_text", "parse_summary_md"):
        monkeypatch.setattr(D, name, lambda df, *a, f=getattr(D, name): (seen.append(df), f(df, *a))[1])
    queries = entry.queries()
    for name in ("s5_read_marked_text", "s10b_read_summary_markdown"):
        queries[name](spark, "/root/testdata/sf0.001")
    assert len(seen) == 2 and all(df.filter("regexp_count(content, '(?m)^### ') <> 1").isEmpty() for df in seen)


def test_later_part_of_a_summary_wins(spark):
    d = spark.createDataFrame([(1, 2, "### a\n\nlate"), (1, 1, "### a\n\nearly\n\n\n### b\n\nx")], "k int, part int, content string")
    got = D.parse_summary_md(d, ["k"], spark.createDataFrame([(1, "a"), (1, "b"), (1, "c")], "k int, page string"), "part").collect()
    assert {(r.page, r.text) for r in got} == {("a", "late"), ("b", "x"), ("c", "")}
