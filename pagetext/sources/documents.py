"""Text and JSON sources: projects, glossaries, marked text, summaries, event logs, overrides.

Every reader is a thin file scan plus a DataFrame function that also works on texts already in a table.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagetext.functions import text as tx
from pagetext.operators.ledger import ALL_DONE, last_sections

BLOCK = ("struct<xyxy:array<double>,lines:array<array<array<double>>>,language:string,angle:double,text:variant,translation:string,"
         "rich_text:string,src_is_vertical:boolean,label:string,det_model:string,_detected_font_size:double,fontformat:string>")
RECORD = "struct<version:int,text:string>"
PROJECT = (f"struct<directory:string,current_img:string,pages:map<string,array<{BLOCK}>>,image_info:map<string,struct<finish_code:int,translation_target:string,"
           f"llm_visual_summary:variant>>,llm_compact_memory:variant>")


def whole_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content) of text files, one row per file."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def read_project(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return parse_project(whole_files(spark, path))


def parse_project(files: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(blocks, pages, warnings) of project documents.

    Page order is the document's order (``page_idx``). Text may be a list or a string. Optional records that do not
    fit are dropped with a warning; a missing progress code is 0 with an empty page or text, else complete.
    """
    c = F.col
    d = files.select("path", F.from_json("content", PROJECT).alias("p"))
    broken = d.filter(c("p.pages").isNull()).select("path", F.lit(None).cast("string").alias("page"), F.lit("not_a_project").alias("warning"))
    pages = d.filter(c("p.pages").isNotNull()).select("path", "p.image_info", "p.llm_compact_memory", F.posexplode(F.map_entries("p.pages")).alias("page_idx", "e"))
    pages = pages.select("path", "page_idx", c("e.key").alias("page"), c("e.value").alias("blocks"), F.try_element_at("image_info", c("e.key")).alias("info"), "llm_compact_memory")
    kind = F.schema_of_variant(c("b.text"))
    pieces = (F.when(kind == "STRING", F.array(F.try_variant_get("b.text", "$", "string"))).when(kind.startswith("ARRAY"), F.try_variant_get("b.text", "$", "array<string>"))
              .otherwise(F.array().cast("array<string>")))
    raw = pages.select("path", "page_idx", "page", F.posexplode("blocks").alias("i", "b"))
    box = [F.get("b.xyxy", F.lit(i)).alias(n) for i, n in enumerate(("x1", "y1", "x2", "y2"))]
    blocks = raw.select("path", "page_idx", "page", (c("i") + 1).alias("block_id"), *box, c("b.lines").alias("lines"), pieces.alias("text"),
                        c("b.translation").alias("translation"), c("b.src_is_vertical").alias("vertical"), c("b.label").alias("label"), c("b.language").alias("language"),
                        c("b.angle").alias("angle"), c("b._detected_font_size").alias("font_size"))
    empty = blocks.groupBy("path", "page").agg(F.bool_or((F.size("text") == 0) | (F.array_join("text", "") == "")).alias("has_empty"), F.count(F.lit(1)).alias("n_blocks"))

    def record(v: Column) -> Column:
        ok = (F.schema_of_variant(F.try_variant_get(v, "$.text", "variant")) == "STRING") & (F.schema_of_variant(F.try_variant_get(v, "$.version", "variant")) == "BIGINT")
        return F.when(ok, F.try_variant_get(v, "$.text", "string"))

    out = pages.drop("blocks").join(empty, ["path", "page"], "left")
    derived = F.when(F.coalesce(c("n_blocks"), F.lit(0)).eqNullSafe(0) | c("has_empty"), 0).otherwise(ALL_DONE)
    out = out.select("path", "page_idx", "page", F.coalesce("n_blocks", F.lit(0)).alias("n_blocks"), F.coalesce("info.finish_code", derived).cast("int").alias("finish_code"),
                     c("info.translation_target").alias("translation_target"), record(c("info.llm_visual_summary")).alias("summary"), record(c("llm_compact_memory")).alias("memory"),
                     c("info.llm_visual_summary").isNotNull().alias("had_summary"), c("llm_compact_memory").isNotNull().alias("had_memory"))
    bad_summary = out.filter("had_summary and summary is null").select("path", "page", F.lit("invalid_summary").alias("warning"))
    bad_memory = out.filter("had_memory and memory is null and page_idx = 0").select("path", F.lit(None).cast("string").alias("page"), F.lit("invalid_memory").alias("warning"))
    return blocks, out.drop("had_summary", "had_memory"), broken.unionByName(bad_summary).unionByName(bad_memory)


def read_glossary(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return parse_glossary(whole_files(spark, path))


def parse_glossary(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, rejects) of glossary files: a JSON array of {src, dst, info}, ``a->b #note`` lines or tab-separated lines.

    Comments start with ``#``, ``//`` or ``\\\\``. Entries keep file order in ``entry_idx``; rejects name the place.
    """
    c = F.col
    body = F.regexp_replace("content", "^﻿", "")
    d = files.select("path", body.alias("content")).withColumn("json", tx.strip(c("content")).startswith("["))
    items = F.when(c("json"), F.try_variant_get(F.try_parse_json("content"), "$", "array<variant>"))
    text_of = lambda f: F.try_variant_get("v", f"$.{f}", "string")
    kind_of = lambda f: F.schema_of_variant(F.try_variant_get("v", f"$.{f}", "variant"))
    bad_json = d.filter("json").filter(items.isNull()).select("path", F.lit("line 1").alias("location"), F.lit("invalid JSON").alias("reason"))
    j = d.filter("json").select("path", F.posexplode(items).alias("i", "v"))
    j = j.select("path", (c("i") + 1).alias("entry_idx"), F.concat(F.lit("entry "), c("i") + 1).alias("location"), text_of("src").alias("s"), text_of("dst").alias("t"),
                 F.coalesce(text_of("info"), F.lit("")).alias("n"),
                 F.when(~F.schema_of_variant("v").startswith("OBJECT"), "expected an object").when(F.coalesce(kind_of("src") != "STRING", F.lit(True)), "missing or wrong src")
                 .when(F.coalesce(kind_of("dst") != "STRING", F.lit(True)), "missing or wrong dst").alias("reason"))
    lines = d.filter("not json").select("path", F.posexplode(F.split("content", r"\r\n|\n|\r")).alias("i", "raw")).withColumn("line", tx.strip(c("raw")))
    lines = lines.filter((c("line") != "") & ~c("line").rlike(r"^(#|//|\\\\)"))
    tabs = F.lower("path").endswith(".tsv") | c("line").contains("\t")
    fields = F.split("line", "\t")
    arrow = F.regexp_extract_all("line", F.lit(r"(?s)^(.*?)->([^#]*)(?:#(.*))?$"), F.lit(0))
    part = lambda i: F.regexp_extract("line", r"(?s)^(.*?)->([^#]*)(?:#(.*))?$", i)
    t = lines.select("path", (c("i") + 1).alias("entry_idx"), F.concat(F.lit("line "), c("i") + 1).alias("location"),
                     F.when(tabs, F.get(fields, F.lit(0))).otherwise(part(1)).alias("s"), F.when(tabs, F.get(fields, F.lit(1))).otherwise(part(2)).alias("t"),
                     F.when(tabs, F.coalesce(F.get(fields, F.lit(2)), F.lit(""))).otherwise(part(3)).alias("n"),
                     F.when(tabs & ~F.size(fields).isin(2, 3), "expected two or three fields").when(~tabs & (F.size(arrow) == 0), "expected an arrow or tabs").alias("reason"))
    rows = j.unionByName(t).select("path", "entry_idx", "location", tx.strip(c("s")).alias("source"), tx.strip(c("t")).alias("translation"), tx.strip(c("n")).alias("note"), "reason")
    rows = rows.withColumn("reason", F.coalesce("reason", F.when(F.coalesce(c("source"), F.lit("")) == "", "empty source").when(F.coalesce(c("translation"), F.lit("")) == "", "empty translation")))
    return rows.filter("reason is null").drop("reason", "location"), rows.filter("reason is not null").select("path", "location", "reason").unionByName(bad_json)


def read_marked_text(spark: SparkSession, path: str) -> DataFrame:
    return parse_marked_text(whole_files(spark, path), ["path"])


def parse_marked_text(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Sections ``### page`` with numbered items: (key, page_idx, page, pos, text). Items count by place, not by number."""
    c = F.col
    sections = F.regexp_extract_all(F.regexp_replace("content", "\r\n", "\n"), F.lit(r"(?ms)^###\s+.*?(?=^###\s|\z)"), F.lit(0))
    d = df.select(*key, F.posexplode(sections).alias("page_idx", "body"))
    items = F.regexp_extract_all("body", F.lit(r"(?ms)^\d+\.(.*?)(?=^\d+\.|\z)"), F.lit(1))
    name = F.trim(F.regexp_extract("body", r"^###\s+([^\n]*)", 1))
    return (d.select(*key, "page_idx", name.alias("page"), F.posexplode_outer(items).alias("i", "t"))
            .select(*key, "page_idx", "page", (c("i") + 1).alias("pos"), tx.strip(c("t")).alias("text")))


def parse_summary_md(df: DataFrame, key: Sequence[str], pages: DataFrame, part: str | None = None) -> DataFrame:
    """Summaries of known pages from ``### page`` sections; a later duplicate wins, an omitted page is empty.

    df: key, content; pages: key, page. A key may have several documents, one after the other in the order of the column ``part``.
    """
    c = F.col
    sections = F.regexp_extract_all(F.regexp_replace("content", "\r\n", "\n"), F.lit(r"(?ms)^### .*?(?=^### |\z)"), F.lit(0))
    d = df.select(*key, (F.col(part) if part else F.lit(0)).alias("part"), F.size(sections).alias("n"), F.posexplode(sections).alias("idx", "s"))
    body = F.regexp_replace("s", r"^### [^\n]*(\n\n|\n|$)", "")
    body = F.when(c("idx") + 1 < c("n"), F.regexp_replace(body, r"(\n\n\n|\n\n|\n)\z", "")).otherwise(body)
    d = d.select(F.struct(*key, F.trim(F.regexp_extract("s", r"^### ([^\n]*)", 1)).alias("page")).alias("page"), F.struct("part", "idx").alias("idx"), body.alias("text"))
    last = last_sections(d).select("page.*", "text")
    return pages.join(last, [*key, "page"], "left").withColumn("text", F.coalesce("text", F.lit("")))


EVENT = T.StructType([T.StructField("event", T.StringType()), T.StructField("ts", T.TimestampType()), T.StructField("batch", T.IntegerType()), T.StructField("worker", T.StringType()),
                      T.StructField("stage", T.StringType()), T.StructField("page", T.LongType()), T.StructField("returncode", T.IntegerType())])


def parse_events(lines: DataFrame, column: str = "value") -> DataFrame:
    """Events of JSON lines with the fixed fields and ``extras``; lines that are no object or lack a text event are dropped."""
    known = [f.name for f in EVENT.fields]
    d = lines.select(F.try_parse_json(column).alias("doc"), F.from_json(column, EVENT).alias("e"), F.from_json(column, "map<string,string>").alias("all"))
    is_text = F.schema_of_variant(F.try_variant_get("doc", "$.event", "variant")) == "STRING"
    extras = F.map_filter("all", lambda k, _: ~k.isin(known))
    return d.filter(F.coalesce(is_text, F.lit(False))).select("e.*", extras.alias("extras"))


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return parse_events(spark.read.text(path))


def stream_events(spark: SparkSession, path: str, max_files: int = 100) -> DataFrame:
    """The same as an endless source: new log files are picked up as they arrive."""
    return parse_events(spark.readStream.option("maxFilesPerTrigger", max_files).text(path))


def parse_overrides(files: DataFrame, fields: str = "label:string,font_size:int,rect:string") -> DataFrame:
    """Block overrides of per-page JSON files {block_id: {...}}; an unreadable file counts as empty. files: page, content."""
    d = files.select("page", F.from_json("content", f"map<string,struct<{fields}>>").alias("m")).filter("m is not null")
    return d.select("page", F.explode("m").alias("k", "o")).select("page", F.col("k").try_cast("int").alias("block_id"), "o.*").filter("block_id is not null")


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    d = whole_files(spark, path).withColumn("page", F.regexp_extract("path", r"([^/]+)\.json$", 1))
    return parse_overrides(d)
