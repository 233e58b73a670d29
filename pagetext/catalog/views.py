"""Derived input views over the given tables (see FIXTURES.md), for Spark and, as text, for the SQL twins."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SHARED = {
    "blocks": """
select page, block_id, x1, y1, x1+w as x2, y1+h as y2, vertical, label, font_size from (
  select l_orderkey as page,
         cast(row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey,
              l_extendedprice, l_quantity, l_shipdate) as int) as block_id,
         cast((l_partkey*37) % 900 as int) as x1,
         cast((l_partkey*53 + l_suppkey*17) % 1300 as int) as y1,
         cast(3 + l_quantity*2 as int) as w,
         cast(4 + (l_suppkey*29 + l_partkey) % 180 as int) as h,
         (l_partkey % 3) <> 0 as vertical, l_returnflag as label,
         cast(8 + l_partkey % 40 as int) as font_size
  from lineitem) t""",
    "candidates": """
select page, cast(row_number() over (partition by page order by y1, x1, block_id) as int) as cand_id,
       x1 + cast((block_id*7) % 9 as int) - 4 as x1, y1 + cast((block_id*5) % 7 as int) - 3 as y1,
       x2 + cast((block_id*3) % 5 as int) as x2,     y2 + cast((block_id*11) % 6 as int) as y2
from blocks where (page + block_id) % 11 <> 0""",
    "pages_v": """
select o_orderkey as page, cast(o_custkey % 20 as int) as job_id, 1050 as page_w, 1500 as page_h from orders""",
    "dialogue": """
select conv_id as page, cast(turn as int) as source_id, text as source,
       case when role = 'user' and nrole = 'assistant' then nxt end as translation from (
  select conv_id, turn, role, text,
         lead(role) over (partition by conv_id order by turn) as nrole,
         lead(text) over (partition by conv_id order by turn) as nxt from conversations) t
where role <> 'assistant'""",
    "glossary": """
select * from (values (1,'Eriner','TermA','name'),(2,'nicht','TermB',''),(3,'token','TermC',''),
  (4,'ther','TermD','part'),(5,'straße','TermE',''),(6,'eriner','TermA','dup')) t(entry_idx,source,translation,note)""",
    "page_tokens": """
select conv_id as page, cast(conv_id % 7 as int) as project, cast(sum(length(text)) as int) as tokens,
       cast(max(case when (conv_id*5) % 9 = 0 then 0 else 1 end) as int) as complete
from conversations group by conv_id""",
    "job_events": """
select event_id, ts, cast(user_id % 12 as int) as batch,
       case when user_id % 2 = 0 then 'cpu' else 'translate' end as worker,
       case event_type when 'view' then 'stage_started' when 'purchase' then 'stage_finished'
            when 'error' then 'page_failed' when 'signup' then 'chunk_ready' else 'progress' end as event,
       case cast(user_id % 3 as int) when 0 then 'prepare' when 1 then 'translate' else 'render' end as stage,
       user_id as page, value, case when value > 40 then 1 else 0 end as returncode
from events""",
}

# Only the twins need these as text; the Spark side builds them with the DataFrame API below.
_DUCK = {
    **_SHARED,
    "panels": """
select page, panel_id, cast(px*350 as int) as x1, cast(py*500 as int) as y1,
       cast(px*350+330 as int) as x2, cast(py*500+480 as int) as y2
from (select distinct l_orderkey as page from lineitem) a cross join
     (select * from (values (1,2,0),(2,1,0),(3,0,0),(4,2,1),(5,1,1),(6,0,1),(7,2,2),(8,1,2)) t(panel_id,px,py)) b
where (page + panel_id) % 4 <> 0""",
    "replies": """
select page, source_id, case
  when source_id % 5 = 0 then concat('```json', chr(10), '{"translations":{"', cast(source_id as varchar), '":"x',
       cast(page as varchar), '"},"page_summary":" s  t "}', chr(10), '```')
  when source_id % 7 = 0 then 'no json'
  else concat('{"', cast(source_id as varchar), '":"y"}') end as content
from dialogue""",
    "manifest": """
select cast(doc_id as int) as ordinal,
       concat(source, '_', cast(doc_id as varchar), case when doc_id % 2 = 0 then '.PNG' else '.jpg' end) as source_name,
       sha256(text) as source_sha256,
       case when doc_id % 10 = 0 then null when doc_id % 37 = 0 then sha256(concat(text,'!')) else sha256(text) end
         as output_sha256
from documents""",
}

ROWS = 1 << 20  # rows numbered in one task

_NEEDS = {"candidates": ["blocks"], "replies": ["dialogue"]}
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the derived views it mentions, dependencies first."""
    wanted: list[str] = []

    def add(name: str) -> None:
        for dep in _NEEDS.get(name, []):
            add(dep)
        if name not in wanted:
            wanted.append(name)

    for name in _DUCK:
        if re.search(rf"\b{name}\b", sql):
            add(name)
    ctes = [f"{n} as ({_DUCK[n]})" for n in wanted]
    if not ctes:
        return sql
    body = sql.strip()
    m = re.match(r"with\s+(recursive\s+)?", body, re.I)
    rec = "recursive " if m and m.group(1) else ""
    rest = body[m.end():] if m else None
    return f"with {rec}" + ",\n".join(ctes) + (",\n" + rest if m else "\n" + body)


class Views:
    """Lazily built inputs of one query: ``v.lineitem`` is a given table, ``v.blocks`` a derived view."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir
        self._made: dict[str, DataFrame] = {}

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        if name not in self._made:
            self._made[name] = self._build(name)
        return self._made[name]

    def _build(self, name: str) -> DataFrame:
        if name in TABLES:
            return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")
        if name in _SHARED:
            sql = _SHARED[name]
            inputs = {t: getattr(self, t) for t in [*TABLES, "blocks"] if re.search(rf"\bfrom {t}\b", sql)}
            for t in inputs:
                sql = re.sub(rf"\bfrom {t}\b", f"from {{{t}}}", sql)
            return self.spark.sql(sql, **inputs)
        return getattr(self, f"_{name}_view")() if hasattr(type(self), f"_{name}_view") else self._unknown(name)

    def _unknown(self, name: str) -> DataFrame:
        raise AttributeError(f"no table or view named {name}")

    def _dealt_blocks_view(self) -> DataFrame:
        """``blocks`` from tasks of about ``ROWS`` rows of whole pages, however large the table and few the shuffle partitions are."""
        parts = self.lineitem.count() // ROWS + 1
        if parts <= int(self.spark.conf.get("spark.sql.shuffle.partitions")):
            return self.blocks
        more = Views(self.spark, self.sf_dir)
        more._made["lineitem"] = self.lineitem.repartition(parts, "l_orderkey")
        return more.blocks

    def _panels_view(self) -> DataFrame:
        grid = [(1, 2, 0), (2, 1, 0), (3, 0, 0), (4, 2, 1), (5, 1, 1), (6, 0, 1), (7, 2, 2), (8, 1, 2)]
        cells = F.array(*[F.struct(F.lit(i).alias("panel_id"), F.lit(x).alias("px"), F.lit(y).alias("py"))
                          for i, x, y in grid])
        d = self.lineitem.select(F.col("l_orderkey").alias("page")).distinct().select("page", F.inline(cells))
        return d.filter((F.col("page") + F.col("panel_id")) % 4 != 0).select(
            "page", "panel_id", (F.col("px") * 350).alias("x1"), (F.col("py") * 500).alias("y1"),
            (F.col("px") * 350 + 330).alias("x2"), (F.col("py") * 500 + 480).alias("y2"))

    def _replies_view(self) -> DataFrame:
        sid = F.col("source_id").cast("string")
        fenced = F.concat(F.lit('```json\n{"translations":{"'), sid, F.lit('":"x'), F.col("page").cast("string"),
                          F.lit('"},"page_summary":" s  t "}\n```'))
        return self.dialogue.select(
            "page", "source_id",
            F.when(F.col("source_id") % 5 == 0, fenced).when(F.col("source_id") % 7 == 0, "no json")
            .otherwise(F.concat(F.lit('{"'), sid, F.lit('":"y"}'))).alias("content"))

    def _manifest_view(self) -> DataFrame:
        doc = F.col("doc_id")
        return self.documents.select(
            doc.cast("int").alias("ordinal"),
            F.concat("source", F.lit("_"), doc.cast("string"),
                     F.when(doc % 2 == 0, ".PNG").otherwise(".jpg")).alias("source_name"),
            F.sha2("text", 256).alias("source_sha256"),
            F.when(doc % 10 == 0, None).when(doc % 37 == 0, F.sha2(F.concat("text", F.lit("!")), 256))
            .otherwise(F.sha2("text", 256)).alias("output_sha256"))
