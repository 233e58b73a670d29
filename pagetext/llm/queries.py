"""The thin registered queries: each reads its whole table, calls its operator and derives the agreed columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm import chat, classifier, language, licences, lm, mixing, near_dups, negatives, neighbours, quality, runs, secrets, tokens
from pagetext.llm.common import id_fold

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(fn: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


MIX_SQL = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size, md5('mix:' || coalesce(doc_id::varchar, '')) as k from documents),
s as (select source, sum(size)::bigint as source_size, [1, 2, 3][(row_number() over (order by source nulls last) - 1) % 3 + 1]::bigint as w from d group by source),
t as (select sum(source_size)::bigint as total, sum(w)::bigint as weights from s),
p as (select *, sum(3 * source_size) over r - 3 * source_size as caps, sum(w) over r - w as ws from s
 window r as (order by (3 * source_size)::double / w, source nulls last rows unbounded preceding)),
v as (select max((total - caps)::double / (weights - ws)::double) as level from p, t),
g as (select source, source_size, case when total > 0 then least((3 * source_size)::double, w * level) else 0.0::double end as target from s, t, v),
c as (select d.doc_id, d.source, d.size, g.source_size, g.target, floor(g.target + 0.5)::bigint as budget,
 sum(d.size) over (partition by d.source order by d.k, d.doc_id, d.size rows unbounded preceding) - d.size as before from d join g on d.source is not distinct from g.source)
select doc_id, source, size, source_size, target, (case when source_size = 0 then 0 else (budget // source_size) * size
 + least(greatest(budget - (budget // source_size) * source_size - before, 0), size) end)::bigint as taken from c"""


@query("op4_mix_sources", MIX_SQL)
def _(spark, sf_dir):
    return mixing.mix_sources(table(spark, sf_dir, "documents"))


@query("op10_scan_secrets")
def _(spark, sf_dir):
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


@query("op1_simhash_near_dups")
def _(spark, sf_dir):
    return near_dups.near_duplicates(table(spark, sf_dir, "documents"))


@query("op2_language_id")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = language.fit_language(language.training_rows(docs))
    found = language.identify_language(docs.select("doc_id", "text"), model)
    return found.select("doc_id", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "lang_pred", F.col("lang_score").alias("score"))


@query("op3_quality_trees")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return quality.rate_quality(docs, quality.fit_quality(docs, table(spark, sf_dir, "labels")))


def multi_ranks() -> tuple[dict[bytes, int], str]:
    """Ranks and word pattern of the public multi-language vocabulary, read where it is installed."""
    import public_tokenizers

    return tokens.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN


@query("op8_byte_bpe")
def _(spark, sf_dir):
    return tokens.digest_documents(table(spark, sf_dir, "documents"), *multi_ranks())


@query("op7_nearest_neighbours")
def _(spark, sf_dir):
    return neighbours.nearest_neighbours(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op5_deleted_interpolation")
def _(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


@query("op9_license_scan", licences.licence_sql())
def _(spark, sf_dir):
    return licences.scan_licences(table(spark, sf_dir, "documents")).drop("start", "end")


@query("op6_chat_perspectives", chat.CHAT_SQL)
def _(spark, sf_dir):
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


NEGATIVES_SQL = """
with e as (select vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
 list_transform(embedding, lambda x: floor(256 * x::double)::bigint) as v from embeddings
 where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as anchor_id, b.vec_id, a.label = b.label as alike,
 coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0)::bigint as score from e a join e b on a.vec_id % 50 = 0 and a.vec_id <> b.vec_id),
p as (select anchor_id, vec_id as positive_id, score as positive_score from s where alike
 qualify row_number() over (partition by anchor_id order by score desc, vec_id) <= 5)
select p.anchor_id, p.positive_id, row_number() over (partition by p.anchor_id, p.positive_id order by s.score desc, s.vec_id)::int as rank,
 s.vec_id as negative_id, p.positive_score, s.score as negative_score
from p join s on s.anchor_id = p.anchor_id and not s.alike and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score
qualify rank <= 3"""


@query("op11_hard_negatives", NEGATIVES_SQL)
def _(spark, sf_dir):
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    rows = table(spark, sf_dir, "embeddings").filter(negatives.usable(F.col("embedding")))
    rows = rows.select("vec_id", label.alias("label"), negatives.whole_vector(F.col("embedding")).alias("embedding"))
    return negatives.mine_negatives(rows, F.col("vec_id") % 50 == 0)


@query("op12_periodic_runs")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    texts = docs.select("doc_id", runs.with_planted_periods(F.col("text"), F.col("doc_id")).alias("text"))
    return runs.digest_runs(runs.periodic_runs(texts))


@query("op13_quality_classifier")
def _(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = classifier.fit_classifier(docs, table(spark, sf_dir, "labels"))
    found = classifier.classify_quality(docs, model)
    return found.select("doc_id", (id_fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")
