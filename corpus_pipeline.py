"""The corpus pipeline: documents in, token ids out. Each stage works on all its predecessor kept, through one operator.

Stages take (spark, docs, sf_dir) and return a DataFrame that is written as Parquet and read again for the next one; all but the last
keep the columns of ``documents``. Nulls, empty tables, repeated rows and further columns are treated as the operators say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagetext.llm import language, mixing, near_dups, secrets, tokens
from pagetext.llm.common import stored
from pagetext.llm.queries import multi_ranks, table


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Learns from the labelled rows of the training fold; rows without a letter or without a clear language go."""
    return language.keep_identified(docs, language.fit_language(language.training_rows(docs)))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (five-word shingles, Jaccard similarity 0.8 or more) the document with the smallest id stays."""
    return near_dups.one_per_similar_group(docs, least=0.8, width=5)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents stay; secrets in their texts are replaced, and the number of characters follows the text."""
    out = secrets.redact_secrets(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of each source as often as its target weight takes them: dropped, once, or repeated up to three times."""
    return mixing.repeat_to_mix(docs)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, source, n_tokens, ids and the digests of ids and decoded bytes, one row for every row of the mix."""
    ranks, pattern = multi_ranks()
    sources = docs.withColumn("doc_id", F.struct("doc_id", "source"))
    coded = tokens.digest_documents(sources, ranks, pattern, with_ids=True)
    return coded.select("doc_id.doc_id", "doc_id.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mix", mix_sources),
    ("tokens", encode_tokens),
]

#: Learned models and hash functions of the stages are not expressible in SQL; the tests compare each stage with plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents, each but the last written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
