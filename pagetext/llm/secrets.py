"""Secret scans (native): fixed patterns, and runs that a Markov model of random strings explains better than one of words.

All positions are code points. A pattern never crosses a line end, and nothing here runs Python on the executors.
"""

from __future__ import annotations

import string
from functools import reduce

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetext.llm.common import WORD, id_key, prefix_sums

ASSIGN = ("([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
          r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
KINDS = (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24))
#: A cheap test that a text can hold a span of the kind at all; the exact pattern and lengths follow.
MAYBE = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16}", "hex": "[0-9a-f]{24}"}
ALPHABET = string.ascii_letters + string.digits + "+/_=-"
RUN = r"[A-Za-z0-9+/_=-]{16,}"
MARK = "[SECRET]"
_SPANS = "array<struct<start:bigint,kind:int,end:bigint>>"


def _matches(text: Column, pattern: str, group: int, least: int, kind: int) -> Column:
    """Spans of the leftmost non-overlapping matches, those with a short group dropped after matching."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    steps = F.zip_with(gaps, whole, lambda g, m: (F.length(g) + F.coalesce(F.length(m), F.lit(0))).cast("bigint"))
    before = prefix_sums(steps)
    # The i-th match starts after all earlier gaps and matches and its own gap.
    starts = F.zip_with(before, gaps, lambda at, g: at + F.length(g))
    spans = F.zip_with(F.zip_with(starts, whole, lambda s, m: F.struct(s.alias("s"), F.length(m).alias("n"))), value,
                       lambda a, v: F.when(F.length(v) >= least, F.struct(a["s"].alias("start"), F.lit(kind).alias("kind"), (a["s"] + a["n"]).alias("end"))))
    return F.filter(spans, lambda s: s.isNotNull())


def base_spans(text: Column) -> Column:
    """Array of (start, kind, end) of the fixed patterns, by start, then kind; kind indexes ``KINDS``."""
    none = F.array().cast(_SPANS)
    per_kind = [F.when(text.rlike(MAYBE[name]), _matches(text, pattern, group, least, i)).otherwise(none).cast(_SPANS)
                for i, (name, pattern, group, least) in enumerate(KINDS)]
    return F.array_sort(F.concat(*per_kind))


def span_text(spans: Column) -> Column:
    names = F.array(*[F.lit(k[0]) for k in KINDS], F.lit("random"))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def _pair_counts(strings: DataFrame) -> np.ndarray:
    """Counts of neighbouring characters over a column ``s``; row 0 is the start, column 0 any other character."""
    k = len(ALPHABET) + 1
    chars = strings.select(F.transform(F.split("s", ""), lambda ch: F.instr(F.lit(ALPHABET), ch)).alias("i"))
    before = F.concat(F.array(F.lit(0)), F.col("i"))
    cells = chars.select(F.explode(F.zip_with(F.slice(before, 1, F.size("i")), F.col("i"), lambda a, b: a * k + b)).alias("cell"))
    out = np.zeros(k * k)
    for cell, n in cells.groupBy("cell").count().collect():  # at most the square of the alphabet
        out[cell] = n
    return out.reshape(k, k)


def fit_ratio(docs: DataFrame, sample_docs: int = 2000, smooth: float = 0.5, doc_id: str = "doc_id", text: str = "text") -> np.ndarray:
    """Log ratios of two character Markov models, per pair of neighbouring characters (flat table).

    Labelled samples: values found by the fixed patterns are random strings; the other words, cut at other characters, of
    documents without such a value are ordinary identifiers. Each side takes the ``sample_docs`` documents with
    the smallest hash-random keys of id and text (a documented bound that rows without an id or with one id keep too). Without samples a model is uniform.
    """
    d = docs.select(F.col(doc_id).alias("__id"), F.col(text).alias("__text"), F.md5(F.concat(id_key(F.col(doc_id), "secrets"), F.lit(":"), F.xxhash64(text).cast("string")).cast("binary")).alias("__key")).filter("__text is not null")
    hit = reduce(lambda a, b: a | b, [F.col("__text").rlike(p) for p in MAYBE.values()])
    spans = d.filter(hit).select("__key", F.transform(base_spans(F.col("__text")), lambda s: F.substring("__text", (s["start"] + 1).cast("int"), (s["end"] - s["start"]).cast("int"))).alias("v"))
    found = spans.filter(F.size("v") > 0).orderBy("__key").limit(sample_docs).select(F.explode("v").alias("v"))
    # Of an assignment only the value after the sign is random.
    values = found.select(F.regexp_replace("v", r"""^[^:=]*[:=]\x20*["']?""", "").alias("s")).filter(F.length("s") >= 6)
    keys = d.filter(~hit).select("__key").orderBy("__key").limit(sample_docs)
    words = (d.filter(~hit).join(F.broadcast(keys.distinct()), "__key", "left_semi").dropDuplicates(["__key"])
             .select(F.explode(F.regexp_extract_all("__text", F.lit("[A-Za-z0-9+/_=-]{4,}"), F.lit(0))).alias("s")))
    logs = []
    for strings in (values, words):
        c = _pair_counts(strings) + smooth
        logs.append(np.log(c / c.sum(axis=1, keepdims=True)))
    return (logs[0] - logs[1]).ravel()


def run_score(run: Column, ratio: np.ndarray) -> Column:
    """Log-likelihood ratio of a run of characters; above 0 it is more like a random string."""
    table, k = F.lit(np.asarray(ratio, dtype=np.float64)), len(ALPHABET) + 1
    step = lambda s, ch: F.struct(F.instr(F.lit(ALPHABET), ch).alias("last"), (s["sum"] + F.element_at(table, s["last"] * k + F.instr(F.lit(ALPHABET), ch) + 1)).alias("sum"))
    return F.aggregate(F.split(run, ""), F.struct(F.lit(0).alias("last"), F.lit(0.0).alias("sum")), step, lambda s: s["sum"])


def _is_random(run: Column, ratio: np.ndarray, least: float) -> Column:
    return run.rlike("[A-Za-z]") & (run_score(run, ratio) >= least)


def all_spans(text: Column, base: Column, ratio: np.ndarray, least: float = 5.0) -> Column:
    """``base`` and the runs of 16 or more characters with a letter whose log ratio is ``least`` or more, outside base spans."""
    none = F.array().cast(_SPANS)
    runs = F.regexp_extract_all(text, F.lit(RUN), F.lit(0))
    marked = F.transform(runs, lambda r: _is_random(r, ratio, least))
    spans = F.zip_with(_matches(text, RUN, 0, 16, len(KINDS)), marked, lambda s, m: F.when(m, s))
    spans = F.filter(spans, lambda s: s.isNotNull() & ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    some = text.rlike(RUN) & F.exists(runs, lambda r: _is_random(r, ratio, least))
    return F.array_sort(F.concat(base, F.when(some, spans).otherwise(none).cast(_SPANS)))


def scan_secrets(docs: DataFrame, ratio: np.ndarray | None = None, least: float = 5.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Secrets of every whole text: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Base spans follow fixed patterns and always stay; the method adds runs that the model of random strings explains better
    (kind ``random``). Null and empty texts have no spans. Repeated rows are scanned each. Further columns are ignored.
    """
    ratio = fit_ratio(docs, doc_id=doc_id, text=text) if ratio is None else ratio
    d = docs.select(F.col(doc_id).alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    d = d.withColumn("__base", base_spans(F.col("__text")))
    d = d.withColumn("__all", all_spans(F.col("__text"), F.col("__base"), ratio, least))
    of_kind = lambda i: F.size(F.filter("__base", lambda s: s["kind"] == i)).cast("long")
    counts = [of_kind(i).alias(f"n_{k[0]}") for i, k in enumerate(KINDS)]
    return d.select("doc_id", *counts, F.sha2(span_text(F.col("__base")).cast("binary"), 256).alias("base_sha256"), span_text(F.col("__all")).alias("spans"))


def _replaced(text: Column, pattern: str, group: int, least: int, keep=None) -> Column:
    """Text with its secret matches replaced, put together again from gaps and matches in one pass."""
    whole, gaps = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.split(text, pattern, -1)
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
    secret = (lambda v: F.length(v) >= least) if keep is None else keep
    new = F.zip_with(whole, value, lambda m, v: F.when(secret(v), F.lit(MARK)).otherwise(m))
    return F.array_join(F.flatten(F.zip_with(gaps, new, lambda g, m: F.array(g, F.coalesce(m, F.lit(""))))), "")


def redact_secrets(docs: DataFrame, ratio: np.ndarray | None = None, least: float = 5.0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with every secret replaced by ``[SECRET]``; texts without one stay as they are, null stays null.

    The kinds are replaced one after the other, so a run that an earlier kind has taken is not looked at again.
    """
    ratio = fit_ratio(docs, doc_id=doc_id, text=text) if ratio is None else ratio
    out = docs
    for name, pattern, group, shortest in KINDS:
        out = out.withColumn(text, F.when(F.col(text).rlike(MAYBE[name]), _replaced(F.col(text), pattern, group, shortest)).otherwise(F.col(text)))
    some = F.col(text).rlike(RUN) & F.exists(F.regexp_extract_all(text, F.lit(RUN), F.lit(0)), lambda r: _is_random(r, ratio, least))
    return out.withColumn(text, F.when(some, _replaced(F.col(text), RUN, 0, 16, lambda r: _is_random(r, ratio, least))).otherwise(F.col(text)))


