"""Glossary matching, terminology audit and votes, search and replace."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StringType, StructField, StructType

from pagetext.functions import text as tx
from pagetext.functions.arrays import bound, prefix_sums
from pagetext.operators.automaton import build_automaton, entries_in
from pagetext.operators.ledger import folded
from pagetext.operators.prefix import prefix_scan
from pagetext.session import cut_lineage

SPAN_BYTES = 1 << 23  # bytes of text whose letters are taken at a time
SPREAD = 16  # parts of a glossary that goes to every key

# Sound words that are no names.
SOUND_WORDS = ("ドキドキ", "ワクワク", "ニコニコ", "イライラ", "ハラハラ")


def first_n(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """First ``n`` rows per key. Spark limits each task to ``n`` rows per key before the shuffle (window group limit)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("rn", F.row_number().over(w)).filter(F.col("rn") <= n)


def match_glossary(texts: DataFrame, glossary: DataFrame, key: Sequence[str] = ("page",), mode: str = "matching",
                   fold: bool = True, joiner: str = "\n", order: str | None = None, part_bytes: int = 1 << 18) -> DataFrame:
    """Glossary entries occurring in the texts of each key, once per key: key columns and ``entry_idx``.

    Terms hold no line break, so with the default joiner a match lies inside one text row. ``joiner=''`` lets terms
    cross row borders; the rows of a key (one page's prompt) are then joined in ``order`` first. ``mode='all'`` gives
    every key the whole glossary.

    The glossary is dealt by hash into parts of about ``part_bytes`` bytes. While the plan is built, each part is fetched and made an automaton,
    which is sent to the executors and run once over every text; texts are not shuffled, only their matches are. An empty term is
    in every text; null terms and null texts match nothing.
    """
    key = list(key)
    norm = folded if fold else (lambda c: c)
    if mode == "all":
        part = F.pmod(F.xxhash64("entry_idx"), F.lit(SPREAD))
        spread = texts.select(*key).distinct().withColumn("__part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(SPREAD - 1).cast("bigint"))))
        return spread.join(glossary.select("entry_idx", part.alias("__part")), "__part").select(*key, "entry_idx")
    if joiner == "":
        ordered = F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("text").alias("t")))), lambda s: s["t"])
        texts = texts.groupBy(*key).agg(F.array_join(ordered, "").alias("text"))
    g = glossary.select("entry_idx", norm(F.col("source")).alias("s")).filter("s is not null")
    d = texts.select(*key, norm(F.col("text")).alias("t")).filter("t is not null")
    kind = glossary.schema["entry_idx"].dataType
    schema = StructType([*[d.schema[k] for k in key], StructField("entry_idx", kind)])
    parts = -(-(g.agg(F.sum(F.octet_length("s"))).first()[0] or 0) // part_bytes) or 1
    found = None
    for part in range(parts):
        own = g.filter(F.pmod(F.xxhash64("s", "entry_idx"), F.lit(parts)) == part).toArrow().sort_by([("s", "ascending"), ("entry_idx", "ascending")])
        one = d.mapInArrow(_entries_of(d.sparkSession.sparkContext.broadcast(_compiled(own)), schema.names, to_arrow_type(kind)), schema)
        found = one if found is None else found.unionByName(one)
    return found.distinct()


def _compiled(part: pa.Table) -> tuple:
    """(automaton, (entries by term, where each term's begin), entries of empty terms) of rows sorted by term."""
    terms, numbers = [t.encode() for t in part["s"].to_pylist()], np.array(part["entry_idx"].to_pylist(), np.int64)
    empty = sum(1 for t in terms if not t)
    heads = [i for i in range(empty, len(terms)) if i == empty or terms[i] != terms[i - 1]]
    return build_automaton([terms[i] for i in heads]), (numbers, np.array([*heads, len(terms)], np.int64)), numbers[:empty]


def _entries_of(shared, names: Sequence[str], kind: pa.DataType):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto, entries, always = shared.value
        for b in batches:
            keys = b.columns[:-1]
            for row, entry in entries_in(b.column(b.num_columns - 1), auto, entries, always):
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[k.take(at) for k in keys], pa.array(entry).cast(kind)], names=list(names))
    return run


def render_glossary(matches: DataFrame, glossary: DataFrame, key: Sequence[str] = ("page",), form: str = "json") -> DataFrame:
    """Selected entries per key in file order, as compact JSON or ``a->b`` lines."""
    d = matches.join(glossary, "entry_idx")
    piece = F.to_json(F.struct("source", "translation", "note")) if form == "json" else F.concat("source", F.lit("->"), "translation")
    rows = F.transform(F.array_sort(F.collect_list(F.struct("entry_idx", piece.alias("p")))), lambda s: s["p"])
    body = F.concat(F.lit('{"glossary":['), F.array_join(rows, ","), F.lit("]}")) if form == "json" else F.array_join(rows, "\n")
    return d.groupBy(*key).agg(body.alias("rendered"))


def dedupe_glossary(glossary: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries, conflicts). Equal rows stay once; a source with another translation than its first is a conflict."""
    d = glossary.withColumn("fold", folded(F.col("source")))
    first = d.groupBy("fold").agg(F.min_by(F.struct(F.col("entry_idx").alias("first_idx"), F.col("translation").alias("first_translation")), "entry_idx").alias("f"))
    d = d.join(first, "fold").select(*glossary.columns, "f.*")
    good = d.filter(F.col("translation") == F.col("first_translation"))
    entries = good.groupBy("source", "translation", "note").agg(F.min("entry_idx").alias("entry_idx"))
    conflicts = d.filter(F.col("translation") != F.col("first_translation")).select("entry_idx", "source", "translation", "first_idx", "first_translation")
    return entries, conflicts


def term_occurrences(ledger: DataFrame, glossary: DataFrame, pattern: str = tx.KATAKANA_RUN, stop: Sequence[str] = SOUND_WORDS) -> DataFrame:
    """One row per occurrence: entity, page, source_id, translation, from_glossary.

    Glossary terms count once per row; pattern matches of 2 to 8 letters count each time.
    """
    src = ledger.select("page", "source_id", F.col("source").alias("text"), "translation")
    terms = (match_glossary(src, glossary, ["page", "source_id", "translation"], fold=False)
             .join(glossary.select("entry_idx", F.col("source").alias("entity")), "entry_idx").select("page", "source_id", "translation", "entity").distinct()
             .select("entity", "page", "source_id", "translation", F.lit(True).alias("from_glossary")))
    named = (src.select(F.explode(tx.entities(F.col("text"), pattern)).alias("entity"), "page", "source_id", "translation", F.lit(False).alias("from_glossary"))
             .filter(F.length("entity").between(2, 8) & ~F.col("entity").isin(list(stop))))
    return terms.unionByName(named)


def audit_terms(occurrences: DataFrame, glossary: DataFrame) -> DataFrame:
    """Per entity: occurrences, distinct pages, whether in the glossary and its target.

    The page list of an entity is ``entity_pages``: a common entity may be on a third of all pages, so it stays rows.
    """
    counts = (occurrences.groupBy("entity", "page").agg(F.count(F.lit(1)).alias("n"))
              .groupBy("entity").agg(F.sum("n").alias("occurrences"), F.count(F.lit(1)).alias("pages")))
    target = glossary.groupBy(F.col("source").alias("entity")).agg(F.max_by("translation", "entry_idx").alias("target"))
    return counts.join(target, "entity", "left").withColumn("in_glossary", F.col("target").isNotNull())


def entity_pages(occurrences: DataFrame) -> DataFrame:
    return occurrences.select("entity", "page").distinct()


def entity_samples(occurrences: DataFrame, n: int = 5) -> DataFrame:
    return first_n(occurrences, ["entity"], [F.col("page"), F.col("source_id"), F.col("from_glossary").desc()], n)


def audit_totals(occurrences: DataFrame, glossary: DataFrame) -> DataFrame:
    a = occurrences.select("entity").distinct().agg(F.count(F.lit(1)).alias("entities"))
    b = glossary.select("source").distinct().agg(F.count(F.lit(1)).alias("glossary_terms"))
    return a.withColumn("k", F.lit(1)).join(b.withColumn("k", F.lit(1)), "k").drop("k")


def vote_terms(candidates: DataFrame) -> DataFrame:
    """Most frequent translation per entity (smallest text on ties); ``conflict`` if there is more than one."""
    n = candidates.groupBy("entity", "candidate").agg(F.count(F.lit(1)).alias("n"))
    return n.groupBy("entity").agg(F.min_by("candidate", F.struct(-F.col("n"), F.col("candidate"))).alias("winner"), F.sum("n").alias("votes"),
                                   F.count(F.lit(1)).alias("candidates")).withColumn("conflict", F.col("candidates") > 1)


def apply_terms(ledger: DataFrame, replacements: Sequence[tuple[str, str]] | DataFrame, column: str = "translation", part_chars: int = 1 << 22) -> DataFrame:
    """Literal replacements in order (chained); adds ``changed``.

    ``replacements``: pairs, or a table with ``old``, ``new`` and ``at`` (distinct numbers in order). A table is folded over each text in
    parts of about ``part_chars`` characters, one broadcast row each, so its size doesn't matter to the plan or the driver.
    """
    out = ledger.withColumn("__new", F.col(column))
    if isinstance(replacements, DataFrame):
        pairs = replacements.select("at", "old", "new").filter("old is not null and new is not null and old <> ''")
        size = (F.length("old") + F.length("new") + 16).cast("long")
        pairs = cut_lineage(prefix_scan(pairs.withColumn("k", F.lit(0)), ["k"], [F.col("at")], sums={"upto": size}).withColumn("part", F.floor(F.col("upto") / part_chars)))
        for part in range((pairs.agg(F.max("part")).first()[0] or 0) + 1):
            row = pairs.filter(F.col("part") == part).groupBy(F.lit(0).alias("__k")).agg(F.array_sort(F.collect_list(F.struct("at", "old", "new"))).alias("__pairs"))
            out = out.withColumn("__k", F.lit(0)).join(F.broadcast(row), "__k", "left").drop("__k")
            folded_text = F.aggregate("__pairs", F.col("__new"), lambda t, p: F.replace(t, p["old"], p["new"]))
            out = out.withColumn("__new", F.when(F.col("__pairs").isNull(), F.col("__new")).otherwise(folded_text)).drop("__pairs")
    else:
        for old, to in replacements:
            if old:
                out = out.withColumn("__new", F.replace("__new", F.lit(old), F.lit(to)))
    return out.withColumn("changed", ~F.col("__new").eqNullSafe(F.col(column))).withColumn(column, F.col("__new")).drop("__new")


def change_summary(changed: DataFrame) -> DataFrame:
    return changed.filter("changed").groupBy("page").agg(F.count(F.lit(1)).alias("changed_rows"))


def search(df: DataFrame, pattern: str | None, columns: Sequence[str], key: Sequence[str]) -> DataFrame:
    """Hits per row and searched column (rows with hits only)."""
    if pattern is None:
        return df.select(*key, F.lit("").alias("field"), F.lit(0).alias("hits")).limit(0)
    fields = F.array(*[F.struct(F.lit(c).alias("field"), F.regexp_count(c, F.lit(pattern)).alias("hits")) for c in columns])
    return df.select(*key, F.inline(fields)).filter("hits > 0")


def search_spans(df: DataFrame, pattern: str, column: str, key: Sequence[str]) -> DataFrame:
    """0-based start and length of every hit: key, n, start, length; from running lengths of the gaps and hits inside each row.

    Nothing leaves its row, so there is no shuffle; a row's work grows with its text.
    """
    pieces = F.arrays_zip(F.split(column, pattern, -1).alias("gap"), F.regexp_extract_all(column, F.lit(pattern), F.lit(0)).alias("hit"))
    sized = lambda p: F.struct(p["hit"].alias("hit"), F.length(p["gap"]).alias("before"), F.coalesce(F.length(p["hit"]), F.lit(0)).alias("length"))

    def placed(ps: Column) -> Column:
        before = prefix_sums(F.transform(ps, lambda p: p["before"] + p["length"]))
        made = lambda p, b: F.struct(p["hit"].alias("hit"), (b + p["before"]).cast("int").alias("start"), p["length"].alias("length"))
        return F.zip_with(ps, before, made)

    d = df.select(*key, F.posexplode(bound(F.transform(pieces, sized), placed)).alias("n", "p"))
    return d.filter("p.hit is not null and p.hit <> ''").select(*key, "n", "p.start", "p.length")


def word_spans(df: DataFrame, column: str, key: Sequence[str]) -> DataFrame:
    """Words of two letters or more for the spelling check: key, n, start, length, word; places in UTF-16 units, as text editors count.

    Works on the letters of whole batches at once; nothing leaves its row, so there is no shuffle. Null texts have no words.
    """
    d = df.select(*key, F.col(column).alias("__text")).filter("__text is not null")
    more = [StructField(c, IntegerType()) for c in ("n", "start", "length")]
    schema = StructType([*[d.schema[k] for k in key], *more, StructField("word", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        letters = tx.checked_letters()
        for whole in batches:
            size = pc.binary_length(whole.column(whole.num_columns - 1)).to_numpy(zero_copy_only=False)
            part = np.cumsum(size, dtype=np.int64) // SPAN_BYTES
            for p in np.unique(part):
                rows = np.flatnonzero(part == p)
                b = whole.slice(rows[0], len(rows))
                row, *spans, word = letter_spans(b.column(b.num_columns - 1).to_pylist(), letters, 2)
                at = pa.array(row)
                yield pa.RecordBatch.from_arrays([*[k.take(at) for k in b.columns[:-1]], *[pa.array(x.astype(np.int32)) for x in spans], word], names=schema.names)

    return d.mapInArrow(run, schema)


def letter_spans(texts: Sequence[str], letters: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
    """(text, number in the text, start, length, letters) of every stretch of at least ``least`` of the given letters, in UTF-16 units."""
    laid = "\n".join(texts) + "\n"  # a line end is no letter
    codes = np.frombuffer(laid.encode("utf-32-le", "surrogatepass"), np.uint32)
    inside = letters[codes].view(np.int8)
    edge = np.diff(inside, prepend=np.int8(0))
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    begin, end = begin[end - begin >= least], end[end - begin >= least]
    first = np.cumsum([0] + [len(t) + 1 for t in texts])  # where a text begins
    text = np.searchsorted(first, begin, side="right") - 1
    number = np.arange(len(begin)) - np.searchsorted(text, text)
    units = np.concatenate([[0], np.cumsum(1 + (codes > 0xFFFF), dtype=np.int64)])
    octets = np.concatenate([[0], np.cumsum(1 + (codes > 0x7F).astype(np.int8) + (codes > 0x7FF) + (codes > 0xFFFF), dtype=np.int64)])
    raw = np.frombuffer(laid.encode(), np.uint8)
    edges = np.zeros(len(raw) + 1, np.int8)
    edges[octets[begin]] = 1
    edges[octets[end]] = -1
    values = raw[np.cumsum(edges[:-1], dtype=np.int8).view(bool)]
    cuts = np.concatenate([[0], np.cumsum(octets[end] - octets[begin])]).astype(np.int32)
    word = pa.StringArray.from_buffers(len(begin), pa.py_buffer(cuts), pa.py_buffer(np.ascontiguousarray(values)))
    return text, number, units[begin] - units[first[text]], units[end] - units[begin], word


def replace_all(df: DataFrame, pattern: str, replacement: str, column: str, key: Sequence[str]) -> DataFrame:
    """Rows with a hit: text before and after."""
    d = df.filter(F.col(column).rlike(pattern))
    return d.select(*key, F.col(column).alias("before"), F.regexp_replace(column, pattern, replacement.replace("\\", "\\\\").replace("$", "\\$")).alias("after"))
