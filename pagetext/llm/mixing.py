"""Mixing sources to target weights (native): hash-random order, distributed prefix sums, a cut at each exact budget."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetext.llm.common import id_key, running_totals, stored, word_count
from pagetext.session import cut_lineage

GROUP = ["__none", "__src"]  # a source without nulls: (is null, text); false sorts first, so null is last


def _keyed(df: DataFrame, source: str) -> DataFrame:
    return df.withColumn("__none", F.col(source).isNull()).withColumn("__src", F.coalesce(F.col(source).cast("string"), F.lit("")))


def source_targets(sizes: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3) -> DataFrame:
    """Targets of sources given as (``__none``, ``__src``, ``source_size``).

    Sources in code point order, null last, weigh ``weights`` repeating. They share the sum of all sizes by weight; a
    target stops at ``max_epochs`` times its size and the excess is shared again by weight until none is above.
    That fixed point is target = min(cap, weight * level). Over the sources sorted by cap / weight the level is the
    largest of (all - caps before) / (weights - weights before), so no loop over the sources is needed.
    """
    ranked = running_totals(sizes, [], GROUP, {"__rank": F.lit(1).cast("long")})
    turn = (F.col("__rank") - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(int(w)).cast("long") for w in weights]), (turn + 1).cast("int"))
    ranked = cut_lineage(ranked.withColumn("__w", weight).withColumn("__cap", F.col("source_size") * max_epochs)
                         .withColumn("__ratio", F.col("__cap").cast("double") / F.col("__w")))
    total, shares = ranked.agg(F.sum("source_size"), F.sum("__w")).first()
    if not total:
        return ranked.select(*GROUP, "source_size", F.lit(0.0).alias("target"))
    filled = running_totals(ranked, [], ["__ratio", *GROUP], {"__caps": F.col("__cap"), "__ws": F.col("__w")})
    left = (F.lit(total) - (F.col("__caps") - F.col("__cap"))).cast("double")
    level = filled.agg(F.max(left / (F.lit(shares) - (F.col("__ws") - F.col("__w"))).cast("double"))).first()[0]
    target = F.least(F.col("__cap").cast("double"), F.col("__w") * F.lit(level))
    return ranked.select(*GROUP, "source_size", target.alias("target"))


def _budgeted(units: DataFrame, order: Sequence[str], weights: Sequence[int], max_epochs: int) -> DataFrame:
    """Units (``GROUP``, ``size``, order columns) with ``source_size``, ``target``, whole ``__epochs`` and ``__fit``.

    ``__fit`` is how many words of the unit still fit into the source's last, partial epoch.
    """
    sizes = units.groupBy(*GROUP).agg(F.sum("size").alias("source_size"))
    facts = source_targets(sizes, weights, max_epochs)
    placed = running_totals(units, GROUP, order, {"__upto": F.col("size")}, facts)
    budget = F.floor(F.col("target") + 0.5)
    placed = placed.withColumn("__epochs", F.when(F.col("source_size") > 0, F.floor(F.expr("floor(target + 0.5) div source_size"))).otherwise(0))
    rest = budget - F.col("__epochs") * F.col("source_size")
    return placed.withColumn("__fit", F.least(F.greatest(rest - (F.col("__upto") - F.col("size")), F.lit(0)), F.col("size")))


def mix_sources(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix",
                doc_id: str = "doc_id", source: str = "source", text: str = "text", size: Column | None = None) -> DataFrame:
    """How much of every document the mix takes: doc_id, source, size, source_size, target, taken.

    Every row gets a hash-random key from its id; rows are range-sorted by (source, key), the prefix sums of their
    sizes are computed across ranges, and the source's budget (its target, rounded) is cut exactly: whole epochs for
    all rows, then the rows that still fit, of the row on the border only the words that fit. Reruns agree.

    Null text and text without words: size 0, taken 0. Null source: a source of its own, last in order. Repeated ids
    and repeated rows each count on their own; among rows equal in id and size it is left open which one is cut. No
    rows: no rows. Further columns are ignored.
    """
    d = docs.select(F.col(doc_id).alias("__id"), F.col(source).alias("__source"),
                    (word_count(F.col(text)) if size is None else size.cast("long")).alias("size"))
    d = _keyed(d, "__source").withColumn("__key", id_key(F.col("__id"), seed))
    out = _budgeted(d, ["__key", "__id", "size"], weights, max_epochs)
    return out.select(F.col("__id").alias("doc_id"), F.col("__source").alias("source"), "size", "source_size", "target",
                      (F.col("__epochs") * F.col("size") + F.col("__fit")).cast("long").alias("taken"))


def repeat_to_mix(docs: DataFrame, weights: Sequence[int] = (1, 2, 3), max_epochs: int = 3, seed: str = "mix",
                  doc_id: str = "doc_id", source: str = "source", text: str = "text") -> DataFrame:
    """The mixed corpus itself: whole rows of ``docs``, repeated as often as the mix takes them.

    Every row is a unit of its own, with or without an id and whether or not others share it. Rows are ordered by the hash-random key of
    their id, those without one by that of their text, so they lie anywhere in the order. The row on the border of a budget is
    taken if at least half of it fits. A document without words is never taken. Among rows equal in id and text it is left open which one is cut.
    """
    # The numbers of the rows are cut into stored rows, so that a second look at them finds the same ones.
    keyed = stored(_keyed(docs.withColumn("__row", F.monotonically_increasing_id()), source), "rows")
    words_of = F.md5(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    key = F.when(F.col(doc_id).isNull(), id_key(words_of, seed)).otherwise(id_key(F.col(doc_id), seed))
    units = keyed.select(*GROUP, "__row", word_count(F.col(text)).alias("size"), key.alias("__key"), F.xxhash64(text).alias("__text"))
    planned = _budgeted(units, ["__key", "__text", "__row"], weights, max_epochs)
    times = F.col("__epochs") + F.when(F.col("__fit") * 2 >= F.col("size"), 1).otherwise(0)
    planned = planned.filter("size > 0").select("__row", times.cast("int").alias("__times")).filter("__times > 0")
    return (keyed.join(planned, "__row").withColumn("__copy", F.explode(F.sequence(F.lit(1), F.col("__times"))))
            .select(*docs.columns))
