"""History and summary windows under token budgets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetext.operators.prefix import prefix_scan, previous_row


def _bucket(c: Column, width: int) -> Column:
    return F.floor(c / width).cast("long")


def _members(asks: DataFrame, pages: DataFrame, key: Sequence[str], width: int) -> DataFrame:
    """Pages whose running sum before them lies in [lo, lo + width] of a request: a join on sum buckets.

    A bucket holds about one budget of tokens, so a key with very many pages is spread over as many buckets.
    """
    p = pages.withColumn("__b", _bucket(F.col("before"), width))
    a = asks.withColumn("__b", F.explode(F.array(_bucket(F.col("lo"), width), _bucket(F.col("lo"), width) + 1)))
    return a.join(p, [*key, "__b"]).filter("before >= lo").drop("__b")


def history_suffix(pages: DataFrame, budget: int, reserved: int = 0, key: Sequence[str] = ("project",)) -> DataFrame:
    """History of every page: rows (key, request_page, page, tokens), the newest fitting suffix of complete pages.

    pages: key, page (long), tokens, complete. The suffix stays under half the budget less ``reserved``; a newest
    page above that but within the budget stands alone; pages over the budget are skipped while nothing is selected.
    """
    key, c = list(key), F.col
    low, high = max(0, budget // 2 - reserved), max(0, budget - reserved)
    width = max(low, 1)
    d = pages.select(*key, c("page").cast("long").alias("page"), c("tokens").cast("long").alias("tokens"), (c("complete") == 1).alias("ok"))
    order = [c("page")]
    d = prefix_scan(d, key, order, sums={"upto": F.when(c("ok"), c("tokens")).otherwise(0)}).withColumn("before", c("upto") - F.when(c("ok"), c("tokens")).otherwise(0))
    fits = c("ok") & (c("tokens") <= high)
    asks = prefix_scan(d, key, order, maxes_before={"last": F.when(fits, c("page")), "last_upto": F.when(fits, c("upto")), "last_before": F.when(fits, c("before"))})
    asks = asks.filter("last is not null").select(*key, c("page").alias("request_page"), "last", "last_upto", "last_before")
    alone = c("last_upto") - c("last_before") > low
    asks = asks.withColumn("lo", F.when(alone, c("last_before")).otherwise(c("last_upto") - low)).withColumn("alone", alone)
    src = d.filter("ok").select(*key, "page", "tokens", "before")
    out = _members(asks, src, key, width).filter((c("page") <= c("last")) & (~c("alone") | (c("page") == c("last"))))
    return out.select(*key, "request_page", "page", "tokens")


def fit_summaries(summaries: DataFrame, budget: int, key: Sequence[str] = ("project",)) -> DataFrame:
    """Summaries kept for every page: its own always, then older ones newest first while the sum stays in budget."""
    key, c = list(key), F.col
    width = max(budget, 1)
    d = summaries.select(*key, c("page").cast("long").alias("page"), c("tokens").cast("long").alias("tokens"))
    d = prefix_scan(d, key, [c("page")], sums={"upto": c("tokens")}).withColumn("before", c("upto") - c("tokens"))
    asks = d.select(*key, c("page").alias("request_page"), (c("upto") - budget).alias("lo"))
    older = _members(asks, d.select(*key, "page", "tokens", "before"), key, width).filter("page < request_page").select(*key, "request_page", "page", "tokens")
    return older.unionByName(d.select(*key, c("page").alias("request_page"), "page", "tokens"))


def rebuild_reason(pages: DataFrame, windows: DataFrame, key: Sequence[str] = ("project",)) -> DataFrame:
    """Why the window of a page cannot be reused, null where it can.

    pages: key, page, load_id, settings; windows: key, page, window_page, window_load_id, window_settings.
    """
    key, c = list(key), F.col
    d = previous_row(pages, key, [c("page")], c("page"), "previous_page").join(windows, [*key, "page"], "left")
    reason = (F.when(c("window_page").isNull(), "window-empty").when(c("load_id").isNull(), "missing-load-identity")
              .when(~c("load_id").eqNullSafe(c("window_load_id")), "project-changed").when(~c("settings").eqNullSafe(c("window_settings")), "settings-changed")
              .when(~c("previous_page").eqNullSafe(c("window_page")), "non-adjacent"))
    return d.select(*key, "page", reason.alias("reason"))


def eligible_pages(blocks: DataFrame, info: DataFrame, target: str) -> DataFrame:
    """Pages usable as history: translated, same (or no recorded) target, every non-blank source translated.

    blocks: page, source, translation; info: page, finish_code, translation_target.
    """
    from pagetext.functions import text as tx
    from pagetext.operators.ledger import TRANSLATED, page_done

    c = F.col
    real = ~tx.is_empty_text(c("source"))
    full = blocks.groupBy("page").agg(F.count_if(real).alias("n"), F.bool_and(~real | ~tx.is_empty_text(c("translation"))).alias("all"))
    ok = page_done(c("finish_code"), TRANSLATED) & (c("translation_target").isNull() | (c("translation_target") == target))
    return info.filter(ok).join(full.filter("n > 0 and all"), "page", "left_semi")
