"""Rolling history of a project: one step rule, used by the stream and by its batch twin."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from pagetext.operators.context import history_suffix
from pagetext.operators.folds import scan_groups
from pagetext.operators.prefix import previous_row, prefix_scan
from pagetext.streaming.keyed import fold_stream

OUT = "project int, page long, action string, reason string, page_count int, token_count long, appended int, evicted int"


def limits(budget: int, reserved: int) -> tuple[int, int]:
    return max(0, budget // 2 - reserved), max(0, budget - reserved)


def advance(held: list[int], tokens: int, low: int, high: int) -> tuple[list[int], str, int, int]:
    """History token counts after the previous page (``tokens``) is offered: (held, action, appended, evicted)."""
    total = sum(held)
    fits = tokens <= high
    if fits and total + tokens <= high:
        return [*held, tokens], "grow", 1, 0
    target = low - tokens if fits else low
    cut = 0
    if fits or total > high:
        while cut < len(held) and total > target:
            total -= held[cut]
            cut += 1
    kept = held[cut:] + ([tokens] if fits else [])
    return kept, "evict" if fits or cut else "reuse", int(fits), cut


class Tracker:
    """State of one project while its pages arrive in order."""

    def __init__(self, low: int, high: int, reserved: int, saved: str | None = None):
        self.low, self.high, self.reserved = low, high, reserved
        self.held, self.asked, self.recent, self.barrier, self.previous = json.loads(saved) if saved else (None, None, [], False, None)

    def dump(self) -> str:
        return json.dumps([self.held, self.asked, self.recent, self.barrier, self.previous])

    def request(self, page: int) -> tuple:
        """Outcome for one requested page: action, reason, page_count, token_count (with the reserved part), appended, evicted."""
        previous = self.previous
        why = ("window-empty" if self.held is None else "non-adjacent" if previous is None or previous[0] != self.asked
               else "previous-ineligible" if not previous[2] else None)
        if why:
            self.held = list(self.recent)
            got = ("rebuild" if self.held else "empty", why, 0, 0)
        else:
            self.held, action, added, evicted = advance(self.held, previous[1], self.low, self.high)
            got = (action, None if previous[1] <= self.high else "oversized-page", added, evicted)
        self.asked = page
        return (*got[:2], len(self.held), sum(self.held) + self.reserved, *got[2:])

    def seen(self, page: int, tokens: int, complete: bool) -> None:
        """Remember a page; ``recent`` is what a rebuild right after it would take."""
        self.previous = [page, tokens, complete]
        if not complete:
            return
        if tokens > self.high:
            self.barrier = True
            return
        self.recent = [tokens] if self.barrier else [*self.recent, tokens]
        self.barrier = False
        while len(self.recent) > 1 and sum(self.recent) > self.low:
            self.recent.pop(0)


def stream_history(pages: DataFrame, budget: int, reserved: int = 0) -> DataFrame:
    """Rolling history of a page stream: project, page, tokens, complete, requested; output as in ``OUT``.

    The state of a project is its window and the pages a rebuild would take, both bounded by the budget. A page before the last one
    handled is late and left out.
    """
    low, high = limits(budget, reserved)

    def step(saved, key: tuple, r) -> tuple:
        t = Tracker(low, high, reserved, saved)
        made = (key[0], r.page, *t.request(int(r.page))) if r.requested else None
        t.seen(int(r.page), int(r.tokens), bool(r.complete))
        return t.dump(), made

    return fold_stream(pages, ["project"], step, lambda r: (r.page,), OUT)


def rolling_history(pages: DataFrame, budget: int, reserved: int = 0) -> DataFrame:
    """Batch twin of ``stream_history``.

    A rebuild depends only on the pages before it, so it is taken from ``history_suffix`` and cuts the chain: the
    ordered fold runs per (project, segment) between rebuilds, with the bounded window as its only state.
    """
    low, high = limits(budget, reserved)
    c = F.col
    order = [c("page")]
    d = previous_row(pages.select("project", c("page").cast("long").alias("page"), c("tokens").cast("long").alias("tokens"), (c("complete") == 1).alias("ok"), c("requested")),
                     ["project"], order, F.struct("page", "tokens", "ok", "requested"), "p")
    asked_before = prefix_scan(d, ["project"], order, maxes_before={"last_asked": F.when(c("requested"), c("page"))})
    r = asked_before.filter("requested").withColumn("reason", F.when(c("last_asked").isNull(), "window-empty").when(~c("p.requested"), "non-adjacent").when(~c("p.ok"), "previous-ineligible"))
    r = prefix_scan(r, ["project"], order, sums={"segment": c("reason").isNotNull().cast("int")})
    suffix = history_suffix(pages, budget, reserved).join(r.filter("reason is not null").select("project", c("page").alias("request_page")), ["project", "request_page"], "left_semi")
    start = suffix.groupBy("project", c("request_page").alias("page")).agg(F.transform(F.array_sort(F.collect_list(F.struct("page", "tokens"))), lambda s: s["tokens"]).alias("start"))
    r = r.join(start, ["project", "page"], "left").select("project", "segment", "page", "reason", c("p.tokens").alias("prev_tokens"), "start")

    def init(row):
        return None

    def step(held, row):
        if row.reason is not None:
            held = [int(x) for x in row.start] if row.start is not None else []
            return held, (row.project, row.page, "rebuild" if held else "empty", row.reason, len(held), sum(held) + reserved, 0, 0)
        tokens = int(row.prev_tokens)
        held, action, added, evicted = advance(held, tokens, low, high)
        return held, (row.project, row.page, action, None if tokens <= high else "oversized-page", len(held), sum(held) + reserved, added, evicted)

    return scan_groups(r, ["project", "segment"], ["page"], init, step, OUT)
