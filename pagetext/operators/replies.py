"""Model replies: parsing, alignment, request assembly and user functions over batches of texts."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetext.functions import text as tx
from pagetext.operators.folds import fold_groups
from pagetext.operators.prefix import per_key, prefix_scan
from pagetext.session import cut_lineage


def _pin(df: DataFrame, keep: Sequence[str], **made: Column) -> DataFrame:
    """Compute columns once behind a generator; plain projections would be merged and parse the text again per use."""
    return df.select(*keep, F.inline(F.array(F.struct(*[c.alias(k) for k, c in made.items()]))))


def json_body(c: Column) -> Column:
    """The JSON object of a reply: inside a fence, else from the first to the last brace, else the text itself."""
    t = tx.strip(c)
    fenced = F.regexp_extract(t, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    bare = F.regexp_extract(t, r"(?s)\{.*\}", 0)
    return F.when(fenced != "", fenced).when(bare != "", bare).otherwise(t)


def parse_replies(df: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(translations, summaries, rejects) of replies with columns ``key``, content, expected.

    Accepted: {"1": text}, {"translations": {..}} or {"translations": [{id, translation}]}; ids must be exactly
    1..expected. With expected 0 only a usable summary is needed.
    """
    key = list(key)
    c = F.col
    d = _pin(df, [*key, "expected"], body=json_body(c("content")))
    d = _pin(d, [*key, "expected", "body"], top=F.from_json("body", "map<string,string>"), doc=F.try_parse_json("body"))
    summary = F.when(F.schema_of_variant(F.try_variant_get("doc", "$.page_summary", "variant")) == "STRING",
                     tx.collapse(F.try_variant_get("doc", "$.page_summary", "string")))
    digits = lambda m: F.forall(F.map_keys(m), lambda k: k.rlike("^[0-9]+$"))
    inner = F.try_element_at("top", F.lit("translations"))
    items = F.when(F.map_contains_key("top", "translations"), inner).when(digits("top"), c("body"))
    d = _pin(d, [*key, "expected"], valid=c("doc").isNotNull(), summary=F.coalesce(summary, F.lit("")), items=tx.strip(items))
    d = _pin(d, [*key, "expected", "valid", "summary"], m=F.when(c("items").startswith("{"), F.from_json("items", "map<string,string>")),
             l=F.when(c("items").startswith("["), F.from_json("items", "array<struct<id:string,translation:string>>")))
    pairs = (F.when(c("m").isNotNull() & digits("m"), F.transform(F.map_entries("m"), lambda e: F.struct(e["key"].try_cast("int").alias("id"), e["value"].alias("text"))))
             .when(c("l").isNotNull(), F.transform("l", lambda e: F.struct(e["id"].try_cast("int").alias("id"), e["translation"].alias("text")))))
    d = _pin(d, [*key, "expected", "valid", "summary"], pairs=pairs).withColumn("ids", F.array_sort(F.transform("pairs", lambda p: p["id"])))
    reason = (F.when(~c("valid"), "invalid_json")
              .when(c("expected") == 0, F.when(c("summary") == "", "no_summary"))
              .when(c("pairs").isNull(), "unsupported_payload")
              .when(F.size(F.array_distinct("ids")) != F.size("ids"), "duplicate_id")
              .when(c("ids") != F.sequence(F.lit(1), F.greatest("expected", F.lit(1))), "wrong_ids"))
    d = _pin(d, [*key, "expected", "summary", "pairs"], reason=reason)
    good = d.filter("reason is null")
    rows = good.filter("expected > 0").select(*key, F.inline("pairs"))
    return (rows, good.filter("summary <> ''").select(*key, "summary"), d.filter("reason is not null").select(*key, "reason"))


def parse_page_text(df: DataFrame, key: Sequence[str], with_order: bool = True) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of strict page replies {"texts": {id: text}, "order": [id]}; any fault rejects the page."""
    key = list(key)
    c = F.col
    want = F.transform(F.sequence(F.lit(1), F.greatest("expected", F.lit(1))), lambda i: i.cast("string"))
    d = _pin(df, [*key, "expected"], body=tx.strip(c("content")))
    d = _pin(d, [*key, "expected"], valid=F.try_parse_json("body").isNotNull(), top=F.from_json("body", "map<string,string>"),
             p=F.from_json("body", "struct<texts:map<string,variant>,order:array<variant>>"))
    fields = F.array_sort(F.map_keys("top"))
    need = F.array(*[F.lit(f) for f in (["order", "texts"] if with_order else ["texts"])])
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    same = lambda a: (F.size(a) == F.size(want)) & (F.size(F.array_except(a, want)) == 0) & (F.size(F.array_except(want, a)) == 0)
    order = F.transform("p.order", lambda v: F.try_variant_get(v, "$", "string"))
    reason = (F.when(~c("valid"), "invalid_json").when(F.coalesce(fields != need, F.lit(True)), "wrong_fields")
              .when(F.coalesce(~same(F.map_keys("p.texts")), F.lit(True)), "wrong_ids")
              .when(~F.forall(F.map_values("p.texts"), is_text), "not_a_string"))
    if with_order:
        reason = reason.when(F.coalesce(~F.forall("p.order", is_text) | ~same(order), F.lit(True)), "wrong_order")
    d = _pin(d, [*key, "p"], reason=reason, order=order)
    rows = d.filter("reason is null").select(*key, "order", F.explode(F.map_entries("p.texts")).alias("e"))
    pos = F.array_position("order", c("e.key")).cast("int") if with_order else F.lit(None).cast("int")
    return (rows.select(*key, c("e.key").cast("int").alias("id"), tx.collapse(F.try_variant_get("e.value", "$", "string")).alias("text"), pos.alias("position")),
            d.filter("reason is not null").select(*key, "reason"))


def align_replies(blocks: DataFrame, page_replies: DataFrame, block_replies: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(ledger rows, recovery list) from line replies.

    blocks: page, source_id, position (1..n); page_replies: page, content; block_replies: page, source_id, content
    (one request per block, only used where the page reply does not align). A recovered page needs exactly one
    line for every block, otherwise it yields nothing; recovered pages are marked for review.
    """
    c = F.col
    lines = page_replies.select("page", F.transform(tx.reply_lines(c("content")), lambda x: tx.unquote(tx.strip(x))).alias("lines"))
    n = blocks.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    state = n.join(lines.select("page", F.size("lines").alias("m")), "page", "left").withColumn("aligned", F.coalesce(c("n") == c("m"), F.lit(False)))
    exact = (lines.join(state.filter("aligned"), "page", "left_semi").select("page", F.posexplode("lines").alias("i", "translation"))
             .select("page", (c("i") + 1).alias("position"), "translation"))
    direct = blocks.join(exact, ["page", "position"]).select("page", "source_id", "position", "translation", F.lit(False).alias("review"))
    lost = blocks.join(state.filter("not aligned").select("page"), "page", "left_semi")
    single = block_replies.select("page", "source_id", F.transform(tx.reply_lines(c("content")), lambda x: tx.unquote(tx.strip(x))).alias("l"))
    tried = lost.join(single, ["page", "source_id"], "left").withColumn("good", F.coalesce((F.size("l") == 1) & (tx.strip(F.get("l", F.lit(0))) != ""), F.lit(False)))
    tried = per_key(tried, ["page"], F.bool_and("good").alias("page_good"))
    recovered = tried.filter("page_good").select("page", "source_id", "position", F.get("l", F.lit(0)).alias("translation"), F.lit(True).alias("review"))
    todo = tried.filter("not page_good").select("page", "source_id", F.when(c("l").isNull(), "request").when(~c("good"), "bad_reply").otherwise("page_incomplete").alias("action"))
    return direct.unionByName(recovered), todo


def _quoted(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.struct(c.alias("s"))), r'(?s)^\{"s":(.*)\}$', "$1")


def build_requests(blocks: DataFrame, source_lang: str, target_lang: str, system: str = "Translate comic text.", glossary: DataFrame | None = None,
                   summaries: DataFrame | None = None, full_glossary: str | None = None, memory: DataFrame | None = None, history: DataFrame | None = None) -> DataFrame:
    """Messages per page: (page, seq, role, content), in the order system, full glossary, memory, history, current.

    blocks: page, position, source; glossary/summaries: page, rendered; memory: page, text; history: page, pos,
    user, assistant. One page's prompt is one value, so only the blocks of a page meet in one place.
    """
    c = F.col
    item = F.concat(F.lit('  {\n    "id": '), c("position").cast("string"), F.lit(',\n    "source": '), _quoted(c("source")), F.lit("\n  }"))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("position", item.alias("t")))), lambda s: s["t"])
    d = blocks.groupBy("page").agg(F.concat(F.lit("[\n"), F.array_join(listed, ",\n"), F.lit("\n]")).alias("input"))
    prompt = F.concat(F.lit(f"Translate the following JSON array from {source_lang} to {target_lang}.\n\nINPUT:\n"), c("input"))
    if summaries is not None:
        d = d.join(summaries.select("page", c("rendered").alias("summary")), "page", "left")
        prompt = F.concat(F.coalesce(F.concat(c("summary"), F.lit("\n\n")), F.lit("")), prompt)
    if glossary is not None:
        d = d.join(glossary.select("page", c("rendered").alias("terms")), "page", "left")
        prompt = F.concat(prompt, F.coalesce(F.concat(F.lit("\n\nGLOSSARY:\n"), c("terms")), F.lit("")))

    def message(df: DataFrame, group: int, role: str, content: Column, sub: Column | None = None) -> DataFrame:
        return df.select("page", F.lit(group).alias("part"), (sub if sub is not None else F.lit(0)).cast("int").alias("sub"), F.lit(role).alias("role"), content.alias("content"))

    out = message(d, 0, "system", F.lit(system)).unionByName(message(d, 4, "user", prompt))
    if full_glossary:
        out = out.unionByName(message(d, 1, "system", F.lit(full_glossary)))
    if memory is not None:
        out = out.unionByName(message(memory.join(d.select("page"), "page", "left_semi"), 2, "system", c("text")))
    if history is not None:
        h = history.join(d.select("page"), "page", "left_semi")
        out = out.unionByName(message(h, 3, "user", c("user"), c("pos") * 2)).unionByName(message(h, 3, "assistant", c("assistant"), c("pos") * 2 + 1))
    return prefix_scan(out, ["page"], [c("part"), c("sub")], number="seq").drop("part", "sub")


BATCH_FNS: dict[str, Callable[[list[str]], list[str]]] = {}


def register_batch_fn(name: str, fn: Callable[[list[str]], list[str]]) -> None:
    """Register a text function: a list of strings in, a list of the same length out."""
    if name in BATCH_FNS:
        raise ValueError(f"function {name} is registered already")
    BATCH_FNS[name] = fn


def apply_batch_fn(df: DataFrame, fn: str | Callable[[list[str]], list[str]], order: str = "source_id", batch_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows with ``result``, rejects with ``reason``) of a registered function over the texts of a page.

    df: page, <order> (integer), text. The function gets all texts of a page at once, or lists of ``batch_rows`` if the caller
    asks for them. Wrong lengths and errors reject the list, not the job. The answers are cut into the checkpoint folder, so
    the function runs once however often rows and rejects are read.
    """
    call = BATCH_FNS[fn] if isinstance(fn, str) else fn
    c = F.col
    d = df.select("page", F.lit(0).cast("long").alias("part"), order, "text")
    if batch_rows:
        d = prefix_scan(df.select("page", order, "text"), ["page"], [c(order)], number="rn")
        d = d.withColumn("part", F.floor((c("rn") - 1) / batch_rows)).select("page", "part", order, "text")

    def fold(rows: list) -> list[tuple]:
        texts = [r.text for r in rows]
        try:
            got, why = list(call(texts)), None
        except Exception as e:  # a failing function rejects its batch
            got, why = [], f"error: {type(e).__name__}"
        if why is None and len(got) != len(texts):
            why = "wrong_length"
        return [(r.page, getattr(r, order), r.text, None if why else str(g), why) for r, g in zip(rows, got if not why else texts)]

    kind = dict(df.dtypes)
    out = fold_groups(d, ["page", "part"], [order], fold, f"page {kind['page']}, {order} {kind[order]}, text string, result string, reason string")
    out = cut_lineage(out)
    return out.filter("reason is null").drop("reason"), out.filter("reason is not null").drop("result")


def route_non_empty(df: DataFrame, fn: str | Callable, rules: Sequence[dict] = (), finish: Callable[[Column], Column] | None = None, order: str = "source_id") -> tuple[DataFrame, DataFrame]:
    """Blank texts bypass the function; rules run before it, ``finish`` after it: (rows, rejects)."""
    c = F.col
    empty = tx.is_empty_text(c("text"))
    ok, bad = apply_batch_fn(df.filter(~empty).withColumn("text", tx.substitute(c("text"), rules)), fn, order)
    if finish:
        ok = ok.withColumn("result", finish(c("result")))
    skipped = df.filter(empty).select("page", order, "text", c("text").alias("result"))
    return ok.unionByName(skipped), bad


def apply_joined_fn(df: DataFrame, fn: Callable[[str], str], separator: str, order: str = "source_id", batch_rows: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Functions taking one string: texts of a batch are joined, the answer is split; another count is a reject."""
    return apply_batch_fn(df, lambda texts: fn(separator.join(texts)).split(separator), order, batch_rows)


def retry_by_row(df: DataFrame, fn: Callable[[list[str]], list[str]], order: str = "source_id", threshold: int = 20) -> DataFrame:
    """Batch call first; rows of rejected or degenerate batches are tried one by one; what still fails keeps the source."""
    c = F.col
    looped = lambda col: tx.find_repeats(col, threshold)["repeated"]
    ok, _ = apply_batch_fn(df, fn, order)
    ok = per_key(ok.withColumn("bad", looped(c("result"))), ["page"], F.bool_or("bad").alias("page_bad")).filter("not page_bad")
    first = ok.select("page", order, "text", "result", F.lit("batch").alias("how"))
    rest = df.select("page", order, "text").join(first.select("page", order), ["page", order], "left_anti")
    one, _ = apply_batch_fn(rest, fn, order, batch_rows=1)
    one = one.withColumn("bad", looped(c("result"))).filter("not bad").select("page", order, "result")
    second = rest.join(one, ["page", order], "left").select("page", order, "text", F.coalesce("result", "text").alias("result"),
                                                            F.when(c("result").isNull(), "source").otherwise("row").alias("how"))
    return first.unionByName(second)
