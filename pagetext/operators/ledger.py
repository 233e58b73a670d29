"""Reconciling manifests, ledgers, caches and runs: joins and set rules over bookkeeping tables."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagetext.operators.folds import in_order
from pagetext.operators.prefix import expand_ranges, per_key, prefix_scan, previous_row
from pagetext.session import cut_lineage

# Progress bits of a page.
DETECTED, RECOGNISED, CLEANED, TRANSLATED, ALL_DONE = 1, 2, 4, 8, 15
STAGES = {"detect": DETECTED, "ocr": RECOGNISED, "inpaint": CLEANED, "translate": TRANSLATED}


def page_done(code: Column, required: int) -> Column:
    return code.bitwiseAND(F.lit(required)) == required


def progress_update(df: DataFrame, mode: str, bits: int) -> DataFrame:
    """``set``, ``add`` or ``clear`` progress bits; a page losing its translation bit loses its target language."""
    code = F.col("finish_code")
    new = {"set": F.lit(bits), "add": code.bitwiseOR(F.lit(bits)), "clear": code.bitwiseAND(F.lit(~bits & ALL_DONE))}[mode]
    df = df.withColumn("finish_code", new.cast("int"))
    if mode != "clear" or not bits & TRANSLATED:
        return df
    return df.withColumn("translation_target", F.lit(None).cast("string"))


def latest(df: DataFrame, key: Sequence[str], by: Sequence[Column]) -> DataFrame:
    """Last record of every key; one value per key survives the partial aggregation, so hot keys are cheap."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.max_by(F.struct(*rest), F.struct(*by)).alias("r")).select(*key, "r.*")


def reconcile_import(project: DataFrame, imported: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Positional text import: (blocks with applied translations, page status and completion change).

    project: page, block_id (1..n), translation; imported: page, pos (1..m), text. Shorter side decides how many
    rows apply; a page is complete only when both sides have the same count.
    """
    a = project.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    b = imported.groupBy("page").agg(F.count(F.lit(1)).alias("m"))
    status = (F.when(F.col("m").isNull(), "missing").when(F.col("n").isNull(), "unexpected")
              .when(F.col("n") != F.col("m"), "unmatched").otherwise("matched"))
    pages = a.join(b, "page", "full_outer").select(
        "page", "n", "m", status.alias("status"),
        F.when(status == "matched", "set").when(status == "unmatched", "clear").alias("translate_bit"))
    blocks = project.join(imported.withColumnRenamed("pos", "block_id"), ["page", "block_id"], "left").withColumn(
        "translation", F.coalesce("text", "translation")).drop("text")
    return blocks, pages


def merge_projects(a: DataFrame, b: DataFrame) -> DataFrame:
    """Whole pages of ``b`` replace pages of ``a``."""
    return a.join(b.select("page").distinct(), "page", "left_anti").unionByName(b)


def verify_outputs(manifest: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Delivered files against the manifest: (issues, published pages).

    manifest: page, output_name, output_sha256 (null = not produced yet); files: output_name, sha256, readable.
    Pages must be exactly 1..n, each once; names must be unique.
    """
    n = manifest.agg(F.count(F.lit(1)).alias("n"))
    by_page = manifest.groupBy("page").agg(F.count(F.lit(1)).alias("page_count"))
    by_name = manifest.groupBy("output_name").agg(F.count(F.lit(1)).alias("name_count"))
    none = F.lit(None).cast("string")
    expected = expand_ranges(n, F.lit(1), F.col("n"), "page")
    missing_map = expected.join(by_page, "page", "left_anti").select(F.col("page"), none.alias("output_name"), F.lit("missing_mapping").alias("type"))
    in_range = expected.select("page", F.lit(True).alias("known"))
    invalid = (by_page.join(in_range, "page", "left").filter(F.col("known").isNull() | (F.col("page_count") != 1))
               .select("page", none.alias("output_name"), F.lit("invalid_mapping").alias("type")))
    twice = by_name.filter("name_count <> 1").select(F.lit(None).cast("long").alias("page"), "output_name", F.lit("duplicate_output").alias("type"))
    state = (F.when(F.col("found").isNull(), "missing").when(~F.col("readable"), "unreadable")
             .when(F.col("sha256") != F.col("output_sha256"), "changed"))
    made = (manifest.filter(F.coalesce("output_sha256", F.lit("")) != "").join(files.withColumn("found", F.lit(True)), "output_name", "left")
            .withColumn("type", state))
    issues = (made.filter("type is not null").select(F.col("page").cast("long"), "output_name", "type")
              .unionByName(missing_map).unionByName(invalid.select(F.col("page").cast("long"), "output_name", "type")).unionByName(twice))
    valid = (made.filter("type is null").join(by_page.filter("page_count = 1"), "page", "left_semi")
             .join(by_name.filter("name_count = 1"), "output_name", "left_semi").join(in_range, "page", "left_semi").select("page").distinct())
    return issues, valid


def check_resume(old: DataFrame, new: DataFrame, same: Sequence[str]) -> DataFrame:
    """Rows that forbid a resume: the old list must be an ordered prefix of the new one with equal columns."""
    o = old.select("ordinal", *[F.col(c).alias("old_" + c) for c in same], F.lit(True).alias("in_old"))
    n = new.select("ordinal", *same, F.lit(True).alias("in_new"))
    reason = F.when(F.col("in_new").isNull(), "page_removed")
    for c in same:
        reason = reason.when(~F.col("old_" + c).eqNullSafe(F.col(c)), f"{c}_changed")
    return o.join(n, "ordinal", "left").select("ordinal", reason.alias("reason")).filter("reason is not null")


def canonical_hash(*cols: str) -> Column:
    """SHA-256 of the canonical JSON of the columns, the one key of a request."""
    return F.sha2(F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"}), 256)


def reuse_responses(requests: DataFrame, cache: DataFrame) -> DataFrame:
    """Requests with the reusable ``content`` or the ``reason`` of the miss.

    requests: page, payload_hash, model_digest, expected; cache: payload_hash, model_digest, content, done,
    done_reason, attempt. The latest attempt of the same model counts; ``model_changed`` says there are only
    attempts of others. Blank lines of a reply do not count.
    """
    c = latest(cache.withColumn("cached_digest", F.col("model_digest")), ["payload_hash", "model_digest"], [F.col("attempt")])
    other = cache.select("payload_hash", F.lit(True).alias("cached")).distinct()
    d = requests.join(c, ["payload_hash", "model_digest"], "left").join(other, "payload_hash", "left")
    lines = F.size(F.filter(F.split("content", "\n"), lambda x: F.trim(x) != ""))
    finished = F.coalesce(F.col("done") & (F.col("done_reason") == "stop"), F.lit(False))
    reason = (F.when(F.col("cached").isNull(), "not_cached").when(F.col("cached_digest").isNull(), "model_changed")
              .when(~finished, "unfinished").when(lines != F.col("expected"), "line_count"))
    return d.select("page", "payload_hash", F.when(reason.isNull(), F.col("content")).alias("content"), reason.alias("reason"))


_SETTING = "array<struct<path:array<string>,value:string,is_object:boolean,is_empty:boolean>>"


def _setting_value(x) -> str:
    """Canonical text of a JSON value: equal exactly if the values are equal (numbers and truth values by value)."""
    if isinstance(x, (bool, int, float)):
        return str(int(x)) if x == x and abs(x) != float("inf") and x == int(x) else repr(float(x))
    if isinstance(x, list):
        return "[" + ",".join(map(_setting_value, x)) + "]"
    if isinstance(x, dict):
        return "{" + ",".join(f"{json.dumps(k)}:{_setting_value(x[k])}" for k in sorted(x)) + "}"
    return json.dumps(x, ensure_ascii=False)


def _settings(text: str | None) -> list[dict]:
    try:
        todo = [((), json.loads(text))] if text is not None else []
    except ValueError:
        return []
    out = []
    while todo:
        path, x = todo.pop()
        if isinstance(x, dict):
            todo += [((*path, k), v) for k, v in x.items()]
        if path:
            inner = isinstance(x, dict)
            out.append({"path": list(path), "value": None if inner else _setting_value(x), "is_object": inner, "is_empty": inner and not x})
    return out


def flatten_settings(df: DataFrame, key: Sequence[str], col: str) -> DataFrame:
    """JSON settings as rows: path (array of names), value (canonical text), is_object, is_empty; at any depth.

    Objects have rows of their own, without a value. Text that is no JSON has no settings.
    """
    unfold = F.pandas_udf(lambda s: s.map(_settings), _SETTING)
    return df.select(*key, F.inline(unfold(F.col(col))))


def config_contains(expected: DataFrame, actual: DataFrame, key: Sequence[str], ignore: Sequence[str] = ()) -> DataFrame:
    """Expected settings that the actual ones lack or contradict; compatible where empty.

    Every expected value must be there and equal, every empty object must be an object. ``ignore`` names settings left out, with
    all that is below them. Both sides are shuffled: settings unfold to many more bytes than Spark expects of their JSON, so the smaller
    one must not be broadcast on its estimate.
    """
    e = expected.filter(~F.col("is_object") | F.col("is_empty"))
    if ignore:
        e = e.filter(~F.arrays_overlap("path", F.array(*map(F.lit, ignore))))
    a = actual.select(*key, "path", F.col("value").alias("actual"), F.col("is_object").alias("actual_object"))
    same = F.when(F.col("is_object"), F.col("actual_object")).otherwise(~F.col("actual_object") & F.col("value").eqNullSafe(F.col("actual")))
    return e.join(a.hint("merge"), [*key, "path"], "left").filter(~F.coalesce(same, F.lit(False))).select(*key, "path", "value", "actual")


def verify_rendered(ledger: DataFrame, rendered: DataFrame) -> DataFrame:
    """Blocks whose rendered text differs from the ledger once line breaks are removed, or is missing."""
    def flat(c: str) -> Column:
        return F.regexp_replace(c, "[\r\n]", "")

    d = ledger.select("page", "source_id", "translation").join(
        rendered.select("page", "source_id", F.col("text").alias("rendered")), ["page", "source_id"], "left")
    return d.filter(F.col("rendered").isNull() | (flat("translation") != flat("rendered")))


def unfinished(pages: DataFrame, status: DataFrame) -> DataFrame:
    return pages.join(status.filter(F.col("state").isin("completed", "review")).select("page").distinct(), "page", "left_anti")


def apply_overrides(blocks: DataFrame, overrides: DataFrame, fields: Sequence[str], box_sources: Sequence[str] = ("rect", "bounding", "xyxy")) -> DataFrame:
    """Field overrides per block; the box is the first one present among the sources (override first)."""
    o = overrides.select("page", "block_id", *[F.col(f).alias("o_" + f) for f in fields], F.col("rect").alias("o_rect"))
    d = blocks.join(o, ["page", "block_id"], "left")
    out = {f: F.coalesce("o_" + f, f) for f in fields}
    out["box"] = F.coalesce("o_rect", *[F.col(b) for b in box_sources if b in blocks.columns])
    return d.withColumns(out).drop("o_rect", *["o_" + f for f in fields])


def resolve_page(names: DataFrame, manifest: DataFrame, attempts: DataFrame) -> DataFrame:
    """Any of the three names of a page to the page and the latest attempt holding it, or the ``reason`` why not: unknown, ambiguous."""
    m = (manifest.select("page", F.explode(F.array("source_name", "normalized_name", "output_name")).alias("name"))
         .groupBy("name").agg(F.min("page").alias("page"), (F.min("page") != F.max("page")).alias("several")))
    last = latest(attempts, ["page"], [F.col("attempt")])
    d = names.join(m, "name", "left").withColumn("reason", F.when(F.col("several"), "ambiguous").when(F.col("page").isNull(), "unknown"))
    return d.withColumn("page", F.when(~F.col("several"), F.col("page"))).drop("several").join(last, "page", "left")


def import_previous(pages: DataFrame, old_pages: DataFrame, order: DataFrame, old_order: DataFrame) -> DataFrame:
    """Pages of an earlier run that may be reused, or the reason why not.

    pages/old_pages: page, source_sha256; order/old_order: page, block_id, position (order recomputed now).
    """
    o = old_pages.withColumnRenamed("source_sha256", "old_sha")
    a = order.select("page", "block_id", "position")
    b = old_order.select("page", "block_id", F.col("position").alias("old_position"))
    differs = (a.join(b, ["page", "block_id"], "full_outer").filter(~F.col("position").eqNullSafe(F.col("old_position")))
               .select("page").distinct().withColumn("differs", F.lit(True)))
    d = o.join(pages, "page", "left").join(differs, "page", "left")
    reason = (F.when(F.col("source_sha256").isNull(), "unknown_page").when(F.col("source_sha256") != F.col("old_sha"), "source_changed")
              .when(F.col("differs"), "order_changed"))
    return d.select("page", reason.alias("reason"))


def fill_missing(target: DataFrame, source: DataFrame) -> DataFrame:
    """Fill blank translations from another catalogue; the first usable entry per (context, text) wins.

    target: context, text, translation; source: the same with ``idx`` (file order).
    """
    usable = source.filter(F.trim("translation") != "").groupBy("context", "text").agg(F.min_by("translation", "idx").alias("found"))
    d = target.join(usable, ["context", "text"], "left")
    blank = F.trim(F.coalesce("translation", F.lit(""))) == ""
    return d.withColumn("filled", blank & F.col("found").isNotNull()).withColumn(
        "translation", F.when(F.col("filled"), F.col("found")).otherwise(F.col("translation"))).drop("found")


def select_pages(pages: DataFrame, mode: str, required: int = ALL_DONE, requested: DataFrame | None = None) -> DataFrame:
    """Pages to work on. ``continue``: all not yet done (the range is ignored); ``explicit``: requested pages known
    to the project, in the requested order; ``fresh``: like explicit, with their progress bits cleared."""
    if mode == "continue":
        return pages.filter(~page_done(F.col("finish_code"), required))
    d = requested.join(pages, "page")
    return d if mode == "explicit" else progress_update(d, "clear", required)


def summarise_batch(pages: DataFrame, blocks: DataFrame, layout: DataFrame, small: float = 12) -> DataFrame:
    """One row of counts per batch. pages: batch, page, state; blocks: batch, page, font_size; layout: batch, status."""
    p = pages.groupBy("batch").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("state") == "completed").alias("completed"),
        F.count_if(F.col("state") == "failed").alias("failed"))
    b = blocks.groupBy("batch").agg(F.count(F.lit(1)).alias("blocks"), F.count_if(F.col("font_size") < small).alias("small_text"))
    with_text = blocks.select("batch", "page").distinct().groupBy("batch").agg(F.count(F.lit(1)).alias("text_pages"))
    y = layout.groupBy("batch").agg(*[F.count_if(F.col("status") == s).alias(s) for s in ("adjusted", "needs_review", "unverified")])
    d = p.join(b, "batch", "left").join(with_text, "batch", "left").join(y, "batch", "left").fillna(0)
    return d.withColumn("no_text_pages", F.col("pages") - F.col("text_pages")).drop("text_pages")


def progress(jobs: DataFrame, failures: DataFrame) -> DataFrame:
    """Progress snapshot per job. jobs: job_id, status, pages, completed, initial, elapsed; failures: job_id, page, type."""
    f = failures.groupBy("job_id").agg(F.count_if(F.col("type") == "ReviewRequired").alias("review_count"), F.count(F.lit(1)).alias("n"))
    d = jobs.join(f, "job_id", "left").fillna(0, ["review_count", "n"])
    remaining = F.greatest(F.lit(0).cast("long"), F.col("pages") - F.col("completed"))
    added = F.greatest(F.lit(0).cast("long"), F.col("completed") - F.col("initial"))
    known = (F.col("status") == "running") & (added > 0) & (remaining > 0) & (F.col("elapsed") > 0) & (F.col("n") == 0)
    return d.select("job_id", "status", remaining.alias("remaining"), added.alias("added"), "review_count",
                    (F.col("n") - F.col("review_count")).alias("failed_count"),
                    F.when(known, F.col("elapsed") * remaining / added).alias("eta_seconds"))


def digest_rows(df: DataFrame, key: Sequence[str], order: str, cols: Sequence[str]) -> DataFrame:
    """SHA-256 per key over the canonical JSON list of its rows in ``order``, whatever their number.

    The rows of a key stream through one hash state in order; only this state is held.
    """
    js = F.to_json(F.struct(*sorted(cols)), {"ignoreNullFields": "false"})
    rows = df.select(*key, F.col(order).alias("__o"), js.alias("__t"))
    n = len(key)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, state = None, None
        for b in batches:
            done = []
            keys = list(zip(*(c.to_pylist() for c in b.columns[:n])))
            for k, t in zip(keys, b.column(n + 1)):
                if k != current:
                    if state is not None:
                        done.append((*current, _closed(state)))
                    current, state = k, hashlib.sha256(b"[")
                else:
                    state.update(b",")
                state.update(t.as_py().encode())
            yield _key_rows(done, b.schema, n)
        if state is not None:
            yield _key_rows([(*current, _closed(state))], b.schema, n)

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in key)
    return in_order(rows, key, ["__o"]).mapInArrow(run, f"{kinds}, digest string")


def _closed(state) -> str:
    state.update(b"]")
    return state.hexdigest()


def _key_rows(rows: list[tuple], schema: pa.Schema, n: int) -> pa.RecordBatch:
    cols = list(zip(*rows)) or [()] * (n + 1)
    return pa.RecordBatch.from_arrays([*(pa.array(c, schema.field(i).type) for i, c in enumerate(cols[:n])), pa.array(cols[n], pa.string())], names=[*schema.names[:n], "digest"])


def search_counts(hits: DataFrame) -> DataFrame:
    """Hits per page and in total (page null)."""
    return hits.rollup("page").agg(F.sum("hits").alias("hits"))


def duplicate_keys(df: DataFrame, key: Column, name: str = "key") -> DataFrame:
    return df.groupBy(key.alias(name)).agg(F.count(F.lit(1)).alias("entries")).filter("entries <> 1")


def resource_extremes(samples: DataFrame, key: Sequence[str]) -> DataFrame:
    return samples.groupBy(*key).agg(F.min("available").alias("min_available"), F.max("rss").alias("peak_rss"))


# Spellings of usage fields in the order they are tried; the second list is looked up inside the details object.
USAGE_FIELDS = {
    "prompt": (("prompt_tokens", "input_tokens"), None, ()),
    "completion": (("completion_tokens", "output_tokens"), None, ()),
    "reasoning": ((), "completion", ("reasoning_tokens",)),
    "total": (("total_tokens",), None, ()),
    "cache_hit": (("prompt_cache_hit_tokens", "cached_tokens", "cache_read_tokens", "cache_read_input_tokens"), "prompt",
                  ("cached_tokens", "cache_read_tokens", "cache_read_input_tokens")),
    "cache_miss": (("prompt_cache_miss_tokens", "cache_miss_tokens"), "prompt", ("cache_miss_tokens",)),
    "cache_write": (("prompt_cache_write_tokens", "cache_write_tokens", "cache_creation_input_tokens"), "prompt",
                    ("cache_write_tokens", "cache_creation_input_tokens")),
}
USAGE_DETAILS = {"completion": ("completion_tokens_details", "output_tokens_details"), "prompt": ("prompt_tokens_details", "input_tokens_details")}


def usage_counts(usage: Column) -> dict[str, Column]:
    """The seven token counts of a provider's usage object (JSON text); a field of any other provider is null.

    The first spelling that is there decides; what is no count (a truth value, a negative number, other text) is null. A missing total is prompt plus
    completion when both are known.
    """
    members = F.from_json(usage, "map<string,string>")

    def member(source: Column, names: Sequence[str]) -> Column:
        return F.coalesce(*[F.try_element_at(source, F.lit(n)) for n in names])

    def count(source: Column, names: Sequence[str]) -> Column:
        n = member(source, names).try_cast("double").cast("bigint")
        return F.when(n >= 0, n)

    out = {}
    for field, (names, details, inner) in USAGE_FIELDS.items():
        found = [count(members, names)] if names else []
        if details:
            found.append(count(F.from_json(member(members, USAGE_DETAILS[details]), "map<string,string>"), inner))
        out[field] = F.coalesce(*found)
    out["total"] = F.coalesce(out["total"], out["prompt"] + out["completion"])
    return out


def token_totals(df: DataFrame, key: Sequence[str], usage: str = "usage") -> DataFrame:
    """Usage sums per key from usage objects (JSON text) in any provider's spelling."""
    picked = usage_counts(F.col(usage))
    return df.select(*key, *[c.alias(k) for k, c in picked.items()]).groupBy(*key).agg(*[F.sum(k).alias(k) for k in picked])


def issue_summary(issues: DataFrame) -> DataFrame:
    return issues.cube("kind", "stage").agg(F.count(F.lit(1)).alias("issues"))


def stage_progress(pages: DataFrame, enabled: Sequence[str] = tuple(STAGES)) -> DataFrame:
    """Share of selected pages done per enabled stage and whether the job is finished."""
    stack = F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(STAGES[s]).alias("bit")) for s in enabled])
    d = pages.select("job_id", "finish_code", F.inline(stack)).groupBy("job_id", "stage").agg(
        F.avg((F.col("finish_code").bitwiseAND(F.col("bit")) != 0).cast("int")).alias("fraction"))
    return per_key(d, ["job_id"], F.bool_and(F.col("fraction") >= 1).alias("finished"))


def check_ledger(pages: DataFrame, status: DataFrame, images: DataFrame) -> DataFrame:
    """Broken rules of a page ledger, one row per rule and page. status: page, state; images: page."""
    def state(*s: str) -> DataFrame:
        return status.filter(F.col("state").isin(*s)).select("page").distinct()

    def broken(rule: str, d: DataFrame) -> DataFrame:
        return d.select(F.lit(rule).alias("rule"), "page")

    done, pending = state("completed"), state("review", "failed")
    imaged = images.select("page").distinct()
    known = pages.select("page").distinct()
    rules = {
        "duplicate_page": status.groupBy("page", "state").count().filter("count > 1").select("page").distinct(),
        "completed_without_image": done.join(imaged, "page", "left_anti"),
        "image_without_completed": imaged.join(done, "page", "left_anti"),
        "completed_and_pending": done.join(pending, "page", "left_semi"),
        "unknown_page": status.select("page").distinct().join(known, "page", "left_anti"),
        "pending_and_applied": state("review").join(state("applied"), "page", "left_semi"),
    }
    out = None
    for rule, d in rules.items():
        out = broken(rule, d) if out is None else out.unionByName(broken(rule, d))
    return out


def missing_ordinals(df: DataFrame, key: Sequence[str], ordinal: str) -> DataFrame:
    """Ordinals absent between 1 and the largest one of each key, from gaps between neighbours."""
    d = df.select(*key, F.col(ordinal).cast("long").alias("o")).filter("o >= 1").distinct()
    d = previous_row(d, key, [F.col("o")], F.col("o"), "prev")
    gap = d.withColumn("prev", F.coalesce("prev", F.lit(0).cast("long"))).filter("o - prev > 1")
    return expand_ranges(gap.select(*key, "prev", "o"), F.col("prev") + 1, F.col("o") - 1, "missing").select(*key, "missing")


def page_key_union(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("page").union(b.select("page")).distinct()


def set_differences(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """Pages on one side only; equal sets give no row."""
    e, a = expected.select("page").distinct(), actual.select("page").distinct()
    return (e.join(a, "page", "left_anti").withColumn("side", F.lit("expected_only"))
            .unionByName(a.join(e, "page", "left_anti").withColumn("side", F.lit("actual_only"))))


def extend_coverage(covered: DataFrame, new: DataFrame) -> DataFrame:
    """Covered pages (page, pos) plus the new ones (page, pos) not yet covered, appended in their order."""
    fresh = new.join(covered.select("page").distinct(), "page", "left_anti").groupBy("page").agg(F.min("pos").alias("pos"))
    end = covered.agg(F.coalesce(F.max("pos"), F.lit(0)).alias("end")).withColumn("all", F.lit(1))
    fresh = prefix_scan(fresh.withColumn("all", F.lit(1)), ["all"], [F.col("pos")], number="k")
    # ``end`` is a single row.
    shifted = fresh.join(F.broadcast(end), "all").select("page", (F.col("end") + F.col("k")).cast("int").alias("pos"))
    return covered.select("page", F.col("pos").cast("int").alias("pos")).unionByName(shifted)


def assign_batches(pages: DataFrame, key: Sequence[str] = ("job_id",), order: str = "page", first: int = 4, size: int = 12,
                   chunk: Column | None = None) -> DataFrame:
    """1-based batch of each page: a small first batch, then fixed-size ones."""
    chunk = F.floor(F.col(order) / 4096) if chunk is None else chunk
    d = prefix_scan(pages, list(key), [F.col(order)], number="ordinal")
    head = min(first, size)
    return d.withColumn("batch", F.when(F.col("ordinal") <= head, 1).otherwise(2 + F.floor((F.col("ordinal") - head - 1) / size)).cast("int"))


def last_sections(sections: DataFrame) -> DataFrame:
    """A later section with the same name replaces an earlier one. sections: page, idx, text."""
    return latest(sections, ["page"], [F.col("idx")])


def folded(c: Column) -> Column:
    """Case folding both engines agree on."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


def unique_names(files: DataFrame) -> DataFrame:
    """Output names: the stem where it is unique without regard to case, else the full name; clashes get (2), (3) ...

    files: name, ordinal. The k-th file of one wanted name starts with number k. What is left are clashes between
    a generated and a wanted name: each file claims its next name, the earlier file keeps it. With one common
    priority this ends in exactly the first-come result.
    """
    d = files.withColumn("stem", F.regexp_replace("name", r"(?<=.)\.[^.]*$", ""))
    d = per_key(d.withColumn("fold", folded(F.col("stem"))), ["fold"], F.count(F.lit(1)).alias("same"))
    d = d.withColumn("base", F.when(F.col("same") == 1, F.col("stem")).otherwise(F.col("name"))).withColumn("fold", folded(F.col("base")))
    d = prefix_scan(d.select("name", "ordinal", "base", "fold"), ["fold"], [F.col("ordinal")], number="k")
    d = cut_lineage(d)
    while True:
        d = d.withColumn("claim", F.when(F.col("k") == 1, F.col("fold")).otherwise(F.concat("fold", F.lit("("), F.col("k"), F.lit(")"))))
        winner = d.groupBy("claim").agg(F.min("ordinal").alias("first"), F.count(F.lit(1)).alias("claims")).filter("claims > 1")
        if winner.isEmpty():
            break
        d = cut_lineage(d.join(winner, "claim", "left").withColumn(
            "k", F.when(F.col("first").isNotNull() & (F.col("ordinal") > F.col("first")), F.col("k") + 1).otherwise(F.col("k"))).drop("claim", "first", "claims"))
    return d.select("name", "ordinal", F.concat("base", F.when(F.col("k") > 1, F.concat(F.lit("("), F.col("k"), F.lit(")"))).otherwise(""), F.lit(".png")).alias("output_name"))


def natural_key(c: Column) -> Column:
    """Sort key of a name: digit runs compare as numbers and before text, text without regard to case."""
    parts = F.regexp_extract_all(c, F.lit(r"(\d+|\D+)"), F.lit(1))
    return F.transform(parts, lambda p: F.struct(
        F.when(p.rlike(r"^\d"), 0).otherwise(1).alias("kind"),
        F.when(p.rlike(r"^\d"), F.length(F.regexp_replace(p, "^0+(?=.)", ""))).otherwise(0).alias("digits"),
        F.when(p.rlike(r"^\d"), F.regexp_replace(p, "^0+(?=.)", "")).otherwise(folded(p)).alias("value")))


def bounded_tail(df: DataFrame, by: str, n: int = 512) -> DataFrame:
    """The last ``n`` rows; a top-n of every task, merged."""
    return df.orderBy(F.col(by).desc()).limit(n)
