"""Queries over manifests, ledgers and runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.registry import query
from pagetext.operators import ledger as L

c = F.col


@query("p7_progress_update", """
with p as (select page, job_id, (page%16)::int as code, case when page%3=0 then 'en' end as target from pages_v)
select page, code|8 as added, code & ~4 & 15 as cleared, null::varchar as target, (code & 3)=3 as done from p""")
def _(v):
    p = v.pages_v.select("page", (c("page") % 16).cast("int").alias("finish_code"), F.when(c("page") % 3 == 0, "en").alias("translation_target"))
    a = L.progress_update(p, "add", L.TRANSLATED).select("page", c("finish_code").alias("added"))
    b = L.progress_update(p, "clear", L.CLEANED).select("page", c("finish_code").alias("cleared"))
    t = L.progress_update(p, "clear", L.TRANSLATED).select("page", c("translation_target").alias("target"))
    d = p.select("page", L.page_done(c("finish_code"), 3).alias("done"))
    return a.join(b, "page").join(t, "page").join(d, "page")


IMPORT = """proj as (select page, block_id, 'old'||block_id as translation from blocks),
imp as (select page, cand_id as pos, 'new'||cand_id as text from candidates where page%5<>0 union all select page+1000000000, cand_id, 'x' from candidates where page%50=0)"""


def _import(v):
    proj = v.blocks.select("page", "block_id", F.concat(F.lit("old"), c("block_id")).alias("translation"))
    imp = v.candidates.filter("page % 5 <> 0").select("page", c("cand_id").alias("pos"), F.concat(F.lit("new"), c("cand_id")).alias("text"))
    extra = v.candidates.filter("page % 50 = 0").select((c("page") + 1000000000).alias("page"), c("cand_id").alias("pos"), F.lit("x").alias("text"))
    return L.reconcile_import(proj, imp.unionByName(extra))


query("j7_reconcile_import", f"""with {IMPORT}, a as (select page, count(*) n from proj group by page), b as (select page, count(*) m from imp group by page),
s as (select coalesce(a.page,b.page) as page, n, m, case when m is null then 'missing' when n is null then 'unexpected' when n<>m then 'unmatched' else 'matched' end as status
 from a full join b on a.page=b.page) select *, case status when 'matched' then 'set' when 'unmatched' then 'clear' end as translate_bit from s""")(lambda v: _import(v)[1])
query("j7b_import_text", f"""with {IMPORT} select p.page, p.block_id, coalesce(i.text, p.translation) as translation from proj p left join imp i
 on i.page=p.page and i.pos=p.block_id""")(lambda v: _import(v)[0])


@query("j8_merge_projects", """with a as (select page, block_id, label from blocks where page%3<>0), b as (select page, cand_id as block_id, 'new' as label from candidates where page%2=0)
select * from a where page not in (select page from b) union all select * from b""")
def _(v):
    a = v.blocks.filter("page % 3 <> 0").select("page", "block_id", "label")
    b = v.candidates.filter("page % 2 = 0").select("page", c("cand_id").alias("block_id"), F.lit("new").alias("label"))
    return L.merge_projects(a, b)


MAP = """m as (select case when ordinal%97=0 then ordinal else ordinal+1 end::bigint as page,
  case when ordinal%113=5 then 'same.png' else source_name||'.png' end as output_name, output_sha256 from manifest),
f as (select source||'_'||doc_id||case when doc_id%2=0 then '.PNG' else '.jpg' end||'.png' as output_name, sha256(text) as sha256, doc_id%29<>0 as readable from documents where doc_id%13<>0),
pc as (select page, count(*) n from m group by page), nc as (select output_name, count(*) n from m group by output_name),
ex as (select unnest(range(1, (select count(*) from m)+1)) as page),
made as (select m.page, m.output_name, case when f.output_name is null then 'missing' when not readable then 'unreadable' when sha256<>output_sha256 then 'changed' end as type
  from m left join f using (output_name) where output_sha256 is not null)"""


def _mapping(v):
    m = v.manifest.select(F.when(c("ordinal") % 97 == 0, c("ordinal")).otherwise(c("ordinal") + 1).cast("long").alias("page"),
                          F.when(c("ordinal") % 113 == 5, "same.png").otherwise(F.concat("source_name", F.lit(".png"))).alias("output_name"), "output_sha256")
    f = v.documents.filter("doc_id % 13 <> 0").select(
        F.concat("source", F.lit("_"), c("doc_id"), F.when(c("doc_id") % 2 == 0, ".PNG").otherwise(".jpg"), F.lit(".png")).alias("output_name"),
        F.sha2("text", 256).alias("sha256"), (c("doc_id") % 29 != 0).alias("readable"))
    return L.verify_outputs(m, f)


query("j9_verify_outputs", f"""with {MAP} select page, output_name, type from made where type is not null
union all select page, null, 'missing_mapping' from ex where page not in (select page from m)
union all select page, null, 'invalid_mapping' from pc where n<>1 or page not in (select page from ex)
union all select null, output_name, 'duplicate_output' from nc where n<>1""")(lambda v: _mapping(v)[0])
query("j9b_published_pages", f"""with {MAP} select distinct page from made where type is null and page in (select page from pc where n=1)
 and output_name in (select output_name from nc where n=1) and page in (select page from ex)""")(lambda v: _mapping(v)[1])


@query("j10_check_resume", """with n as (select ordinal, source_name, case when ordinal%41=3 then 'changed' else source_sha256 end as source_sha256 from manifest where ordinal%201<>7)
select o.ordinal, case when n.ordinal is null then 'page_removed' when o.source_name<>n.source_name then 'source_name_changed' else 'source_sha256_changed' end as reason
from manifest o left join n using (ordinal) where n.ordinal is null or o.source_name<>n.source_name or o.source_sha256<>n.source_sha256""")
def _(v):
    n = v.manifest.filter("ordinal % 201 <> 7").withColumn("source_sha256", F.when(c("ordinal") % 41 == 3, "changed").otherwise(c("source_sha256")))
    return L.check_resume(v.manifest, n, ["source_name", "source_sha256"])


CACHE = """rq as (select page, source_id, sha256('{"page":'||page||',"source_id":'||source_id||'}') as payload_hash, 'd'||page%3 as model_digest from dialogue),
ca as (select payload_hash, 'd'||(r.page+a)%4 as cached_digest, content||a as content, r.page%5<>0 as done, case when r.page%6=0 then 'length' else 'stop' end as done_reason, a
  from rq join replies r using (page, source_id), (values (0),(1),(4)) t(a) where r.page%7<>0),
la as (select payload_hash, cached_digest, arg_max(content, a) as content, bool_or(done) as done, max(done_reason) as done_reason from ca group by 1,2),
rs as (select page, rq.payload_hash, content, case when not exists (select 1 from ca where ca.payload_hash=rq.payload_hash) then 'not_cached' when cached_digest is null then 'model_changed'
  when not (done and done_reason='stop') then 'unfinished' when len(list_filter(string_split(content, chr(10)), lambda x: trim(x)<>''))<>1 then 'line_count' end as reason
  from rq left join la on la.payload_hash=rq.payload_hash and la.cached_digest=rq.model_digest)"""


def _requests(v):
    rq = v.dialogue.select("page", "source_id", L.canonical_hash("page", "source_id").alias("payload_hash"),
                           F.concat(F.lit("d"), c("page") % 3).alias("model_digest"), F.lit(1).alias("expected"))
    ca = (rq.drop("model_digest", "expected").join(v.replies.filter("page % 7 <> 0"), ["page", "source_id"])
          .withColumn("attempt", F.explode(F.array(F.lit(0), F.lit(1), F.lit(4))))
          .select("payload_hash", F.concat(F.lit("d"), (c("page") + c("attempt")) % 4).alias("model_digest"), F.concat("content", "attempt").alias("content"), (c("page") % 5 != 0).alias("done"),
                  F.when(c("page") % 6 == 0, "length").otherwise("stop").alias("done_reason"), "attempt"))
    return rq, ca


def _reuse(v):
    return L.reuse_responses(*_requests(v))


query("j11_reuse_responses", f"with {CACHE} select page, payload_hash, case when reason is null then content end as content, reason from rs")(_reuse)


DEEP = 12  # levels of the nested settings of the query


@query("j12_config_contains", f"""with x as (select event_id, json_extract_string(props,'$.k') as k, event_type from events), p as (select list_transform(range({DEEP}), lambda i: 'l'||i) as deep),
e as (select event_id, ['k'] as path, to_json(k)::varchar as value from x union all select event_id, ['a','type'], to_json(event_type)::varchar from x union all select event_id, ['a','n'], '2' from x
 union all select event_id, list_append(deep,'v.w'), to_json('{{'||k)::varchar from x, p union all select event_id, ['empty'], null from x),
a as (select event_id, ['k'] as path, case when event_id%7=0 then '"x"' else to_json(k)::varchar end as value, true as there from x union all select event_id, ['a','type'], to_json(event_type)::varchar, true from x where event_id%11<>0
 union all select event_id, ['a','n'], case when event_id%5=0 then '3' else '2' end, true from x union all select event_id, list_append(deep,'v.w'), case when event_id%13=0 then '"-"' else to_json('{{'||k)::varchar end, true from x, p
 union all select event_id, ['empty'], null, event_id%3=0 from x where event_id%4<>0)
select e.event_id, array_to_string(e.path,'/') as path, e.value, a.value as actual from e left join a using (event_id, path) where a.there is null or not a.there or a.value is distinct from e.value""")
def _(v):
    k = F.get_json_object("props", "$.k")

    def deep(value):
        x = F.struct(value.alias("v.w"))
        for i in range(DEEP - 1, 0, -1):
            x = F.struct(x.alias(f"l{i}"))
        return x

    odd = F.concat(F.lit("{"), k)
    exp = v.events.select("event_id", F.to_json(F.struct(
        k.alias("k"), F.struct(c("event_type").alias("type"), F.lit(2).alias("n"), F.struct(c("ts").alias("x")).alias("time")).alias("a"), deep(odd).alias("l0"),
        F.from_json(F.lit("{}"), "struct<x:int>").alias("empty"))).alias("j"))
    a = F.struct(F.when(c("event_id") % 11 != 0, c("event_type")).alias("type"), F.when(c("event_id") % 5 == 0, 3.0).otherwise(2.0).alias("n"))
    some = F.when(c("event_id") % 3 == 0, F.struct(F.lit(1).alias("x")))
    act = v.events.select("event_id", F.to_json(F.struct(
        F.when(c("event_id") % 7 == 0, "x").otherwise(k).alias("k"), a.alias("a"), deep(F.when(c("event_id") % 13 == 0, "-").otherwise(odd)).alias("l0"),
        F.when(c("event_id") % 4 != 0, some).alias("empty"))).alias("j"))
    return (L.config_contains(L.flatten_settings(exp, ["event_id"], "j"), L.flatten_settings(act, ["event_id"], "j"), ["event_id"], ignore=["time"])
            .withColumn("path", F.array_join("path", "/")))


@query("j13_verify_rendered", """with r as (select page, source_id, case when page%9=0 then translation||'!' else replace(translation,' ',' '||chr(10)) end as text from dialogue where page%14<>3)
select d.page, d.source_id, d.translation, r.text as rendered from dialogue d left join r using (page, source_id)
where r.text is null or replace(replace(d.translation,chr(10),''),chr(13),'')<>replace(replace(r.text,chr(10),''),chr(13),'')""")
def _(v):
    r = v.dialogue.filter("page % 14 <> 3").select("page", "source_id", F.when(c("page") % 9 == 0, F.concat("translation", F.lit("!")))
                                                   .otherwise(F.replace("translation", F.lit(" "), F.lit(" \n"))).alias("text"))
    return L.verify_rendered(v.dialogue, r)


STATUS = """st as (select o_orderkey as page, case o_orderstatus when 'F' then 'completed' when 'P' then 'review' else 'failed' end as state from orders)"""


def _status(v):
    return v.orders.select(c("o_orderkey").alias("page"), F.when(c("o_orderstatus") == "F", "completed").when(c("o_orderstatus") == "P", "review").otherwise("failed").alias("state"))


query("j14_unfinished", f"with {STATUS} select page, job_id from pages_v where page not in (select page from st where state in ('completed','review'))")(
    lambda v: L.unfinished(v.pages_v, _status(v)).select("page", "job_id"))


@query("j15_apply_overrides", """with o as (select page, cand_id as block_id, case when cand_id%2=0 then 'over' end as label, case when cand_id%3=0 then 99 end as font_size,
  case when cand_id%4=0 then 'r'||x1 end as rect from candidates where page%3=0)
select b.page, b.block_id, coalesce(o.label,b.label) as label, coalesce(o.font_size,b.font_size) as font_size,
 coalesce(o.rect, case when b.block_id%5=0 then 'b'||b.y1 end, 'x'||b.x1) as box from blocks b left join o using (page, block_id)""")
def _(v):
    b = v.blocks.select("page", "block_id", "label", "font_size", F.when(c("block_id") % 5 == 0, F.concat(F.lit("b"), "y1")).alias("bounding"),
                        F.concat(F.lit("x"), "x1").alias("xyxy"))
    o = v.candidates.filter("page % 3 = 0").select("page", c("cand_id").alias("block_id"), F.when(c("cand_id") % 2 == 0, "over").alias("label"),
                                                   F.when(c("cand_id") % 3 == 0, 99).alias("font_size"), F.when(c("cand_id") % 4 == 0, F.concat(F.lit("r"), "x1")).alias("rect"))
    return L.apply_overrides(b, o, ["label", "font_size"]).select("page", "block_id", "label", "font_size", "box")


@query("j20_resolve_page", """with m as (select ordinal as page, source_name, lpad(ordinal::varchar,6,'0')||'.png' as normalized_name, source_name||'.png' as output_name from manifest),
u as (select source_name as name, page from m union all select normalized_name, page from m union all select output_name, page from m),
k as (select name, case when min(page)=max(page) then min(page) end as page, min(page)<>max(page) as several from u group by name), q as (select distinct source||'_'||doc_id||'.PNG' as name from documents union select lpad(doc_id::varchar,6,'0')||'.png' from documents),
t as (select user_id::int as page, max(event_id) as attempt from events group by user_id)
select q.name, k.page, case when several then 'ambiguous' when k.page is null then 'unknown' end as reason, t.attempt from q left join k using (name) left join t on t.page=k.page""")
def _(v):
    pad = F.concat(F.lpad(c("ordinal").cast("string"), 6, "0"), F.lit(".png"))
    m = v.manifest.select(c("ordinal").alias("page"), "source_name", pad.alias("normalized_name"), F.concat("source_name", F.lit(".png")).alias("output_name"))
    q = v.documents.select(F.concat("source", F.lit("_"), "doc_id", F.lit(".PNG")).alias("name")).union(
        v.documents.select(F.concat(F.lpad(c("doc_id").cast("string"), 6, "0"), F.lit(".png")))).distinct()
    return L.resolve_page(q, m, v.events.select(c("user_id").cast("int").alias("page"), c("event_id").alias("attempt"))).select("name", "page", "reason", "attempt")


@query("j22_import_previous", """with p as (select page, 's'||page as sha from pages_v where page%19<>0), o as (select page, case when page%17=0 then 'z' else 's'||page end as old_sha from pages_v where page%2=0),
n as (select page, block_id, block_id as position from blocks where page%2=0), od as (select page, block_id, case when page%13=0 then 14-block_id else block_id end as position from blocks where page%2=0),
df as (select distinct page from n join od using (page, block_id) where n.position<>od.position)
select o.page, case when p.sha is null then 'unknown_page' when sha<>old_sha then 'source_changed' when df.page is not null then 'order_changed' end as reason
from o left join p using (page) left join df on df.page=o.page""")
def _(v):
    sha = F.concat(F.lit("s"), "page")
    p = v.pages_v.filter("page % 19 <> 0").select("page", sha.alias("source_sha256"))
    o = v.pages_v.filter("page % 2 = 0").select("page", F.when(c("page") % 17 == 0, "z").otherwise(sha).alias("source_sha256"))
    b = v.blocks.filter("page % 2 = 0")
    return L.import_previous(p, o, b.select("page", "block_id", c("block_id").alias("position")),
                             b.select("page", "block_id", F.when(c("page") % 13 == 0, 14 - c("block_id")).otherwise(c("block_id")).alias("position")))


@query("j23_fill_missing", """with t as (select page as context, source_id as id, source as text, case when page%3=0 then ' ' else translation end as translation from dialogue),
s as (select page as context, source as text, case when source_id=0 then '' else translation end as translation, source_id as idx from dialogue where page%2=0),
f as (select context, text, arg_min(translation, idx) as found from s where trim(translation)<>'' group by context, text)
select t.context, t.id, t.text, case when trim(translation)='' and found is not null then found else translation end as translation,
 trim(translation)='' and found is not null as filled from t left join f using (context, text)""")
def _(v):
    t = v.dialogue.select(c("page").alias("context"), c("source_id").alias("id"), c("source").alias("text"), F.when(c("page") % 3 == 0, " ").otherwise(c("translation")).alias("translation"))
    s = v.dialogue.filter("page % 2 = 0").select(c("page").alias("context"), c("source").alias("text"),
                                                 F.when(c("source_id") == 0, "").otherwise(c("translation")).alias("translation"), c("source_id").alias("idx"))
    return L.fill_missing(t, s).select("context", "id", "text", "translation", "filled")


@query("j24_select_pages", """with p as (select page, (page%16)::int as code from pages_v), r as (select user_id as page, min(event_id) as pos from events group by user_id)
select 'continue' as mode, page, null::bigint as pos, code as finish_code from p where code & 12 <> 12
union all select 'explicit', page, pos, code from p join r using (page) union all select 'fresh', page, pos, code & 3 from p join r using (page)""")
def _(v):
    p = v.pages_v.select("page", (c("page") % 16).cast("int").alias("finish_code"), F.lit(None).cast("string").alias("translation_target"))
    r = v.events.groupBy(c("user_id").alias("page")).agg(F.min("event_id").alias("pos"))
    a = L.select_pages(p, "continue", 12).select(F.lit("continue").alias("mode"), "page", F.lit(None).cast("long").alias("pos"), "finish_code")
    for m in ("explicit", "fresh"):
        a = a.unionByName(L.select_pages(p, m, 12, r).select(F.lit(m).alias("mode"), "page", "pos", "finish_code"))
    return a


@query("a6_summarise_batch", f"""with {STATUS}, p as (select job_id as batch, page, state from pages_v join st using (page)), b as (select job_id as batch, blocks.page, font_size, label from blocks join pages_v using (page)),
x as (select batch, count(*) as pages, count(*) filter (state='completed') as completed, count(*) filter (state='failed') as failed from p group by batch),
y as (select batch, count(*) as blocks, count(*) filter (font_size<12) as small_text, count(*) filter (label='A') as adjusted, count(*) filter (label='N') as needs_review,
  count(*) filter (label='R') as unverified, count(distinct page) as tp from b group by batch)
select batch, pages, completed, failed, blocks, small_text, adjusted, needs_review, unverified, pages-tp as no_text_pages from x join y using (batch)""")
def _(v):
    p = v.pages_v.join(_status(v), "page").select(c("job_id").alias("batch"), "page", "state")
    b = v.blocks.join(v.pages_v, "page").select(c("job_id").alias("batch"), "page", "font_size", "label")
    y = b.select("batch", F.when(c("label") == "A", "adjusted").when(c("label") == "N", "needs_review").otherwise("unverified").alias("status"))
    return L.summarise_batch(p, b, y)


@query("a7_progress", f"""with {STATUS}, j as (select job_id, case when job_id%4=0 then 'partial' else 'running' end as status, count(*) as pages, count(*) filter (state='completed') as completed,
  (job_id*20)::bigint as initial, 3600.0::double as elapsed from pages_v join st using (page) group by job_id),
f as (select job_id, count(*) filter (state='review') as review_count, count(*) as n from pages_v join st using (page) where state<>'completed' and job_id%3=0 group by job_id)
select job_id, status, greatest(0,pages-completed) as remaining, greatest(0,completed-initial) as added, coalesce(review_count,0) as review_count, coalesce(n,0)-coalesce(review_count,0) as failed_count,
 case when status='running' and completed>initial and pages>completed and n is null then round(elapsed*(pages-completed)/(completed-initial),6) end as eta_seconds from j left join f using (job_id)""")
def _(v):
    s = v.pages_v.join(_status(v), "page")
    j = s.groupBy("job_id").agg(F.count(F.lit(1)).alias("pages"), F.count_if(c("state") == "completed").alias("completed")).withColumns(
        {"status": F.when(c("job_id") % 4 == 0, "partial").otherwise("running"), "initial": (c("job_id") * 20).cast("long"), "elapsed": F.lit(3600.0)})
    f = s.filter("state <> 'completed' and job_id % 3 = 0").select("job_id", "page", F.when(c("state") == "review", "ReviewRequired").otherwise("Error").alias("type"))
    return L.progress(j, f).withColumn("eta_seconds", F.round("eta_seconds", 6))


@query("a9_digest_rows", """select page, sha256('['||string_agg('{"block_id":'||block_id||',"label":"'||label||'","x1":'||x1||'}', ',' order by block_id)||']') as digest from blocks group by page""")
def _(v):
    return L.digest_rows(v.blocks, ["page"], "block_id", ["block_id", "label", "x1"])


@query("a11_duplicate_keys", "select lower(left(source_name,7)) as key, count(*) as entries from manifest group by 1 having count(*)<>1")
def _(v):
    return L.duplicate_keys(v.manifest, F.lower(F.left("source_name", F.lit(7))))


@query("a13_resource_extremes", "select batch, worker, min(value) as min_available, max(value) as peak_rss from job_events group by batch, worker")
def _(v):
    return L.resource_extremes(v.job_events.select("batch", "worker", c("value").alias("available"), c("value").alias("rss")), ["batch", "worker"])


@query("a14_token_totals", """with u as (select cast(conv_id%7 as int) as project, conv_id%4 as f, length(text) as n, turn as t from conversations)
select project, sum(case when f<3 then n end)::bigint as prompt, sum(case when f<3 then t end)::bigint as completion, sum(case when f<2 then t+7 end)::bigint as reasoning,
 sum(case when f=0 then n+t+1 when f<3 then n+t end)::bigint as total, sum(t*2)::bigint as cache_hit, sum(case when f in (1,2) then t+3 end)::bigint as cache_miss, sum(case when f>0 then t+1 end)::bigint as cache_write
from u group by 1""")
def _(v):
    """Four spellings: nested details of two kinds, flat cache fields, and one with unusable counts."""
    n, t = F.length("text").cast("long"), c("turn").cast("long")
    hit, miss, write, think = t * 2, t + 3, t + 1, t + 7

    def usage(**fields):
        return F.to_json(F.struct(*[x.alias(k) for k, x in fields.items()]))

    def details(**fields):
        return F.struct(*[x.alias(k) for k, x in fields.items()])

    forms = [
        usage(prompt_tokens=n, completion_tokens=t, total_tokens=n + t + 1, prompt_tokens_details=details(cached_tokens=hit), completion_tokens_details=details(reasoning_tokens=think)),
        usage(input_tokens=n, output_tokens=t, input_tokens_details=details(cache_read_tokens=hit, cache_miss_tokens=miss, cache_write_tokens=write), output_tokens_details=details(reasoning_tokens=think)),
        usage(prompt_tokens=n, completion_tokens=t, prompt_cache_hit_tokens=hit, cached_tokens=hit + 9, prompt_cache_miss_tokens=miss, prompt_cache_write_tokens=write),
        usage(prompt_tokens=F.lit(-5), input_tokens=n, completion_tokens=F.lit(True), cache_read_input_tokens=hit, cache_creation_input_tokens=write),
    ]
    form = c("conv_id") % 4
    text = F.when(form == 0, forms[0]).when(form == 1, forms[1]).when(form == 2, forms[2]).otherwise(forms[3])
    return L.token_totals(v.conversations.select((c("conv_id") % 7).cast("int").alias("project"), text.alias("usage")), ["project"])



@query("a15_issue_summary", "select event as kind, stage, count(*) as issues from job_events where returncode=1 or event='page_failed' group by cube(event, stage)")
def _(v):
    return L.issue_summary(v.job_events.filter("returncode = 1 or event = 'page_failed'").select(c("event").alias("kind"), "stage"))


@query("a19_stage_progress", """with p as (select job_id, page%16 as code from pages_v), s as (select job_id, stage, avg(case when code & bit <> 0 then 1 else 0 end) as fraction
 from p, (values ('detect',1),('ocr',2),('inpaint',4),('translate',8)) t(stage,bit) group by job_id, stage)
select job_id, stage, round(fraction,6) as fraction, bool_and(fraction>=1) over (partition by job_id) as finished from s""")
def _(v):
    d = L.stage_progress(v.pages_v.select("job_id", (c("page") % 16).cast("int").alias("finish_code")))
    return d.withColumn("fraction", F.round("fraction", 6))


@query("set1_page_key_union", "select distinct page from (select page from blocks where page%3=0 union all select page from candidates where page%2=0) t")
def _(v):
    return L.page_key_union(v.blocks.filter("page % 3 = 0"), v.candidates.filter("page % 2 = 0"))


@query("set2_check_ledger", f"""with {STATUS}, s as (select * from st union all select page, state from st where page%101=0 union all select page, 'applied' from st where page%10=0
  union all select page+5000000, 'failed' from st where page%500=0 union all select page, 'failed' from st where page%77=0),
im as (select page from st where state='completed' and page%50<>0 union select page from st where page%61=0)
select 'duplicate_page' as rule, page from (select distinct page from (select page, state from s group by page, state having count(*)>1) t) u
union all select 'completed_without_image', page from (select distinct page from s where state='completed') t where page not in (select page from im)
union all select 'image_without_completed', page from im where page not in (select page from s where state='completed')
union all select 'completed_and_pending', page from (select distinct page from s where state='completed') t where page in (select page from s where state in ('review','failed'))
union all select 'unknown_page', page from (select distinct page from s) t where page not in (select page from pages_v)
union all select 'pending_and_applied', page from (select distinct page from s where state='review') t where page in (select page from s where state='applied')""")
def _(v):
    st = _status(v)
    s = (st.unionByName(st.filter("page % 101 = 0")).unionByName(st.filter("page % 10 = 0").withColumn("state", F.lit("applied")))
         .unionByName(st.filter("page % 500 = 0").select((c("page") + 5000000).alias("page"), F.lit("failed").alias("state")))
         .unionByName(st.filter("page % 77 = 0").withColumn("state", F.lit("failed"))))
    im = st.filter("state = 'completed' and page % 50 <> 0").select("page").union(st.filter("page % 61 = 0").select("page")).distinct()
    return L.check_ledger(v.pages_v, s, im)


@query("set3_missing_ordinals", """with d as (select distinct (page%20)::int as job_id, block_id*3 - (page%3)::int as o from blocks), m as (select job_id, max(o) as mx from d where o>=1 group by job_id)
select job_id, o as missing from (select job_id, unnest(range(1, mx+1)) as o from m) t where not exists (select 1 from d where d.job_id=t.job_id and d.o=t.o)""")
def _(v):
    d = v.blocks.select((c("page") % 20).cast("int").alias("job_id"), (c("block_id") * 3 - c("page") % 3).alias("o1"))
    return L.missing_ordinals(d, ["job_id"], "o1")


@query("set3b_set_differences", """select page, 'expected_only' as side from (select distinct page from blocks where page%3=0) t where page not in (select page from candidates where page%2=0)
union all select page, 'actual_only' from (select distinct page from candidates where page%2=0) t where page not in (select page from blocks where page%3=0)""")
def _(v):
    return L.set_differences(v.blocks.filter("page % 3 = 0"), v.candidates.filter("page % 2 = 0"))


@query("set4_extend_coverage", """with cv as (select page, cast(page//2+1 as int) as pos from pages_v where page%2=0), nw as (select page from pages_v where page%3=0 and page not in (select page from cv))
select page, pos from cv union all select page, cast((select max(pos) from cv) + row_number() over (order by page) as int) from nw""")
def _(v):
    cv = v.pages_v.filter("page % 2 = 0").select("page", F.expr("cast(page div 2 + 1 as int)").alias("pos"))
    return L.extend_coverage(cv, v.pages_v.filter("page % 3 = 0").select("page", c("page").alias("pos")))


@query("w7_assign_batches", """with o as (select page, job_id, cast(row_number() over (partition by job_id order by page) as int) as ordinal from pages_v)
select page, job_id, ordinal, cast(case when ordinal<=4 then 1 else 2+(ordinal-5)//12 end as int) as batch from o""")
def _(v):
    return L.assign_batches(v.pages_v).select("page", "job_id", "ordinal", "batch")


@query("w8_latest", "select batch, worker, arg_max(event_id, (ts, event_id)) as event_id, arg_max(event, (ts, event_id)) as event from job_events group by batch, worker")
def _(v):
    return L.latest(v.job_events.select("batch", "worker", "ts", "event_id", "event"), ["batch", "worker"], [c("ts"), c("event_id")]).select("batch", "worker", "event_id", "event")


@query("w10_last_sections", "select page, arg_max(source_id, source_id) as idx, arg_max(source, source_id) as text from dialogue group by page")
def _(v):
    return L.last_sections(v.dialogue.select("page", c("source_id").alias("idx"), c("source").alias("text")))


@query("w11_unique_names", """with n as (select doc_id as ordinal, (case when doc_id%3=0 then upper(source) else source end)||'_'||doc_id%50||case when doc_id%7=0 then '.jpg' else '.png' end as name from documents),
s as (select *, regexp_replace(name,'\\.[^.]*$','') as stem from n), t as (select *, count(*) over (partition by lower(stem)) as same from s),
b as (select *, case when same=1 then stem else name end as base from t), k as (select *, row_number() over (partition by lower(base) order by ordinal) as k from b)
select name, ordinal, base||case when k>1 then '('||k||')' else '' end||'.png' as output_name from k""")
def _(v):
    n = v.documents.select(c("doc_id").alias("ordinal"), F.concat(F.when(c("doc_id") % 3 == 0, F.upper("source")).otherwise(c("source")), F.lit("_"), c("doc_id") % 50,
                                                                  F.when(c("doc_id") % 7 == 0, ".jpg").otherwise(".png")).alias("name"))
    return L.unique_names(n)


@query("o1_natural_sort", """with k as (select ordinal, source_name, list_transform(regexp_extract_all(source_name,'\\d+|\\D+'),
  lambda p: case when regexp_matches(p,'^\\d') then (0, length(regexp_replace(p,'^0+(.)','\\1')), regexp_replace(p,'^0+(.)','\\1')) else (1, 0, lower(p)) end) as key from manifest)
select source_name, cast(row_number() over (order by key, ordinal) as int) as position from k""")
def _(v):
    from pagetext.sources.pages import natural_positions

    return natural_positions(v.manifest, "source_name").select("source_name", "position")


@query("o2_bounded_tail", "select event_id, event from job_events order by event_id desc limit 512")
def _(v):
    return L.bounded_tail(v.job_events, "event_id").select("event_id", "event")
