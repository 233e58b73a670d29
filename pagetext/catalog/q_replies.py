"""Queries over model replies and context windows."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.registry import query
from pagetext.operators import context as X
from pagetext.operators import replies as R
from pagetext.operators import terms as M

c = F.col

REPLY = """rp as (select page, source_id, case when page%3=0 then content else replace(content, '"'||source_id||'"', '"1"') end as content from replies),
bd as (select *, case when contains(content,'```') then regexp_extract(content,'```(?:json)?\\s*(\\{.*\\})\\s*```',1,'s') else content end as body from rp),
js as (select *, case when json_valid(body) then coalesce(json_extract_string(body,'$.translations.1'), json_extract_string(body,'$.1')) end as t,
  case when json_valid(body) then len(json_keys(case when json_exists(body,'$.translations') then json_extract(body,'$.translations') else body::json end)) end as n from bd)"""


def _replies(v):
    sid = F.concat(F.lit('"'), c("source_id"), F.lit('"'))
    d = v.replies.withColumn("content", F.when(c("page") % 3 == 0, c("content")).otherwise(F.replace("content", sid, F.lit('"1"')))).withColumn("expected", F.lit(1))
    return R.parse_replies(d, ["page", "source_id"])


query("f13_parse_replies", f"with {REPLY} select page, source_id, 1 as id, t as text from js where t is not null and n=1")(lambda v: _replies(v)[0])
query("f13b_reply_rejects", f"with {REPLY} select page, source_id, case when json_valid(body) then 'wrong_ids' else 'invalid_json' end as reason from js where t is null")(lambda v: _replies(v)[2])
query("f13c_reply_summaries", f"with {REPLY} select page, source_id, 's t' as summary from js where t is not null and contains(body,'page_summary')")(lambda v: _replies(v)[1])

STRICT = """k as (select page, count(*)::int as n, '{'||string_agg('"'||block_id||'":'||case when page%11=0 and block_id=2 then '5' else '"  '||label||'  '||block_id||' "' end, ',' order by block_id)||'}' as t,
 '['||string_agg('"'||block_id||'"', ',' order by block_id desc)||']' as o from blocks group by page),
j as (select page, case when page%17=0 then n+1 else n end as n, case when page%7=0 then '{"texts":'||t||'}' when page%13=0 then '{"texts":'||t else '{"texts":'||t||',"order":'||case when page%5=0 then '["1"]' else o end||'}' end as content, n as real from k)"""


def _strict(v):
    key = F.concat(F.lit('"'), c("block_id"), F.lit('"'))
    val = F.when((c("page") % 11 == 0) & (c("block_id") == 2), "5").otherwise(F.concat(F.lit('"  '), "label", F.lit("  "), "block_id", F.lit(' "')))
    text = lambda a: F.array_join(F.transform(a, lambda s: s["x"]), ",")
    d = v.blocks.groupBy("page").agg(F.count(F.lit(1)).cast("int").alias("n"), text(F.array_sort(F.collect_list(F.struct("block_id", F.concat(key, F.lit(":"), val).alias("x"))))).alias("t"),
                                     text(F.reverse(F.array_sort(F.collect_list(F.struct("block_id", key.alias("x")))))).alias("o"))
    body = F.when(c("page") % 7 == 0, F.concat(F.lit('{"texts":{'), "t", F.lit("}}"))).when(c("page") % 13 == 0, F.concat(F.lit('{"texts":{'), "t", F.lit("}"))).otherwise(
        F.concat(F.lit('{"texts":{'), "t", F.lit('},"order":'), F.when(c("page") % 5 == 0, '["1"]').otherwise(F.concat(F.lit("["), "o", F.lit("]"))), F.lit("}")))
    return R.parse_page_text(d.select("page", F.when(c("page") % 17 == 0, c("n") + 1).otherwise(c("n")).alias("expected"), body.alias("content")), ["page"])


BAD26 = "case when page%7=0 then 'wrong_fields' when page%13=0 then 'invalid_json' when page%17=0 then 'wrong_ids' when page%11=0 and real>=2 then 'not_a_string' when page%5=0 and real<>1 then 'wrong_order' end"
query("f26_parse_page_text", f"with {STRICT} select b.page, block_id as id, label||' '||block_id as text, (real-block_id+1)::int as position from blocks b join j using (page) where {BAD26} is null")(lambda v: _strict(v)[0])
query("f26b_page_text_rejects", f"with {STRICT} select page, {BAD26} as reason from j where {BAD26} is not null")(lambda v: _strict(v)[1])

ALIGN = """bl as (select page, source_id, row_number() over (partition by page order by source_id) as position from dialogue),
pr as (select page, string_agg(case when page%4=0 then '「'||content||'」' else content end, chr(10)||chr(10) order by source_id) as content from replies group by page),
ln as (select page, list_transform(list_filter(string_split(content,chr(10)), lambda x: trim(x)<>''), lambda x: regexp_replace(trim(x),'^[「」]+|[「」]+$','','g')) as l from pr),
st as (select page, count(*) as n, any_value(len(l)) as m from bl join ln using (page) group by page),
br as (select page, source_id, list_transform(list_filter(string_split(content,chr(10)), lambda x: trim(x)<>''), lambda x: regexp_replace(trim(x),'^[「」]+|[「」]+$','','g')) as l from replies where page%3<>0),
tr as (select bl.page, bl.source_id, position, br.l, coalesce(len(br.l)=1 and br.l[1]<>'',false) as good from bl join st using (page) left join br on br.page=bl.page and br.source_id=bl.source_id where n<>m),
pg as (select *, bool_and(good) over (partition by page) as page_good from tr)"""


def _align(v):
    from pagetext.operators.ledger import assign_batches

    bl = assign_batches(v.dialogue.select("page", "source_id"), ["page"], "source_id").select("page", "source_id", c("ordinal").alias("position"))
    q = F.when(c("page") % 4 == 0, F.concat(F.lit("「"), "content", F.lit("」"))).otherwise(c("content"))
    pr = v.replies.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", q.alias("q")))), lambda s: s["q"]), "\n\n").alias("content"))
    return R.align_replies(bl, pr, v.replies.filter("page % 3 <> 0"))


query("c2_align_replies", f"""with {ALIGN} select bl.page, bl.source_id, bl.position::int as position, ln.l[bl.position] as translation, false as review from bl join st using (page) join ln using (page) where n=m
union all select page, source_id, position::int, l[1], true from pg where page_good""")(lambda v: _align(v)[0])
query("c2b_recovery_list", f"with {ALIGN} select page, source_id, case when l is null then 'request' when not good then 'bad_reply' else 'page_incomplete' end as action from pg where not page_good")(lambda v: _align(v)[1])

PROMPT = """'Translate the following JSON array from German to English.'||chr(10)||chr(10)||'INPUT:'||chr(10)||'['||chr(10)||string_agg('  {'||chr(10)||'    "id": '||position||','||chr(10)||'    "source": '||to_json(source)||chr(10)||'  }', ','||chr(10) order by position)||chr(10)||']'"""


@query("f14_build_requests", f"""with bl as (select page, source, row_number() over (partition by page order by source_id) as position from dialogue), gm as (select distinct page, entry_idx from dialogue d join glossary g
  on contains(replace(lower(d.source),'ß','ss'), replace(lower(g.source),'ß','ss'))),
gr as (select page, string_agg(source||'->'||translation, chr(10) order by entry_idx) as rendered from gm join glossary using (entry_idx) group by page),
pt as (select page, {PROMPT} as p from bl group by page)
select page, 1 as seq, 'system' as role, 'Translate comic text.' as content from pt union all select page, 2, 'system', 'memory of '||page from pt
union all select page, 3, 'user', p||coalesce(chr(10)||chr(10)||'GLOSSARY:'||chr(10)||rendered,'') from pt left join gr using (page)""")
def _(v):
    from pagetext.operators.ledger import assign_batches

    bl = assign_batches(v.dialogue, ["page"], "source_id").select("page", "source", c("ordinal").alias("position"))
    m = M.match_glossary(v.dialogue.select("page", c("source").alias("text")), v.glossary)
    mem = v.dialogue.select("page").distinct().withColumn("text", F.concat(F.lit("memory of "), "page"))
    return R.build_requests(bl, "German", "English", glossary=M.render_glossary(m, v.glossary, form="lines"), memory=mem).select("page", "seq", "role", "content")


def _shout(texts):
    return [t.upper() for t in texts] if len(texts) != 3 else texts[:-1]


UP = "translate(upper(replace(source,'ß','SS')),'','')"
ROUTE = """with n as (select *, count(*) filter (x<>'') over (partition by page) as k from (select page, source_id, source, case when source_id%4=2 and page%2=0 then '' else source end as x from dialogue) t)"""


def _route(v):
    d = v.dialogue.select("page", "source_id", F.when((c("source_id") % 4 == 2) & (c("page") % 2 == 0), "").otherwise(c("source")).alias("text"))
    return R.route_non_empty(d, _shout)


query("u1_batch_function", f"select page, source_id, {UP} as result from dialogue where page in (select page from dialogue group by page having count(*)<>3)")(
    lambda v: R.apply_batch_fn(v.dialogue.select("page", "source_id", c("source").alias("text")), _shout)[0].select("page", "source_id", "result"))
query("u1b_batch_rejects", "select page, source_id, 'wrong_length' as reason from dialogue where page in (select page from dialogue group by page having count(*)=3)")(
    lambda v: R.apply_batch_fn(v.dialogue.select("page", "source_id", c("source").alias("text")), _shout)[1].select("page", "source_id", "reason"))
query("u2_route_non_empty", f"{ROUTE} select page, source_id, upper(replace(x,'ß','SS')) as result from n where x='' or k<>3")(lambda v: _route(v)[0].select("page", "source_id", "result"))
query("u3_joined_function", "select page, source_id, reverse(replace(source,chr(10),' ')) as result from dialogue where page in (select page from dialogue group by page having count(*)=1)")(
    lambda v: R.apply_joined_fn(v.dialogue.select("page", "source_id", F.replace("source", F.lit("\n"), F.lit(" ")).alias("text")),
                                lambda s: s[::-1] if "\n" not in s else s.replace("\n", " "), "\n")[0].select("page", "source_id", "result"))
query("u4_retry_by_row", f"select page, source_id, {UP} as result, case when page in (select page from dialogue group by page having count(*)=3) then 'row' else 'batch' end as how from dialogue")(
    lambda v: R.retry_by_row(v.dialogue.select("page", "source_id", c("source").alias("text")), _shout).select("page", "source_id", "result", "how"))

BUDGET, RESERVED = 6000, 300


@query("w5_history_suffix", f"""with r as (select a.project, a.page as request_page, b.page, b.tokens, row_number() over (partition by a.project, a.page order by b.page desc) as pos
  from page_tokens a join page_tokens b on a.project=b.project and b.page<a.page and b.complete=1),
k as (select *, min(case when tokens<={BUDGET - RESERVED} then pos end) over (partition by project, request_page) as k0 from r),
s as (select *, sum(tokens) over (partition by project, request_page order by pos) as run, max(case when pos=k0 then tokens end) over (partition by project, request_page) as t0 from k where pos>=k0)
select project, request_page, page, tokens::bigint as tokens from s where case when t0>{BUDGET // 2 - RESERVED} then pos=k0 else run<={BUDGET // 2 - RESERVED} end""")
def _(v):
    return X.history_suffix(v.page_tokens, BUDGET, RESERVED)


@query("w6_fit_summaries", """with r as (select a.project, a.page as request_page, b.page, b.tokens, sum(b.tokens) over (partition by a.project, a.page order by b.page desc) as run
  from page_tokens a join page_tokens b on a.project=b.project and b.page<=a.page)
select project, request_page, page, tokens::bigint as tokens from r where page=request_page or run<=5000""")
def _(v):
    return X.fit_summaries(v.page_tokens, 5000)


@query("w12_rebuild_reason", """with p as (select project, page, lag(page) over (partition by project order by page) as prev from page_tokens),
w as (select project, page, case when page%5=0 then null when page%7=0 then page-14 else page-7 end as window_page, case when page%11=0 then 'y' else 'x' end as wl, case when page%13=0 then 1 else 0 end as ws from page_tokens)
select project, page, case when window_page is null then 'window-empty' when page%9=0 then 'missing-load-identity' when wl<>'x' then 'project-changed' when ws<>0 then 'settings-changed'
 when prev is null or prev<>window_page then 'non-adjacent' end as reason from p join w using (project, page)""")
def _(v):
    p = v.page_tokens.select("project", "page", F.when(c("page") % 9 != 0, "x").alias("load_id"), F.lit(0).alias("settings"))
    w = v.page_tokens.select("project", "page", F.when(c("page") % 5 == 0, None).when(c("page") % 7 == 0, c("page") - 14).otherwise(c("page") - 7).alias("window_page"),
                             F.when(c("page") % 11 == 0, "y").otherwise("x").alias("window_load_id"), F.when(c("page") % 13 == 0, 1).otherwise(0).alias("window_settings"))
    return X.rebuild_reason(p, w)
