"""Queries over sources, sinks and whole runs."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.q_ledger import CACHE, STATUS, _requests, _status
from pagetext.catalog.q_replies import BUDGET, RESERVED
from pagetext.catalog.registry import query
from pagetext.operators import ledger as L
from pagetext.operators import terms as M
from pagetext.operators.prefix import prefix_scan
from pagetext.plans import runs as P
from pagetext.sources import documents as D
from pagetext.sources import sinks as K

c = F.col
STRIP = r"regexp_replace({0},'^\s+|\s+$','','g')"


@query("s5_read_marked_text", f"""select page%7 as project, dense_rank() over (partition by page%7 order by page)::int - 1 as page_idx, 'conv_'||page as page, row_number() over (partition by page order by source_id)::int as pos,
 {STRIP.format('source')} as text from dialogue""")
def _(v):
    item = F.concat(c("source_id") * 10 + 7, F.lit(". "), "source")
    pages = v.dialogue.groupBy("page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_id", item.alias("t")))), lambda s: s["t"]), "\n\n").alias("t"))
    docs = pages.select((c("page") % 7).alias("project"), c("page").alias("part"), F.concat(F.lit("### conv_"), "page", F.lit("\n\n"), "t").alias("content"))
    # One document a page; the sections of a project are numbered across its documents.
    d = D.parse_marked_text(docs, ["project", "part"])
    sizes = d.groupBy("project", "part").agg((F.max("page_idx") + 1).alias("n"))
    upto = prefix_scan(sizes, ["project"], [c("part")], sums={"upto": c("n")}).select("project", "part", (c("upto") - c("n")).cast("int").alias("before"))
    return d.join(upto, ["project", "part"]).select("project", (c("page_idx") + c("before")).alias("page_idx"), "page", "pos", "text")


@query("s6_read_events", """select event, (date_trunc('second', ts)) as ts, batch, worker, stage, page, returncode, event_id::varchar as seq from job_events where event_id%10<>3 and event_id%10<>4""")
def _(v):
    js = F.to_json(F.struct(F.when(c("event_id") % 10 != 4, c("event")).alias("event"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("ts"), "batch", "worker", "stage", "page", "returncode",
                            c("event_id").cast("string").alias("seq")))
    lines = v.job_events.select(F.when(c("event_id") % 10 == 3, "[1, 2").otherwise(js).alias("value"))
    d = D.parse_events(lines)
    return d.select("event", c("ts").cast("timestamp_ntz").alias("ts"), "batch", "worker", "stage", "page", "returncode", F.element_at("extras", "seq").alias("seq"))


@query("s7_read_overrides", "select page, block_id, label, case when block_id%2=0 then font_size end as font_size from blocks where page%10<>3")
def _(v):
    entry = F.concat(F.lit('"'), c("block_id"), F.lit('":'), F.to_json(F.struct("label", F.when(c("block_id") % 2 == 0, c("font_size")).alias("font_size"))))
    docs = v.blocks.groupBy("page").agg(F.concat(F.lit("{"), F.array_join(F.collect_list(entry), ","), F.when(c("page") % 10 == 3, "").otherwise("}")).alias("content"))
    return D.parse_overrides(docs).select("page", "block_id", "label", "font_size")


@query("s8_write_ledger", """select page, source_id, row_number() over (partition by page order by source_id)::int as reading_order, source, translation, (page%30)::int as font_size, page%30<12 as small_text_review from dialogue""")
def _(v):
    d = L.assign_batches(v.dialogue, ["page"], "source_id").withColumnRenamed("ordinal", "reading_order").withColumns(
        {"font_size": (c("page") % 30).cast("int"), "small_text_review": c("page") % 30 < 12})
    path = K.scratch_dir(v.spark, "ledger")
    K.write_ledger(d, path, "csv")
    return K.read_ledger_csv(v.spark, path, "page bigint, source_id int, reading_order int, source string, translation string, font_size int, small_text_review boolean")


@query("s9_marked_text", f"""select page, 0 as seq, '### '||page as line from (select distinct page from blocks) t
union all select page, block_id, block_id||'. '||label||case when block_id=max(block_id) over (partition by page) then chr(10) else '' end from blocks""")
def _(v):
    return K.to_marked_text(v.blocks.withColumn("text", F.concat(F.lit(" "), "label", F.lit(" "))))


@query("s10_summary_markdown", """select page_idx, '### '||'p'||page||chr(10)||chr(10)||case when page%3=0 then '' else source end||chr(10) as line
from (select page, (page)::int as page_idx, arg_max(source, source_id) as source from dialogue group by page) t""")
def _(v):
    d = L.latest(v.dialogue.select("page", "source_id", "source"), ["page"], [c("source_id")])
    return K.to_summary_md(d.select(c("page").cast("int").alias("page_idx"), F.concat(F.lit("p"), "page").alias("page"), F.when(c("page") % 3 != 0, c("source")).alias("text")))


@query("s10b_read_summary_markdown", """with s as (select page%7 as project, 'p'||page%40 as page, page, arg_max(source, source_id) as source from dialogue where page%5<>0 group by page),
pg as (select distinct page%7 as project, 'p'||page%40 as page from dialogue where page%4<>1)
select pg.project, pg.page, coalesce(arg_max(source, s.page),'') as text from pg left join s on s.project=pg.project and s.page=pg.page group by pg.project, pg.page""".replace("arg_max(source, s.page)", "arg_max(source, num)").replace("page, arg_max(source, source_id) as source from dialogue", "page as num, arg_max(source, source_id) as source from dialogue").replace("group by page)", "group by dialogue.page)"))
def _(v):
    d = L.latest(v.dialogue.filter("page % 5 <> 0").select("page", "source_id", "source"), ["page"], [c("source_id")])
    docs = d.select((c("page") % 7).alias("project"), c("page").alias("part"), F.concat(F.lit("### p"), c("page") % 40, F.lit("\n\n"), "source").alias("content"))
    pages = v.dialogue.filter("page % 4 <> 1").select((c("page") % 7).alias("project"), F.concat(F.lit("p"), c("page") % 40).alias("page")).distinct()
    return D.parse_summary_md(docs, ["project"], pages, "part").select("project", "page", "text")


PUB = """m as (select ordinal as page, source_name as output_name, output_sha256 from manifest), vf as (select ordinal as page, case when ordinal%4=0 then 'new' else source_sha256 end as sha256 from manifest where ordinal%6<>0),
ex as (select source_name as output_name, case when ordinal%9=0 then 'edited' else output_sha256 end as existing_sha256 from manifest where ordinal%5<>0 and output_sha256 is not null),
d as (select page, output_name, output_sha256, sha256, existing_sha256, coalesce(existing_sha256 is not null and existing_sha256<>sha256 and existing_sha256 is distinct from output_sha256, false) as clash from m join vf using (page) left join ex using (output_name))"""


def _publish(v):
    m = v.manifest.select(c("ordinal").alias("page"), c("source_name").alias("output_name"), "output_sha256")
    vf = v.manifest.filter("ordinal % 6 <> 0").select(c("ordinal").alias("page"), F.when(c("ordinal") % 4 == 0, "new").otherwise(c("source_sha256")).alias("sha256"))
    ex = v.manifest.filter("ordinal % 5 <> 0 and output_sha256 is not null").select(c("source_name").alias("output_name"), F.when(c("ordinal") % 9 == 0, "edited").otherwise(c("output_sha256")).alias("existing_sha256"))
    return K.plan_publish(vf, m, ex)


query("s11_publish_writes", f"with {PUB} select page, output_name, sha256 from d where not clash and existing_sha256 is distinct from sha256")(lambda v: _publish(v)[0])
query("s11b_publish_conflicts", f"with {PUB} select page, output_name, existing_sha256, sha256 from d where clash")(lambda v: _publish(v)[1])
query("s11c_publish_manifest", f"with {PUB} select m.page, m.output_name, coalesce(d.sha256, m.output_sha256) as output_sha256 from m left join d on d.page=m.page and not d.clash")(lambda v: _publish(v)[2])


@query("f25_labelled_text", """select page, 0 as seq, '>>>>>>>>['||page||']<<<<<<<<' as line from (select distinct page from blocks) t
union all select page, block_id, '----------------['||block_id||']----------------['||format('{:.6f}', x1/1050.0::double)||', '||format('{:.6f}', y1/1500.0::double)||', 1]'||chr(10)||label from blocks join pages_v using (page)""")
def _(v):
    return K.to_labelled_text(v.dealt_blocks.join(v.pages_v, "page").withColumn("text", c("label")))


@query("c4_incremental_run", f"""with {CACHE}, td as (select distinct page from dialogue where page not in (select page from dialogue where page%4=0)), rr as (select rs.* from rs join td using (page))
select page, content, 'cache' as origin from rr where reason is null union all select page, 'made '||payload_hash, 'processed' from rr where reason is not null
union all select page, 'old '||source_id, 'kept' from dialogue where page%4=0""")
def _(v):
    rq, ca = _requests(v)
    pages = v.dialogue.select("page").distinct()
    prev = v.dialogue.select("page", F.concat(F.lit("old "), "source_id").alias("content"))
    return P.incremental_run(pages, pages.filter("page % 4 = 0").withColumn("state", F.lit("completed")), prev, rq, ca,
                             lambda d: d.select("page", F.concat(F.lit("made "), "payload_hash").alias("content")))


@query("c5_review_gate", f"""with {STATUS}, rc as (select page, case page%5 when 0 then 'pending' when 1 then 'approved_preview' when 4 then 'draft' else 'applied' end as status, case when page%23=0 then 'other' else 'h'||page end as sealed_digest from pages_v),
cf as (select page, bool_and((block_id+page)%29<>0) as all_confirmed from blocks group by page), im as (select page, case when page%19=0 then 'bad' else 's'||page end as sha from st where state='completed' and page%31<>0),
d as (select rc.page, rc.status, coalesce(all_confirmed,false) as ac, state='completed' as done, state='failed' as failed, state='review' as rev, im.sha, case when rc.page%37<>0 then 's'||rc.page end as receipt, 'h'||rc.page as digest, sealed_digest
  from rc left join cf using (page) left join st using (page) left join im on im.page=rc.page),
r as (select *, case when status='draft' then 'unknown_status' when status='pending' and not rev then 'missing_review_state' when status='pending' and (done or sha is not null) then 'pending_but_published' when status='pending' and digest<>sealed_digest then 'rows_changed'
 when status='pending' then 'waiting' when failed or rev then 'conflicting_state' when receipt is null then 'missing_receipt' when status='approved_preview' and not ac then 'unconfirmed_blocks' when status='approved_preview' and digest<>sealed_digest then 'rows_changed'
 when sha is null or sha<>receipt then 'image_differs' when not done then 'not_completed' end as reason from d) select page, status, reason is null as publishable, reason from r""")
def _(v):
    p = v.pages_v
    rem = c("page") % 5
    rc = p.select("page", F.when(rem == 0, "pending").when(rem == 1, "approved_preview").when(rem == 4, "draft").otherwise("applied").alias("status"),
                  F.when(c("page") % 23 == 0, "other").otherwise(F.concat(F.lit("h"), "page")).alias("sealed_digest"))
    st = _status(v)
    im = st.filter("state = 'completed' and page % 31 <> 0").select("page", F.when(c("page") % 19 == 0, "bad").otherwise(F.concat(F.lit("s"), "page")).alias("sha256"))
    return P.review_gate(rc, v.blocks.select("page", "block_id", ((c("block_id") + c("page")) % 29 != 0).alias("confirmed")), st, im,
                         p.filter("page % 37 <> 0").select("page", F.concat(F.lit("s"), "page").alias("output_sha256")), p.select("page", F.concat(F.lit("h"), "page").alias("digest")))


EV = """ev as (select *, case when event='progress' and event_id%500=0 then 'folder_started' else event end as ev2 from job_events),
ep as (select event_id, ts, (page // 12) % 3 as job_id, batch, worker, ev2 as event, stage, page, returncode, sum(case when ev2='folder_started' then 1 else 0 end) over (partition by (page // 12) % 3 order by ts, event_id rows unbounded preceding) as epoch from ev),
sa as (select *, max(case when event in ('stage_started','stage_finished') then (ts, event_id, case when event='stage_started' then stage end) end) over (partition by job_id, epoch, batch, worker order by ts, event_id rows between unbounded preceding and 1 preceding) as l from ep),
so as (select *, l[3] as open_stage from sa)"""


def _events(v):
    """Events of three jobs that share batches and workers."""
    return v.job_events.withColumn("job_id", F.floor(c("page") / 12) % 3).withColumn("event", F.when((c("event") == "progress") & (c("event_id") % 500 == 0), "folder_started").otherwise(c("event")))


query("st2_stage_at_events", f"with {EV} select event_id, epoch::bigint as epoch, batch, worker, event, open_stage from so".replace("l[3]", "struct_extract_at(l,3)"))(
    lambda v: P.stage_at_events(_events(v)).select("event_id", c("epoch").cast("long").alias("epoch"), "batch", "worker", "event", "open_stage"))
query("st2b_failed_stages", f"""with {EV},
ok as (select *, (ts, event_id) as at from ep),
f as (select * from ok where event='stage_finished' and returncode<>0)
select f.job_id, f.epoch::bigint as epoch, f.batch, f.worker, f.stage from f where not exists (select 1 from ok o where o.job_id=f.job_id and o.epoch=f.epoch and o.batch=f.batch and o.at>f.at
 and (o.event='chunk_ready' or (o.worker=f.worker and o.event in ('stage_started','stage_finished'))))""".replace("l[3]", "struct_extract_at(l,3)"))(
    lambda v: P.failed_stages(_events(v)).select("job_id", c("epoch").cast("long").alias("epoch"), "batch", "worker", "stage"))


@query("c6_diagnose", f"""with {EV}, us as (select distinct user_id as page from events),
sv as (select * from (select page, type, ctx, cb, path, row_number() over (partition by page order by prio desc) rn from (select page, 'TypeA' as type, null as ctx, null::int as cb, 'w/render.log' as path, 1 as prio from us where page%3=0
  union all select page, case when page%4=0 then 'ReviewRequired' else 'TypeB' end, case when page%8=0 then 'ocr' end, 77, 'w/x', 2 from us where page%2=0) t) t where rn=1),
vr as (select page, page%5=0 as done, page%7=0 as failed, page%11=0 as rev from us where page%5=0 or page%7=0 or page%11=0),
td as (select so.page, arg_max(event, (ts, event_id)) as event, arg_max(batch, (ts, event_id)) as batch, arg_max(worker, (ts, event_id)) as worker, arg_max(coalesce(open_stage,''), (ts, event_id)) as open_stage from so left join vr on vr.page=so.page
  where event='page_failed' and (event_id%50=0 or not coalesce(done,false)) group by so.page),
j as (select us.page, sv.page is not null as saved, coalesce(done,false) as done, coalesce(failed,false) as failed, coalesce(rev,false) as rev, type, ctx, cb, path, td.event, td.batch, td.worker, nullif(td.open_stage,'') as os from us left join sv using (page) left join vr using (page) left join td using (page)
  where (sv.page is not null and not coalesce(done,false)) or coalesce(failed,false) or coalesce(rev,false) or td.event is not null),
k as (select *, case when rev then 'ReviewRequired' else coalesce(case when saved and not done then type end, 'PageFailure') end as ty, case when saved and not done then case when ctx='ocr' then 'prepare' when path='w/render.log' then 'render' end end as s,
  case when saved and not done then case when ctx='ocr' then 'context' when path='w/render.log' then 'token:render.log' end end as p from j)
select page, 'u'||page||'.png' as source_name, page::int as page_index, case when ty='ReviewRequired' then 'review' else 'page_failure' end as kind, ty as type, coalesce(batch, case when saved and not done then cb end, (page%4)::int) as batch,
 coalesce(s, case when event is not null then coalesce(os, case when worker='translate' then 'translate' else 'unknown' end) else 'unknown' end) as stage, coalesce(p, case when event is not null then 'event:'||event else 'none' end) as evidence from k""".replace("l[3]", "struct_extract_at(l,3)"))
def _(v):
    us = v.events.select(c("user_id").alias("page")).distinct()
    none = F.lit(None).cast("string")
    a = us.filter("page % 3 = 0").select("page", F.lit("TypeA").alias("type"), none.alias("context_stage"), F.lit(None).cast("int").alias("context_batch"), F.lit("w/render.log").alias("path"), F.lit(1).alias("priority"))
    b = us.filter("page % 2 = 0").select("page", F.when(c("page") % 4 == 0, "ReviewRequired").otherwise("TypeB").alias("type"), F.when(c("page") % 8 == 0, "ocr").alias("context_stage"), F.lit(77).alias("context_batch"), F.lit("w/x").alias("path"), F.lit(2).alias("priority"))
    fails = a.unionByName(b).withColumns({"operation": none, "message": none, "reason": none})
    states = F.array_compact(F.array(F.when(c("page") % 5 == 0, "completed"), F.when(c("page") % 7 == 0, "failed"), F.when(c("page") % 11 == 0, "review")))
    return P.diagnose(us.select("page", F.concat(F.lit("u"), "page", F.lit(".png")).alias("source_name"), c("page").cast("int").alias("page_index")), fails,
                      us.select("page", (c("page") % 4).cast("int").alias("chunk_batch")), us.select("page", F.explode(states).alias("state")), _events(v).withColumn("live", c("event_id") % 50 == 0))


@query("c7_context_requests", f"""with r as (select a.project, a.page as request_page, b.page, b.tokens, row_number() over (partition by a.project, a.page order by b.page desc) as pos from page_tokens a join page_tokens b on a.project=b.project and b.page<a.page and b.complete=1),
k as (select *, min(case when tokens<={BUDGET - RESERVED} then pos end) over (partition by project, request_page) as k0 from r),
s as (select *, sum(tokens) over (partition by project, request_page order by pos) as run, max(case when pos=k0 then tokens end) over (partition by project, request_page) as t0 from k where pos>=k0),
h as (select request_page, count(*) as n, sum(tokens)::bigint as t from s where case when t0>{BUDGET // 2 - RESERVED} then pos=k0 else run<={BUDGET // 2 - RESERVED} end group by request_page),
q as (select a.project, a.page as request_page, b.page, b.tokens, sum(b.tokens) over (partition by a.project, a.page order by b.page desc) as run from page_tokens a join page_tokens b on a.project=b.project and b.page<=a.page),
sm as (select request_page, count(*) as n, sum(tokens)::bigint as t from q where page=request_page or run<=5000 group by request_page),
g as (select page, count(distinct entry_idx) as n from dialogue d join glossary g on contains(replace(lower(d.source),'ß','ss'), replace(lower(g.source),'ß','ss')) group by page)
select p.project, p.page as request_page, coalesce(h.n,0) as history_pages, coalesce(h.t,0) as history_tokens, coalesce(sm.n,0) as summary_pages, coalesce(sm.t,0) as summary_tokens, coalesce(g.n,0) as terms,
 coalesce(h.t,0)+coalesce(sm.t,0)+{RESERVED} as context_tokens from page_tokens p left join h on h.request_page=p.page left join sm on sm.request_page=p.page left join g on g.page=p.page""")
def _(v):
    m = M.match_glossary(v.dialogue.select("page", c("source").alias("text")), v.glossary)
    return P.context_requests(v.page_tokens, BUDGET, RESERVED, v.page_tokens, 5000, m).drop("first_page")


@query("c8_crop_text_review", """with r as (select page, block_id, label as text, case when block_id%5=0 then '' when block_id%3=0 then label||'x' else label end as padded, case when block_id%7=0 then 'z' when block_id%5=0 then '' when block_id%3=0 then label||'x' else label end as unpadded,
 page%4<>0 as has, font_size%3=0 as sus from blocks)
select page, block_id, case when has and padded<>'' and padded=unpadded then padded else text end as new_text,
 case when has and padded<>'' and padded=unpadded then case when padded<>text then 'corrected' else 'unchanged' end when has or sus then 'needs_review' else 'unchanged' end as status,
 case when has and padded<>'' and padded=unpadded then case when padded<>text then 'complete_crop_and_2px_agree' else 'complete_crop_matches_original_text' end when has then 'complete_crop_readings_disagree' when sus then 'no_candidate' end as reason from r""")
def _(v):
    p = F.when(c("block_id") % 5 == 0, "").when(c("block_id") % 3 == 0, F.concat("label", F.lit("x"))).otherwise(c("label"))
    d = v.blocks.select("page", "block_id", c("label").alias("text"), p.alias("padded"), F.when(c("block_id") % 7 == 0, "z").otherwise(p).alias("unpadded"), (c("page") % 4 != 0).alias("has_candidate"), (c("font_size") % 3 == 0).alias("suspicious"))
    return P.crop_text_review(d).select("page", "block_id", "new_text", "status", "reason")


@query("s3_read_project", """select page, block_id, x1::double as x1, y2::double as y2, label as text, case when block_id%3=0 then null else vertical end as vertical from blocks where page%9<>4""")
def _(v):
    text = F.when(c("block_id") % 2 == 0, F.concat(F.lit('"'), "label", F.lit('"'))).otherwise(F.concat(F.lit('["'), "label", F.lit('"]')))
    block = F.concat(F.lit('{"xyxy":['), F.concat_ws(",", "x1", "y1", "x2", "y2"), F.lit('],"text":'), text, F.lit(',"src_is_vertical":'),
                     F.when(c("block_id") % 3 == 0, "null").otherwise(c("vertical").cast("string")), F.lit("}"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block_id", block.alias("t")))), lambda s: s["t"]), ",")
    docs = v.blocks.groupBy("page").agg(listed.alias("b")).select(c("page").cast("string").alias("path"), F.concat(
        F.lit('{"pages":{"'), "page", F.lit('.png":['), "b", F.when(c("page") % 9 == 4, "").otherwise("]}}")).alias("content"))
    blocks, _, _ = D.parse_project(docs)
    return blocks.select(F.regexp_extract("page", r"^(\d+)", 1).cast("long").alias("page"), c("block_id").cast("int").alias("block_id"), "x1", "y2", F.array_join("text", "").alias("text"), "vertical")


GLOSS = """l as (select doc_id, unnest(string_split(text, chr(10))) as raw, generate_subscripts(string_split(text, chr(10)),1)::int as i from documents),
m as (select doc_id, i, regexp_replace(raw,'^\\s+|\\s+$','','g') as s from l), g as (select * from m where s<>'' and not regexp_matches(s,'^(#|//|\\\\\\\\)') and not contains(s, chr(9)) and not contains(s,'->'))"""


def _gloss(v):
    line = F.concat(c("raw"), F.when((c("i") % 3 != 2) & (F.trim("raw") != ""), F.concat(F.lit(" -> T"), c("i") + 1, F.lit(" # n"))).otherwise(""))
    d = v.documents.select("doc_id", F.posexplode(F.split("text", "\n")).alias("i", "raw")).select("doc_id", "i", line.alias("t"))
    docs = d.groupBy("doc_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda s: s["t"]), "\n").alias("content"))
    return D.parse_glossary(docs.select(c("doc_id").cast("string").alias("path"), "content"))


query("s4_read_glossary", f"with {GLOSS} select doc_id::varchar as path, i as entry_idx, s as source, 'T'||i as translation, 'n' as note from g where (i-1)%3<>2")(lambda v: _gloss(v)[0])
query("s4b_glossary_rejects", f"with {GLOSS} select doc_id::varchar as path, 'line '||i as location, 'expected an arrow or tabs' as reason from g where (i-1)%3=2")(lambda v: _gloss(v)[1])
