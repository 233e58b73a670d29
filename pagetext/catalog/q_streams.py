"""Queries that run streams over the given events until everything available is processed."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.registry import query
from pagetext.streaming import events as E
from pagetext.streaming import history as H

c = F.col


def _event_stream(v):
    """The event view as a stream of the given file."""
    raw = v.spark.readStream.schema(v.events.schema).parquet(f"{v.sf_dir}/events.parquet*")
    kind = (F.when(c("event_type") == "view", "stage_started").when(c("event_type") == "purchase", "stage_finished").when(c("event_type") == "error", "page_failed")
            .when(c("event_type") == "signup", "chunk_ready").otherwise("progress"))
    stage = F.when(c("user_id") % 3 == 0, "prepare").when(c("user_id") % 3 == 1, "translate").otherwise("render")
    return raw.select("event_id", c("ts").cast("timestamp").alias("ts"), (c("user_id") % 12).cast("int").alias("batch"), F.when(c("user_id") % 2 == 0, "cpu").otherwise("translate").alias("worker"),
                      kind.alias("event"), stage.alias("stage"), c("user_id").alias("page"), "value", F.when(c("value") > 40, 1).otherwise(0).alias("returncode"))


def _naive(df, *names):
    return df.withColumns({n: c(n).cast("timestamp_ntz") for n in names})


@query("st1_stream_events", "select event_id, ts, batch, worker, event, stage, page, returncode from job_events")
def _(v):
    return _naive(E.run_available(_event_stream(v).drop("value"), "events"), "ts")


@query("st3_live_progress", "select date_trunc('hour', ts) as window_start, batch, event, count(*) as n from job_events group by 1,2,3")
def _(v):
    return _naive(E.run_upsert(E.live_progress(_event_stream(v)), "progress", ["window_start", "batch", "event"]), "window_start")


@query("st4_resource_monitor", """with s as (select batch as job_id, value, time_bucket(interval 30 minutes, ts, timestamp '2000-01-01') as b from job_events), w as (select job_id, value, b as window_start from s union all select job_id, value, b - interval 30 minutes from s),
m as (select window_start, job_id, min(value) as min_available from w group by 1,2)
select *, case when min_available<4 then 'stop' when min_available<6.5 then 'wait' else 'run' end as decision from m""")
def _(v):
    s = _event_stream(v).select("ts", c("batch").alias("job_id"), "value")
    return _naive(E.run_upsert(E.resource_monitor(s, stop=4, wait=6.5), "resources", ["window_start", "job_id"]), "window_start")


@query("st5_attempt_sessions", """with a as (select page as label, ts, case when value<=40 then null when event_id%2=0 then 'repetition_loop' else 'line_alignment' end as kind from job_events),
g as (select *, case when ts < lag(ts) over (partition by label order by ts) + interval 3 hours then 0 else 1 end as new from a), s as (select *, sum(new) over (partition by label order by ts rows unbounded preceding) as sid from g),
t as (select label, sid, min(ts) as session_start, max(ts) as last, count(*) as attempts, count(kind) as failures, count(*) filter (kind='repetition_loop') as loops from s group by label, sid)
select session_start, label, attempts, failures, case when failures<attempts then 'done' when failures>=3 then 'failed' else 'open' end as outcome, least(loops,2) as level from t
where last + interval 3 hours <= (select max(ts) from events) - interval 10 minutes""")
def _(v):
    kind = F.when(c("value") > 40, F.when(c("event_id") % 2 == 0, "repetition_loop").otherwise("line_alignment"))
    a = _event_stream(v).select("ts", c("page").alias("label"), kind.alias("failure_kind"))
    return _naive(E.run_available(E.attempt_sessions(a, gap="3 hours"), "attempts"), "session_start")


@query("st5b_attempt_chains", """with a as (select page::varchar as label, ts, event_id, case when value<=40 then null when event_id%2=0 then 'repetition_loop' else 'line_alignment' end as kind from job_events),
s as (select *, coalesce(sum((kind is null)::int) over (partition by label order by ts, event_id rows between unbounded preceding and 1 preceding), 0) as seg from a),
j as (select *, row_number() over (partition by label, seg order by ts, event_id) - 1 as j from s), k as (select *, j//3 as part, j%3 + 1 as attempt from j)
select label, event_id, dense_rank() over (partition by label order by seg, part)::int as chain, attempt::int as attempt,
 coalesce(sum((kind='repetition_loop')::int) over (partition by label, seg, part order by ts, event_id rows between unbounded preceding and 1 preceding), 0)::int as level,
 case when kind is null then 'done' when attempt=3 then 'failed' else 'retry' end as outcome from k""")
def _(v):
    kind = F.when(c("value") > 40, F.when(c("event_id") % 2 == 0, "repetition_loop").otherwise("line_alignment"))
    return E.run_available(E.attempt_chains(_event_stream(v).select(c("page").cast("string").alias("label"), "ts", "event_id", kind.alias("failure_kind"))), "chains")


@query("st6_dedupe_issues", "select distinct page from job_events where event='page_failed' and (event_id%50=0 or page%5<>0)")
def _(v):
    done = v.events.filter("user_id % 5 = 0").select(c("user_id").alias("page"))
    d = E.dedupe_issues(_event_stream(v).withColumn("live", c("event_id") % 50 == 0), done)
    return E.run_available(d.select("page"), "issues")


TRACK = """e as (select *, case when event in ('stage_started','stage_finished') then (ts, event_id, case when event='stage_started' then stage end) end as o,
 case when event in ('stage_started','stage_finished') then (ts, event_id, case when event='stage_finished' and returncode<>0 then stage end) end as f,
 case when event='chunk_ready' then (ts, event_id) end as r from job_events),
m as (select *, max(o) over w as mo, max(f) over w as mf, max(r) over b as mr from e window w as (partition by batch, worker order by ts, event_id rows unbounded preceding),
 b as (partition by batch order by ts, event_id rows unbounded preceding))"""


@query("st2c_track_stages", f"""with {TRACK} select '0' as run_id, batch, worker, event_id, event, struct_extract_at(mo,3) as open_stage,
 case when mr is null or (struct_extract_at(mf,1), struct_extract_at(mf,2)) > (struct_extract_at(mr,1), struct_extract_at(mr,2)) then struct_extract_at(mf,3) end as failed_stage from m""")
def _(v):
    return E.run_available(E.track_stages(_event_stream(v).withColumn("run_id", F.lit("0"))), "stages")


@query("st9_trailing_repeats", """with p as (select doc_id as reply, unnest(string_split(text,' ')) as piece, generate_subscripts(string_split(text,' '),1) as seq from documents), d as (select * from p where piece<>''),
k as (select *, lag(trim(piece)) over (partition by reply order by seq) as before from d), l as (select reply, max(seq) as m from k where before is null or before<>trim(piece) group by reply)
select d.reply, count(*) as run, count(*)>=2 as looping from d join l using (reply) where seq>=m group by d.reply""")
def _(v):
    d = v.documents.select(c("doc_id").alias("reply"), F.posexplode(F.split("text", " ")).alias("seq", "piece"))
    return E.trailing_repeats(d, repeats=2)


@query("st9b_repeat_guard", """with k as (select batch, event_id, event, lag(event) over (partition by batch order by event_id) as before from job_events), g as (select *, sum(case when before is null or before<>event then 1 else 0 end) over (partition by batch order by event_id rows unbounded preceding) as i from k)
select batch::bigint as reply, event_id as seq, cast(row_number() over (partition by batch, i order by event_id) as int) as run, row_number() over (partition by batch, i order by event_id)>=3 as looping from g""")
def _(v):
    return E.run_available(E.repeat_guard(_event_stream(v).select(c("batch").cast("long").alias("reply"), c("event_id").alias("seq"), c("event").alias("piece")), repeats=3), "guard")


def _history_pages(df, order):
    return df.select((c("user_id") % 7).cast("int").alias("project"), c(order).alias("page"), (c("value") * 20).cast("long").alias("tokens"), (c("event_id") % 9 != 0).cast("int").alias("complete"), (c("event_id") % 5 != 0).alias("requested"))


BUDGET, RESERVED = 4000, 200
LOW, HIGH = BUDGET // 2 - RESERVED, BUDGET - RESERVED
# One row a step: the held window, the page asked for last, what a rebuild would take, and whether an oversized page cuts it.
ROLLING = f"""with recursive p as (select *, row_number() over (partition by project order by page) as rn, lag(page) over w as ppage, lag(tokens) over w as ptok, lag(complete) over w as pdone
  from (select (user_id%7)::int as project, event_id as page, cast(trunc(value*20) as bigint) as tokens, event_id%9<>0 as complete, event_id%5<>0 as requested from events)
  window w as (partition by project order by page)),
r as (select project, 0::bigint as rn, null::bigint[] as held, null::bigint as asked, []::bigint[] as recent, false as barrier, null::bigint as page, null::varchar as action, null::varchar as reason, 0::bigint as appended, 0::bigint as evicted, false as shown
  from (select distinct project from p)
 union all select project, rn, held, asked, recent, barrier, page, action, reason, appended, evicted, shown from (
  select n.project, n.rn, case when not n.requested then s.held when n.why is not null then s.recent when n.grow then list_append(s.held, n.ptok)
    when n.fits then list_append(s.held[n.cut + 1:], n.ptok) else s.held[n.cut + 1:] end as held,
   case when n.requested then n.page else s.asked end as asked,
   case when not n.complete or n.tokens > {HIGH} then s.recent else n.fresh[coalesce(list_min(list_filter(range(0, len(n.fresh)), lambda i: list_sum(n.fresh[i + 1:]) <= {LOW})), len(n.fresh) - 1) + 1:] end as recent,
   case when not n.complete then s.barrier else n.tokens > {HIGH} end as barrier, n.page,
   case when n.why is not null then case when len(s.recent) > 0 then 'rebuild' else 'empty' end when n.grow then 'grow' when n.fits or n.cut > 0 then 'evict' else 'reuse' end as action,
   case when n.why is not null then n.why when not n.fits then 'oversized-page' end as reason, (n.why is null and n.fits)::bigint as appended, case when n.why is null and not n.grow then n.cut else 0 end as evicted, n.requested as shown
  from r s join (select q.*, t.rn as at, case when t.held is null then 'window-empty' when q.ppage is null or q.ppage <> t.asked then 'non-adjacent' when not q.pdone then 'previous-ineligible' end as why,
     q.ptok <= {HIGH} as fits, q.ptok <= {HIGH} and coalesce(list_sum(t.held), 0) + q.ptok <= {HIGH} as grow,
     case when q.ptok <= {HIGH} or coalesce(list_sum(t.held), 0) > {HIGH} then coalesce(list_min(list_filter(range(0, len(t.held) + 1), lambda i: coalesce(list_sum(t.held[i + 1:]), 0) <= {LOW} - case when q.ptok <= {HIGH} then q.ptok else 0 end)), len(t.held)) else 0 end as cut,
     case when t.barrier then [q.tokens] else list_append(t.recent, q.tokens) end as fresh from r t join p q on q.project = t.project and q.rn = t.rn + 1) n on n.project = s.project and n.at = s.rn))
select project, page, action, reason, coalesce(len(held), 0)::int as page_count, (coalesce(list_sum(held), 0) + {RESERVED})::bigint as token_count, appended::int as appended, evicted::int as evicted from r where shown"""


@query("st8_rolling_history", ROLLING)
def _(v):
    return H.rolling_history(_history_pages(v.events, "event_id"), BUDGET, RESERVED)


@query("st8b_stream_history", ROLLING)
def _(v):
    raw = v.spark.readStream.schema(v.events.schema).parquet(f"{v.sf_dir}/events.parquet*")
    return E.run_available(H.stream_history(_history_pages(raw, "event_id"), BUDGET, RESERVED), "history")


@query("st7_incremental_publish", """with p as (select distinct user_id as page from events), f as (select distinct user_id as page from events where event_type='purchase'),
t as (select page, case when page%5=0 then 'x'||page when page%3=0 then 'h'||page when page%7=0 then 'old'||page end as there, case when page%7=0 then 'old'||page end as recorded, page in (select page from f) as done from p)
select 'f'||page||'.png' as output_name, case when done and (there is null or there='h'||page or there is not distinct from recorded) then 'h'||page else there end as sha256, done and there is not null and there<>'h'||page and there is distinct from recorded as conflict
from t where done or there is not null""")
def _(v):
    """Some outputs lie at the destination already: foreign ones, equal ones and ones the manifest knows."""
    from pagetext.sources.sinks import scratch_dir

    base, page = scratch_dir(v.spark, "publish"), c("page")
    target, manifest = E.page_log(v.spark, base), E.manifest_log(v.spark, base + "/manifest")
    names = v.events.select(c("user_id").alias("page")).distinct().select("page", F.concat(F.lit("f"), "page", F.lit(".png")).alias("output_name"))
    text = lambda word: F.concat(F.lit(word), page.cast("string"))
    there = names.withColumn("sha256", F.when(page % 5 == 0, text("x")).when(page % 3 == 0, text("h")).when(page % 7 == 0, text("old"))).filter("sha256 is not null")
    target.write(there.withColumn("batch", F.lit(-1)), -1)
    manifest.write(names.withColumn("output_sha256", F.when(page % 7 == 0, text("old"))), -1)
    done = _event_stream(v).filter("event = 'stage_finished'").dropDuplicates(["page"]).select("page", "batch", text("h").alias("sha256"))
    E.publish_stream(done, manifest, target, base + "/_conflicts", base + "/state")
    clash = v.spark.read.parquet(base + "/_conflicts").select("output_name", F.lit(True).alias("conflict")).distinct()
    return target.read().join(clash, "output_name", "left").select("output_name", "sha256", F.coalesce("conflict", F.lit(False)).alias("conflict"))
