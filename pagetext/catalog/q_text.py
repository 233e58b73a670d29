"""Queries over texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.registry import query
from pagetext.functions import text as T
from pagetext.operators import quality as Q
from pagetext.operators import terms as M

c = F.col
RULES = [{"keyword": "the", "sub": "THE", "use_reg": False, "case_sens": True}, {"keyword": "", "sub": "x", "use_reg": False, "case_sens": True},
         {"keyword": r"(\d+)-(\d+)", "sub": r"\2-\1", "use_reg": True, "case_sens": True}, {"keyword": "(", "sub": "x", "use_reg": True, "case_sens": True},
         {"keyword": "die", "sub": "d$", "use_reg": False, "case_sens": False}]
RULES_SQL = r"regexp_replace(regexp_replace(replace({0},'the','THE'),'(\d+)-(\d+)','\2-\1','g'),'die','d$','gi')"
STRIP = r"regexp_replace({0},'^\s+|\s+$','','g')"
CAPS = r"""array_to_string(list_transform(regexp_extract_all(lower({0}),'[^.!?。！？]*[.!?。！？]|[^.!?。！？]+'), lambda p:
 left(p,length(regexp_extract(p,'^[^\p{{L}}]*')))||case when substr(p,length(regexp_extract(p,'^[^\p{{L}}]*'))+1,1)='ß' then 'SS'
 else upper(substr(p,length(regexp_extract(p,'^[^\p{{L}}]*'))+1,1)) end||substr(p,length(regexp_extract(p,'^[^\p{{L}}]*'))+2)),'')"""


@query("p1_block_text", r"""with p as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: x<>'') as l from documents)
select doc_id, regexp_replace(array_to_string(list_transform(range(1,len(l)+1), lambda i: case when i>1 and regexp_matches(right(l[i-1],1),'\p{L}') and regexp_matches(left(l[i],1),'\p{L}')
 then ' ' else '' end||l[i]),''),'^\s+|\s+$','','g') as text from p""")
def _(v):
    return v.documents.select("doc_id", T.block_text(F.split("text", "\n")).alias("text"))


@query("p6_is_empty_text", r"""select doc_id, len(list_filter(string_split(text, chr(10)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')<>''))=0 as all_empty,
 trim(left(text,doc_id%3))='' as head_empty from documents""")
def _(v):
    return v.documents.select("doc_id", T.is_empty_list(F.split("text", "\n")).alias("all_empty"),
                              T.is_empty_text(F.left("text", (c("doc_id") % 3).cast("int"))).alias("head_empty"))


@query("p11_validate_blocks", """with b as (select page, case when block_id=7 then 6 else block_id end as block_id, x1, y1, case when font_size=9 then x1 else x2 end as x2, y2,
  case when label='N' and block_id%3=0 then '  ' else label end as text from blocks), s as (select *, count(*) over (partition by page) as n, count(*) over (partition by page, block_id) as k from b)
select page, block_id, x1, y1, array_to_string(list_filter([case when k>1 then 'duplicate_id' end, case when trim(text)='' then 'empty_text' end, case when x2<=x1 or y2<=y1 then 'bad_box' end,
 case when n>10 then 'page_too_large' end], lambda x: x is not null), ',') as reasons from s where k>1 or trim(text)='' or x2<=x1 or y2<=y1 or n>10""")
def _(v):
    d = v.blocks.select("page", F.when(c("block_id") == 7, 6).otherwise(c("block_id")).alias("block_id"), "x1", "y1", F.when(c("font_size") == 9, c("x1")).otherwise(c("x2")).alias("x2"), "y2",
                        F.when((c("label") == "N") & (c("block_id") % 3 == 0), "  ").otherwise(c("label")).alias("text"))
    return Q.validate_blocks(d, max_blocks=10)[1].select("page", "block_id", "x1", "y1", F.array_join("reasons", ",").alias("reasons"))


@query("p13_letters_and_direction", r"""with d as (select page, list(struct_pack(t:=label||block_id, w:=x2-x1, h:=y2-y1)) as l from blocks group by page),
k as (select page, list_distinct(list_transform(l, lambda p: case when p.h>=p.w*1.6 then 'v' when p.w>=p.h*1.6 then 'h' else '?' end)) as k, list_sum(list_transform(l, lambda p: length(p.t))) as letters from d)
select page, letters::bigint as letters, case when len(k)=1 and k[1]<>'?' then k[1]='v' end as vertical from k""")
def _(v):
    d = v.blocks.groupBy("page").agg(F.collect_list(F.struct(F.concat("label", c("block_id").cast("string")).alias("t"), F.struct("x1", "y1", "x2", "y2").alias("l"))).alias("z"))
    t, l = F.transform("z", lambda p: p["t"]), F.transform("z", lambda p: p["l"])
    letters = F.aggregate(t, F.lit(0).cast("long"), lambda a, x: a + T.letter_count(x))
    return d.select("page", letters.alias("letters"), Q.own_direction(t, l).alias("vertical"))


@query("p14_split_empty_blocks", r"""select doc_id, p as piece, 'kept' as side from (select doc_id, unnest(string_split(text, chr(10))) as p from documents) where regexp_replace(p,'^\s+|\s+$','','g')<>''
union all select doc_id, p, 'removed' from (select doc_id, unnest(string_split(text, chr(10))) as p from documents) where regexp_replace(p,'^\s+|\s+$','','g')=''""")
def _(v):
    d = v.documents.select("doc_id", F.explode(F.split("text", "\n")).alias("piece"))
    kept, removed = Q.split_empty_blocks(d, "piece")
    return kept.withColumn("side", F.lit("kept")).unionByName(removed.withColumn("side", F.lit("removed")))


query("f1_substitute", f"select doc_id, {RULES_SQL.format('text')} as text from documents")(lambda v: v.documents.select("doc_id", T.substitute(c("text"), RULES).alias("text")))
query("f2_letter_case", f"select doc_id, {CAPS.format('text')} as capitalised from documents")(
    lambda v: v.documents.select("doc_id", T.letter_case(c("text"), "capitalize").alias("capitalised")))
query("f3_width_folding", """select doc_id, array_to_string(list_transform(string_split(text,''), lambda x: case when x=' ' then chr(12288) when x between '!' and '~' and unicode(x) between 33 and 126
 then chr(unicode(x)+65248) else x end),'') as full_width, text as back from documents""")(
    lambda v: v.documents.select("doc_id", T.to_full_width(c("text")).alias("full_width"), T.to_half_width(T.to_full_width(c("text"))).alias("back")))
query("f4_finalise", "select doc_id, " + CAPS.format(RULES_SQL.format("text")) + r""" as latin, regexp_replace(text,'([?.!"])\s+','\1','g') as cjk from documents""")(
    lambda v: v.documents.select("doc_id", T.finalise(c("text"), "日本語", "English", RULES, "capitalize").alias("latin"), T.finalise(c("text"), "English", "日本語").alias("cjk")))
query("f5_characters", "select doc_id, length(replace(text,chr(10),'')) as n_chars, array_to_string(string_split(replace(text,chr(10),''),''),'|') as joined from documents")(
    lambda v: v.documents.select("doc_id", F.size(T.segment(c("text"), "日本語")).cast("long").alias("n_chars"), F.array_join(T.segment(c("text"), "日本語"), "|").alias("joined")))
query("f5b_words")(lambda v: v.documents.select("doc_id", F.array_join(T.segment(c("text"), "English"), "|").alias("words")))
query("f6_vertical_punctuation", r"""select doc_id, translate(regexp_replace(regexp_replace(text,'\.{2,}','……','g'),'-{2,}','——','g'),'()[]{}','︵︶﹇﹈︷︸') as text from documents""")(
    lambda v: v.documents.select("doc_id", T.normalise_punctuation(c("text")).alias("text")))
query("f7_enlarge_kana", "select doc_id, text from documents")(lambda v: v.documents.select("doc_id", T.enlarge_kana(c("text")).alias("text")))
query("f8_query_cleanup", r"""select doc_id, '「'||text||'」' as wrapped, regexp_replace(text,'^[「」]+|[「」]+$','','g') as bare, len(list_filter(string_split(text,chr(10)), lambda x: regexp_replace(x,'^\s+|\s+$','','g')<>''))::int as lines
 from documents""")(lambda v: v.documents.select("doc_id", T.clean_query(c("text")).alias("wrapped"), T.unquote(T.clean_query(c("text"))).alias("bare"), F.size(T.reply_lines(c("text"))).alias("lines")))


@query("f9_find_repeats")
def _(v):
    return v.documents.select("doc_id", T.find_repeats(c("text")).alias("r")).select("doc_id", "r.repeated", "r.pattern", "r.count", F.sha2("r.cleaned", 256).alias("cleaned_sha256"), "r.effective_threshold")


query("f10_repeated_suffix", """select doc_id, exists(select 1 from range(1,33) t(k) where length(x)>=k*31 and suffix(x, repeat(right(x,k::int),31))) as looping
from (select doc_id, text||case when doc_id%5=0 then repeat(right(text,(doc_id%40)::int+1),31) else '' end as x from documents) s""")(
    lambda v: v.documents.select("doc_id", F.concat("text", F.when(c("doc_id") % 5 == 0, F.repeat(F.right("text", (c("doc_id") % 40).cast("int") + 1), F.lit(31))).otherwise("")).alias("x"))
    .select("doc_id", T.repeated_suffix(c("x")).alias("looping")))
query("f11_token_estimate", r"""select conv_id, turn, cast(4 + length(regexp_replace(text,'[\x00-\x7F]+','','g')) + coalesce(list_sum(list_transform(regexp_extract_all(text,'[\x00-\x7F]+'), lambda r: (length(r)+3)//4)),0) as int) as tokens
 from conversations""")(lambda v: v.conversations.select("conv_id", "turn", (T.token_estimate(c("text")) + 4).alias("tokens")))


@query("f17_scan_secrets", r"""select doc_id, 'GitHub token' as reason from documents where regexp_matches(text,'(?:gh[pousr]_[A-Za-z0-9]{30,}|github_pat_[A-Za-z0-9_]{30,})')
union all select doc_id, 'OpenAI-like secret' from documents where regexp_matches(text,'sk-(?:proj-|svcacct-)?[A-Za-z0-9_-]{32,}')
union all select doc_id, 'Hugging Face token' from documents where regexp_matches(text,'hf_[A-Za-z0-9]{30,}')
union all select doc_id, 'private key' from documents where regexp_matches(text,'-----BEGIN (?:RSA |EC |OPENSSH )?PRIVATE KEY-----')
union all select doc_id, 'hex token' from documents where regexp_matches(text,'token = "[0-9a-f]{40}"')
union all select doc_id, 'unexpected large release file' from documents where strlen(text) > 20971520
union all select doc_id, 'runtime/model/private file class' from documents where doc_id%20=0""")
def _(v):
    d = v.documents.withColumn("path", F.concat(F.lit("data/"), F.when(c("doc_id") % 40 == 0, "venv/x.txt").when(c("doc_id") % 20 == 0, "x.LOG").otherwise("x.txt")))
    return Q.scan_secrets(d, "doc_id", path="path", extra={"hex token": r'token = "[0-9a-f]{40}"'})


query("f18_word_spans", r"""with t as (select doc_id, chr(131072)||replace(text, '.', chr(131073)||'字') || '漢helo' as x from documents),
p as (select doc_id, unnest(regexp_extract_all(x,'[\p{Latin}]{2,}|[^\p{Latin}]+|[\p{Latin}]')) as piece, unnest(range(len(regexp_extract_all(x,'[\p{Latin}]{2,}|[^\p{Latin}]+|[\p{Latin}]')))) as i from t),
l as (select *, length(piece) + length(regexp_replace(piece,'[^\x{10000}-\x{10FFFF}]','','g')) as u from p),
s as (select *, sum(u) over (partition by doc_id order by i rows unbounded preceding) - u as start from l)
select doc_id, start::int as start, u::int as length, piece as word from s where regexp_matches(piece, '^[\p{Latin}]{2,}$')""")(
    lambda v: M.word_spans(v.documents.withColumn("text", F.concat(F.lit("\U00020000"), F.replace("text", F.lit("."), F.lit("\U00020001字")), F.lit("漢helo"))), "text", ["doc_id"]).drop("n"))
query("f19_safe_name", r"""select page_id, url, n not in ('','.','..') and not regexp_matches(n,'[/\\:]') as leaf, starts_with(url,'http://') and not regexp_matches(url,'(^|/)\.\.(/|$)') as inside
from (select page_id, url, case when page_id%2=0 then url else list_extract(string_split(url,'/'),-1) end as n from pages) t""")(
    lambda v: v.pages.select("page_id", "url", T.safe_name(F.when(c("page_id") % 2 == 0, c("url")).otherwise(F.element_at(F.split("url", "/"), -1))).alias("leaf"), T.inside_root(c("url"), "http:/").alias("inside")))
query("f20_durations", """select event_id, lpad((s//3600)::varchar,greatest(2,length((s//3600)::varchar))::int,'0')||':'||lpad((s%3600//60)::varchar,2,'0')||':'||lpad((s%60)::varchar,2,'0') as duration,
 case when event_id%3=0 then 'none' when event_id%3=1 then 'naive' else strftime(date_trunc('second',ts),'%Y-%m-%d %H:%M:%S') end as stamp from (select *, cast(trunc(value*3600) as bigint) as s from events) t""")(
    lambda v: v.events.select("event_id", T.duration_text(c("value") * 3600).alias("duration"), T.stamp_state(
        F.when(c("event_id") % 3 == 0, "soon").when(c("event_id") % 3 == 1, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss")).otherwise(F.concat(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))).alias("stamp")))
query("f22_colour_distance", """select page, block_id, round(sqrt(power((x1-x2)*0.392::double,2)+power(y1-y2,2)+power(font_size-block_id,2)),6) as distance from blocks""")(
    lambda v: v.blocks.select("page", "block_id", F.round(T.colour_distance([c("x1"), c("y1"), c("font_size")], [c("x2"), c("y2"), c("block_id")]), 6).alias("distance")))
query("f23_clusters", r"select doc_id, length(text)::int as clusters from documents")(
    lambda v: v.documents.select("doc_id", F.size(T.clusters(c("text"))).alias("clusters")))


@query("f24_infer_stage", """select event_id, case when event_id%3=0 then 'prepare' when event_type='error' then 'publish' when event_type='purchase' then 'render' when event_type='view' then 'prepare' when event_type='signup' then 'translate' else 'unknown' end as stage,
 case when event_id%3=0 then 'context' when event_type='error' then 'token:file-map.json' when event_type='purchase' then 'token:render.log' when event_type='view' then 'token:magi-run'
  when event_type='signup' then 'token:translation.log' else 'none' end as evidence from events""")
def _(v):
    path = F.when(c("event_type") == "error", "w/File-Map.json").when(c("event_type") == "purchase", "w/render.log").when(c("event_type") == "view", "w/magi-run/x").when(
        c("event_type") == "signup", "w/translation.log").otherwise("w/x")
    stage, proof = T.infer_stage(F.when(c("event_id") % 3 == 0, "ocr").otherwise("other"), path, c("props"))
    return v.events.select("event_id", stage.alias("stage"), proof.alias("evidence"))


@query("j19_misspelled", r"""with w as (select distinct unnest(regexp_extract_all(text,'\p{L}{2,}')) as word from documents), d as (select distinct lower(unnest(regexp_extract_all(text,'\p{L}{2,}'))) as word from benchmark)
select word from w where lower(word) not in (select word from d)""")
def _(v):
    words = lambda d: d.select(F.explode(F.regexp_extract_all("text", F.lit(T.WORD_SCRIPTS + "{2,}"), F.lit(0))).alias("word")).distinct()
    return Q.misspelled(words(v.documents), words(v.benchmark)).select("word")


@query("o4_suggestions", r"""with w as (select distinct lower(unnest(regexp_extract_all(text,'\p{L}{2,}'))) as word from conversations),
d as (select word as entry, count(*) as rank from (select lower(unnest(regexp_extract_all(text,'\p{L}{2,}'))) as word from benchmark) t group by word),
x as (select word, translate(word,'ßäçèéêíñóöü','ABCDEFGHIJK') as a from w where length(word)<=15), y as (select entry, rank, translate(entry,'ßäçèéêíñóöü','ABCDEFGHIJK') as b from d),
q as (select word, entry, rank, levenshtein(a,b) as distance from x join y on abs(length(a)-length(b))<=2 and levenshtein(a,b)<=2 and word<>entry)
select word, entry, distance::int as distance, rn::int as rn from (select *, row_number() over (partition by word order by distance, rank, entry) as rn from q) t where rn<=5""")
def _(v):
    words = lambda d: d.select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit(T.WORD_SCRIPTS + "{2,}"), F.lit(0))).alias("word"))
    d = words(v.benchmark).groupBy("word").agg(F.count(F.lit(1)).alias("rank"))
    return Q.suggestions(words(v.conversations), d).select("word", "entry", "distance", "rn")
