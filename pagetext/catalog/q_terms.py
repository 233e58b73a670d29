"""Queries over terminology."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.registry import query
from pagetext.functions import text as T
from pagetext.operators import ledger as L
from pagetext.operators import terms as M
from pagetext.operators.prefix import prefix_scan

c = F.col
FOLD = "replace(lower({0}),'ß','ss')"
J5 = f"select distinct page, entry_idx from dialogue d join glossary g on contains({FOLD.format('d.source')}, {FOLD.format('g.source')})"
NAME = r"[A-Z][a-z]{1,7}"


def _texts(v):
    return v.dialogue.select("page", "source_id", c("source").alias("text"))


def _large(v):
    """Thousands of terms taken from the benchmark passages."""
    words = v.benchmark.select(F.explode(F.split("text", " ")).alias("w")).select(F.regexp_replace("w", "[.]", "").alias("source")).distinct().filter(F.length("source").between(1, 12))
    return prefix_scan(words.withColumn("k", F.lit(0)), ["k"], [c("source")], number="entry_idx").drop("k")


query("j5_match_glossary", J5)(lambda v: M.match_glossary(_texts(v), v.glossary))
query("j5b_match_glossary_large", r"""with t as (select distinct regexp_replace(w, '[.]', '') as source from (select unnest(string_split(text, ' ')) as w from benchmark) x), g as (select source, hash_id::int as entry_idx from
 (select source, row_number() over (order by source) as hash_id from t where length(source) between 1 and 12) y)
select distinct doc_id, entry_idx from documents d join g on contains(replace(lower(d.text),'ß','ss'), replace(lower(g.source),'ß','ss'))""")(
    lambda v: M.match_glossary(v.documents.select("doc_id", "text"), _large(v), ["doc_id"]))
query("j5c_match_glossary_joined", f"""with t as (select page, string_agg(source, '' order by source_id) as text from dialogue group by page)
select distinct page, entry_idx from t join glossary g on contains(t.text, g.source)""")(lambda v: M.match_glossary(_texts(v), v.glossary, fold=False, joiner="", order="source_id"))

OCC = f"""occ as (select distinct g.source as entity, page, source_id, d.translation, true as from_glossary from dialogue d join glossary g on contains(d.source, g.source)
 union all select * from (select unnest(regexp_extract_all(source,'{NAME}')) as entity, page, source_id, translation, false from dialogue) t where length(entity) between 2 and 8 and entity not in ('Der','Die'))"""


def _occ(v):
    return M.term_occurrences(v.dialogue, v.glossary, NAME, ["Der", "Die"])


query("a1_audit_terms", f"""with {OCC}, tg as (select source, arg_max(translation, entry_idx) as target from glossary group by source)
select entity, count(*)::bigint as occurrences, count(distinct page) as pages, any_value(target) as target, any_value(target) is not null as in_glossary from occ left join tg on tg.source=entity group by entity""")(
    lambda v: M.audit_terms(_occ(v), v.glossary))
query("a1b_entity_pages", f"with {OCC} select distinct entity, page from occ")(lambda v: M.entity_pages(_occ(v)))
query("a1c_audit_totals", f"with {OCC} select (select count(distinct entity) from occ) as entities, (select count(distinct source) from glossary) as glossary_terms")(
    lambda v: M.audit_totals(_occ(v), v.glossary))
query("w13_entity_samples", f"""with {OCC} select entity, page, source_id, from_glossary, cast(rn as int) as rn from (select *, row_number() over (partition by entity order by page, source_id, from_glossary desc) as rn from occ) t where rn<=5""")(
    lambda v: M.entity_samples(_occ(v)).select("entity", "page", "source_id", "from_glossary", "rn"))


@query("a2_vote_terms", rf"""with p as (select unnest(regexp_extract_all(source,'{NAME}')) as entity, regexp_extract(translation,'{NAME}') as candidate from dialogue),
n as (select entity, candidate, count(*) as n from p where candidate<>'' group by entity, candidate)
select entity, arg_min(candidate, (-n, candidate)) as winner, sum(n)::bigint as votes, count(*) as candidates, count(*)>1 as conflict from n group by entity""")
def _(v):
    p = v.dialogue.select(F.explode(T.entities(c("source"), NAME)).alias("entity"), F.regexp_extract("translation", NAME, 0).alias("candidate"))
    return M.vote_terms(p.filter("candidate <> ''"))


query("f12_entities", f"select page, source_id, unnest(regexp_extract_all(source,'{NAME}')) as entity from dialogue")(
    lambda v: v.dialogue.select("page", "source_id", F.explode(T.entities(c("source"), NAME)).alias("entity")))
query("f15_render_glossary", f"""with m as ({J5}) select page, '{{"glossary":['||string_agg('{{"source":"'||source||'","translation":"'||translation||'","note":"'||note||'"}}', ',' order by entry_idx)||']}}' as rendered
from m join glossary using (entry_idx) group by page""")(lambda v: M.render_glossary(M.match_glossary(_texts(v), v.glossary), v.glossary))
query("f15b_render_glossary_lines", f"with m as ({J5}) select page, string_agg(source||'->'||translation, chr(10) order by entry_idx) as rendered from m join glossary using (entry_idx) group by page")(
    lambda v: M.render_glossary(M.match_glossary(_texts(v), v.glossary), v.glossary, form="lines"))

DUP = f"""g as (select doc_id::int as entry_idx, case when doc_id%3=0 then upper(source) else source end as source, case when doc_id%50=49 then 'other' else source end as translation, lang as note from documents),
f as (select *, {FOLD.format('source')} as fold from g), k as (select *, first_value(entry_idx) over w as first_idx, first_value(translation) over w as first_translation from f window w as (partition by fold order by entry_idx))"""


def _dup(v):
    return M.dedupe_glossary(v.documents.select(c("doc_id").cast("int").alias("entry_idx"), F.when(c("doc_id") % 3 == 0, F.upper("source")).otherwise(c("source")).alias("source"),
                                                F.when(c("doc_id") % 50 == 49, "other").otherwise(c("source")).alias("translation"), c("lang").alias("note")))


query("w9_dedupe_glossary", f"with {DUP} select source, translation, note, min(entry_idx) as entry_idx from k where translation=first_translation group by source, translation, note")(lambda v: _dup(v)[0])
query("w9b_glossary_conflicts", f"with {DUP} select entry_idx, source, translation, first_idx, first_translation from k where translation<>first_translation")(lambda v: _dup(v)[1])

TERMS = [("die", "DIE"), ("DIE ", "das "), ("qu", "k")]
F21 = "replace(replace(replace(translation,'die','DIE'),'DIE ','das '),'qu','k')"
query("f21_apply_terms", f"select page, source_id, {F21} as translation, {F21} is distinct from translation as changed from dialogue")(
    lambda v: M.apply_terms(v.dialogue, TERMS).select("page", "source_id", "translation", "changed"))
query("f21b_change_summary", f"select page, count(*) as changed_rows from dialogue where {F21}<>translation group by page")(lambda v: M.change_summary(M.apply_terms(v.dialogue, TERMS)))

query("f16_search", """select doc_id, 'text' as field, len(regexp_extract_all(text,'(?i)and'))::int as hits from documents where regexp_matches(text,'(?i)and')
union all select doc_id, 'source', len(regexp_extract_all(source,'(?i)and'))::int from documents where regexp_matches(source,'(?i)and')""")(
    lambda v: M.search(v.documents, T.search_pattern("and"), ["text", "source"], ["doc_id"]))
query("f16b_search_spans", """with p as (select doc_id, string_split(text,'tion') as l from documents), e as (select doc_id, unnest(range(1,len(l))) as i, l from p)
select doc_id, (i-1)::int as n, (list_sum(list_transform(l[1:i], lambda x: length(x)))+4*(i-1))::int as start, 4 as length from e""")(
    lambda v: M.search_spans(v.documents, T.search_pattern("tion", case=True), "text", ["doc_id"]))
query("f16c_replace_all", "select doc_id, text as before, replace(text,'tion','$1') as after from documents where contains(text,'tion')")(
    lambda v: M.replace_all(v.documents, T.search_pattern("tion", case=True), "$1", "text", ["doc_id"]))
query("f16d_search_whole_word", r"""select doc_id, 'text' as field, len(list_filter(regexp_extract_all(text,'[\p{L}\p{N}_]+'), lambda x: lower(x)='die'))::int as hits from documents
where len(list_filter(regexp_extract_all(text,'[\p{L}\p{N}_]+'), lambda x: lower(x)='die'))>0""")(lambda v: M.search(v.documents, T.search_pattern("die", whole_word=True), ["text"], ["doc_id"]))
query("a10_search_counts", """with h as (select page, len(regexp_extract_all(source,'(?i)ch')) as hits from dialogue where regexp_matches(source,'(?i)ch'))
select page, sum(hits)::bigint as hits from h group by rollup(page)""")(lambda v: L.search_counts(M.search(v.dialogue, T.search_pattern("ch"), ["source"], ["page"])))


@query("c3_audit_volume", f"""with {OCC}, tg as (select source, arg_max(translation, entry_idx) as target from glossary group by source),
p as (select unnest(regexp_extract_all(source,'{NAME}')) as entity, regexp_extract(translation,'{NAME}') as candidate from dialogue),
n as (select entity, candidate, count(*) as n from p where candidate<>'' group by entity, candidate), vt as (select entity, arg_min(candidate, (-n, candidate)) as winner, count(*)>1 as conflict from n group by entity),
a as (select entity, count(*)::bigint as occurrences, count(distinct page) as pages, any_value(target) as target from occ left join tg on tg.source=entity group by entity)
select a.entity, occurrences, pages, target, winner, conflict, coalesce(target, winner) as standard from a left join vt on vt.entity=a.entity""")
def _(v):
    from pagetext.plans.volumes import audit_volume

    p = v.dialogue.select(F.explode(T.entities(c("source"), NAME)).alias("entity"), F.regexp_extract("translation", NAME, 0).alias("candidate"))
    return audit_volume(v.dialogue, v.glossary, p.filter("candidate <> ''"), NAME, ["Der", "Die"])
