"""Queries over layout and direction."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.registry import query
from pagetext.operators import layout as Y

c = F.col


@query("p10_scale_metrics", """with b as (select page, block_id, font_size*1.0::double as f, block_id%3 as n_lines, vertical, case when page%5=0 then 0 else page_w+page%900 end as page_w, page_h from blocks join pages_v using (page)),
s as (select *, case when least(page_w,page_h)>0 then greatest(1.0::double, least(page_w,page_h)/1050.0::double) when f>42 then greatest(1.0::double, f/30) else 1.0::double end as scale from b)
select page, block_id, round(scale,6) as scale, (case when f/scale<18 then 1.08 when f/scale<30 then 1.12 else 1.16 end)::double as char_ratio,
 (case when f/scale<18 then 1.0 when f/scale<30 then 1.03 else 1.05 end)::double as letter_spacing, (case when n_lines>1 and vertical then 1.22 when n_lines>1 then 1.2 else 1.0 end)::double as line_spacing from s""")
def _(v):
    d = v.blocks.join(v.pages_v, "page").withColumns({"n_lines": c("block_id") % 3, "page_w": F.when(c("page") % 5 == 0, 0).otherwise(c("page_w") + c("page") % 900)})
    return Y.scale_metrics(d).select("page", "block_id", F.round("scale", 6).alias("scale"), "char_ratio", "letter_spacing", "line_spacing")


@query("o3_fit_layout", """with b as (select page, block_id, (x2-x1)::double as w, (y2-y1)::double as h, font_size::double as f, font_size-7 as n from blocks where least(x2-x1,y2-y1)>=6),
k as (select *, case when least(w,h)>=150 then 34 when least(w,h)>=100 then 30 else 26 end::double as top from b), m as (select *, least(greatest(f*1.05::double,16.0::double),top) as cap from k),
o as (select *, unnest(range(1,n+1)) as k from m),
v as (select *, ceil(n/k::double) as per, w/(case when k=1 then 1.18::double else k*1.22::double+0.22::double end) as byw from o),
v2 as (select *, least(cap,byw,h/(per*1.13::double+0.25::double)) as probe from v), v3 as (select *, case when probe<18 then 1.08 when probe<30 then 1.12 else 1.16 end::double as ratio from v2 where probe>=1),
v4 as (select *, greatest(1.0::double,floor(least(cap,byw,h/(per*ratio+0.25::double))*4)/4) as size from v3),
v5 as (select *, size*case when h/greatest(1.0::double,w)>=1.4 then case when least(1.0::double,per*size*ratio/h)<0.55 then power(least(1.0::double,per*size*ratio/h)/0.55::double,0.85::double) else 1.0::double end
  when k>1 and n%k=1 and per>2 then 0.95::double else 1.0::double end as score from v4),
vb as (select * from (select *, row_number() over (partition by page, block_id order by score desc, size desc, k, per desc, ratio desc) rn from v5) t where rn=1),
r as (select *, ceil(n/k::double) as per, case when k=1 then 1.08 else 1.2 end::double as ratio from o), r2 as (select *, least(cap,w/(per*1.08::double+0.25::double),h/(k*ratio+0.25::double)) as probe from r),
r3 as (select *, greatest(1.0::double,floor(probe*4)/4) as size from r2 where probe>=1), r4 as (select *, size*case when k>1 and n%per=1 and per>2 then 0.95::double else 1.0::double end as score from r3),
rb as (select * from (select *, row_number() over (partition by page, block_id order by score desc, size desc, k, per desc, ratio desc) rn from r4) t where rn=1),
j as (select b.page, b.block_id, b.w, b.h, b.n, vb.k as vk, vb.per as vper, vb.size as vsize, vb.ratio as vratio, rb.k as rk, rb.per as rper, rb.size as rsize, rb.ratio as rratio,
  case when vb.k is null and rb.k is null then null when vb.k is null then false when rb.k is null then true else not (b.w/greatest(1.0::double,b.h)>=1.3 or (vb.size<12 and rb.size>=vb.size*1.2)) end as fit_vertical
  from b left join vb using (page, block_id) left join rb using (page, block_id)),
z as (select *, case when fit_vertical then vsize else rsize end as fit_size, case when fit_vertical then vk else rk end::int as parts, case when fit_vertical then vper else rper end::int as per_part,
  case when fit_vertical then vper*vsize*vratio else rk*rsize*rratio end as text_h from j)
select b.page, b.block_id, fit_vertical, fit_size, parts, per_part, round(case when text_h is not null then y1 + greatest(0, (h-text_h)/2) end, 6) as fit_y1, round(case when text_h is not null then h - greatest(0, (h-text_h)/2) end, 6) as fit_height, fit_size < 11 as small_text,
 array_to_string(list_transform(range(0, n, per_part), lambda i: substr(repeat('abcdefg', 7), i + 1, least(per_part, n - i))), chr(10)) as laid_out from blocks b left join z using (page, block_id)""")
def _(v):
    text = F.left(F.lit("abcdefg" * 7), c("font_size") - 7)
    d = v.blocks.withColumns({"text": text, "page_w": F.lit(1050), "page_h": F.lit(1500)})
    fit = Y.fit_layout(d)
    return fit.select("page", "block_id", "fit_vertical", "fit_size", "parts", "per_part", F.round("fit_y1", 6).alias("fit_y1"), F.round("fit_height", 6).alias("fit_height"), "small_text", "laid_out")


DIRECTION = """b as (select page, block_id, block_id%3 as grp, x1,y1,x2,y2, font_size, vertical, case when font_size%4=0 then 1 else 5 end as letters, font_size%13<>0 as geometry_ok,
  case when font_size%4<>0 and font_size%13<>0 then case when y2-y1>=(x2-x1)*1.6 then true when x2-x1>=(y2-y1)*1.6 then false end end as known from blocks),
gs as (select page, grp, count(*) filter (known) as v, count(*) filter (not known) as h from b where known is not null group by page, grp),
q as (select b.*, coalesce(v,0) as v, coalesce(h,0) as h, geometry_ok and known is null and letters=1 as single from b left join gs using (page, grp)),
e as (select q.page, q.block_id, p.block_id as evidence_id from q join b p on p.page=q.page and p.grp=q.grp and p.known is not null where single and (v>0)<>(h>0)
  and case when v>0 then abs(q.y1-p.y1)<=greatest(q.x2-q.x1,q.y2-q.y1,q.font_size,p.font_size) and abs((q.x1+q.x2-p.x1-p.x2)/2.0)<=3*greatest(q.x2-q.x1,q.y2-q.y1,q.font_size,p.font_size)
   else abs(q.x1-p.x1)<=greatest(q.x2-q.x1,q.y2-q.y1,q.font_size,p.font_size) and abs((q.y1+q.y2-p.y1-p.y2)/2.0)<=3*greatest(q.x2-q.x1,q.y2-q.y1,q.font_size,p.font_size) end),
ne as (select page, block_id, count(*) as n from e group by page, block_id),
r as (select q.*, coalesce(n,0) as n_evidence, case when not geometry_ok then 'invalid_or_complex_source_geometry' when known is not null then 'own_multichar_line_geometry' when single and v>0 and h>0 then 'mixed_group_requires_review'
  when n>0 then 'single_letter_inherits_supported_group_direction' else 'insufficient_direction_evidence' end as reason from q left join ne using (page, block_id)),
dc as (select *, case when reason='own_multichar_line_geometry' then known when reason like 'single%' then v>0 end as direction from r)"""


def _direction(v):
    clear, ok = c("font_size") % 4 != 0, c("font_size") % 13 != 0
    w, h = c("x2") - c("x1"), c("y2") - c("y1")
    d = v.blocks.withColumns({"grp": c("block_id") % 3, "letters": F.when(clear, 5).otherwise(1), "n_lines": F.lit(1), "geometry_ok": ok,
                              "known": F.when(clear & ok, F.when(h >= w * 1.6, True).when(w >= h * 1.6, False))})
    return Y.inherit_direction(d)


query("j21_inherit_direction", f"with {DIRECTION} select page, block_id, direction, reason, n_evidence, reason like 'single%' and direction<>vertical as change from dc")(
    lambda v: _direction(v)[0].select("page", "block_id", "direction", "reason", "n_evidence", "change"))
query("j21b_direction_evidence", f"with {DIRECTION} select * from e")(lambda v: _direction(v)[1])
query("c9_layout_groups", f"""with {DIRECTION}, x as (select *, reason like 'single%' and direction<>vertical as change, block_id%7<>0 as good from dc),
gg as (select page, grp, bool_or(change) as any_change, count(*) as n, count(direction) as k, min(direction) as lo, max(direction) as hi, bool_and((change or coalesce(direction=vertical,false)) and good) as sound from x group by page, grp)
select page, grp, block_id, case when n between 2 and 4 and k=n and lo=hi and sound then 'pending' else 'needs_review' end as group_fit from x join gg using (page, grp) where any_change""")(
    lambda v: Y.layout_groups(_direction(v)[0], v.blocks.select("page", "block_id", F.when(c("block_id") % 7 != 0, 0.7).otherwise(0.1).alias("coverage"), F.lit(0.0).alias("iou"))))
