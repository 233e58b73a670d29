"""Queries over text boxes: scalar box work, matches and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.registry import query
from pagetext.operators import boxes as B
from pagetext.operators import order as O

R6 = lambda c: F.round(c, 6)


@query("p2_box_metrics", """
select page, block_id, greatest(0,x2-x1) as w, greatest(0,y2-y1) as h, greatest(0,x2-x1)*greatest(0,y2-y1) as area,
 (x1+x2)/2.0::double as cx, (y1+y2)/2.0::double as cy, round(case when y2>y1 then (x2-x1)::double/(y2-y1) end,6) as aspect from blocks""")
def _(v):
    return B.with_box_metrics(v.blocks).select("page", "block_id", "w", "h", "area", "cx", "cy", R6("aspect").alias("aspect"))


@query("p3_filter_small_boxes", "select page, block_id, x1, y1, x2, y2 from blocks where x2-x1>25 and y2-y1>25")
def _(v):
    return B.filter_small_boxes(v.blocks, 25, 25).select("page", "block_id", "x1", "y1", "x2", "y2")


@query("p4_expand_boxes", """
with e as (select page, block_id, x1,y1,x2,y2, page_w, page_h,
  cast(round_even((greatest(x2-x1,y2-y1)*0.25::double+least(x2-x1,y2-y1)*0.75::double)/8,0) as int) as pad
  from blocks join pages_v using (page))
select page, block_id, pad, greatest(0,x1-pad) as x1, greatest(0,y1-pad) as y1, least(page_w-1,x2+pad) as x2,
  least(page_h-1,y2+pad) as y2 from e""")
def _(v):
    d = B.expand_boxes(v.blocks.join(v.pages_v, "page"))
    return d.select("page", "block_id", "pad", "x1", "y1", "x2", "y2")


@query("p4b_offset_boxes", """
select page, block_id, least(greatest(x1-40,0),page_w) as x1, least(greatest(y1-25,0),page_h) as y1,
 least(greatest(x2+40,0),page_w) as x2, least(greatest(y2+25,0),page_h) as y2 from blocks join pages_v using (page)""")
def _(v):
    return B.offset_boxes(v.blocks.join(v.pages_v, "page"), 40, 25).select("page", "block_id", "x1", "y1", "x2", "y2")


@query("p5_filter_labels", """
select page, block_id, label, font_size/50.0::double as score from blocks where label in ('A','R') and font_size/50.0::double >= 0.4""")
def _(v):
    d = v.blocks.withColumn("score", F.col("font_size") / F.lit(50.0))
    return B.filter_labels(d, ["A", "R"], 0.4).select("page", "block_id", "label", "score")


@query("p8_clip_rect", """
with r as (select page, block_id, x1,y1,x2,y2, page_w, page_h, (block_id*17+page)%90 - 45 as angle from blocks join pages_v using(page)),
s as (select *, radians(angle) as a, (x2-x1)::double as w, (y2-y1)::double as h from r),
t as (select *, (x1+x2)/2.0::double as cx, (y1+y2)/2.0::double as cy, (abs(w*cos(a))+abs(h*sin(a)))/2 as dx,
  (abs(w*sin(a))+abs(h*cos(a)))/2 as dy from s)
select page, block_id, round(greatest(0,case when angle<>0 then cx-dx else x1::double end),4) as clip_x1,
 round(greatest(0,case when angle<>0 then cy-dy else y1::double end),4) as clip_y1,
 round(least(page_w,case when angle<>0 then cx+dx else x2::double end),4) as clip_x2,
 round(least(page_h,case when angle<>0 then cy+dy else y2::double end),4) as clip_y2,
 case when w<=0 or h<=0 then 'invalid_box' when least(page_w,case when angle<>0 then cx+dx else x2 end)
   <= greatest(0,case when angle<>0 then cx-dx else x1 end) then 'outside_page' end as reason from t""")
def _(v):
    d = v.blocks.join(v.pages_v, "page").withColumn("angle", (F.col("block_id") * 17 + F.col("page")) % 90 - 45)
    return B.clip_rect(d).select("page", "block_id", *[F.round(c, 4).alias(c) for c in ("clip_x1", "clip_y1", "clip_x2", "clip_y2")], "reason")


@query("p9_clamp_font", "select page, block_id, greatest(least(font_size*1.3::double, 40), 14) as font from blocks")
def _(v):
    return v.blocks.select("page", "block_id", B.clamp_font(F.col("font_size"), 1.3, 40, 14).alias("font"))


@query("p12_flag_small_text", "select page, block_id, font_size from blocks where font_size < 12")
def _(v):
    from pagetext.operators.quality import flag_small_text

    return flag_small_text(v.blocks).select("page", "block_id", "font_size")


MATCH = """
m as (select b.page, b.block_id, c.cand_id,
   greatest(0,least(b.x2,c.x2)-greatest(b.x1,c.x1))::double*greatest(0,least(b.y2,c.y2)-greatest(b.y1,c.y1)) as inter,
   greatest(0,b.x2-b.x1)*greatest(0,b.y2-b.y1) as ba, greatest(0,c.x2-c.x1)*greatest(0,c.y2-c.y1) as ca
   from blocks b join candidates c on b.page=c.page),
n as (select page, block_id, cand_id, inter/greatest(1,ba) as cov, inter/greatest(1,ba+ca-inter) as iou from m),
best as (select * from (select *, row_number() over (partition by page, block_id
   order by 0.7::double*cov+0.3::double*iou desc, cov desc, iou desc, cand_id desc) as rn from n) t where rn=1 and (cov>=0.6 or iou>=0.3)),
matched as (select b.*, t.cand_id as match_id, coalesce(t.cov,0) as cov, coalesce(t.iou,0) as iou from blocks b
  left join best t on b.page=t.page and b.block_id=t.block_id)"""


@query("j1_match_boxes", f"with {MATCH} select page, block_id, match_id, round(cov,6) as coverage, round(iou,6) as iou from matched")
def _(v):
    return B.match_boxes(v.blocks, v.candidates).select("page", "block_id", "match_id", R6("coverage").alias("coverage"), R6("iou").alias("iou"))


ORDERED = f"""with {MATCH},
f as (select *, bool_and(match_id is not null) over (partition by page) as full_match from matched)
select page, block_id, match_id, round(cov,6) as coverage, round(iou,6) as iou,
 cast(row_number() over (partition by page order by case when full_match then match_id end, case when full_match then -x2 end,
   case when full_match then y1 end, block_id) as int) as position,
 case when full_match then 'model_order' else 'native_order' end as method from f"""


def _order(v):
    from pagetext.plans.pages import order_pages

    return order_pages(v.blocks, v.candidates)


query("w1_reading_order", ORDERED)(lambda v: O.reading_order(B.match_boxes(v.blocks, v.candidates)).select(
    "page", "block_id", "match_id", R6("coverage").alias("coverage"), R6("iou").alias("iou"), "position", "method"))
query("c1_order_pages", ORDERED)(_order)


@query("j2_assign_lines", """
with p as (select c.page, c.cand_id as line_id, b.block_id,
  greatest(0,least(b.x2,c.x2)-greatest(b.x1,c.x1))::double*greatest(0,least(b.y2,c.y2)-greatest(b.y1,c.y1))
   /((c.x2-c.x1)*(c.y2-c.y1)) as score from candidates c join blocks b on b.page=c.page where (c.x2-c.x1)*(c.y2-c.y1)>0),
best as (select * from (select *, row_number() over (partition by page,line_id order by score desc, block_id) rn from p) t
  where rn=1 and score>0.4)
select c.page, c.cand_id as line_id, best.block_id, round(best.score,6) as score from candidates c
 left join best on best.page=c.page and best.line_id=c.cand_id""")
def _(v):
    lines = v.candidates.withColumnRenamed("cand_id", "line_id")
    return B.assign_lines(lines, v.blocks).select("page", "line_id", "block_id", R6("score").alias("score"))


@query("j3_bind_bubbles", """
with p as (select b.page, b.block_id, c.cand_id,
   c.x1<=b.x1 and c.y1<=b.y1 and c.x2>=b.x2 and c.y2>=b.y2 as fits,
   greatest(0,least(b.x2,c.x2)-greatest(b.x1,c.x1))::double*greatest(0,least(b.y2,c.y2)-greatest(b.y1,c.y1)) as inter,
   (b.x2-b.x1)*(b.y2-b.y1)+(c.x2-c.x1)*(c.y2-c.y1) as total from blocks b join candidates c on b.page=c.page),
k as (select page, block_id, cand_id, case when fits then 0 when total-inter>0 and inter/(total-inter)>=0.2 then 1 end as rnk from p),
best as (select * from (select *, row_number() over (partition by page,block_id order by rnk, cand_id) rn from k where rnk is not null) t where rn=1)
select b.page, b.block_id, best.cand_id as bubble_id, case when best.cand_id is null then 'text_free' else 'text_bubble' end as text_class
from blocks b left join best on b.page=best.page and b.block_id=best.block_id""")
def _(v):
    return B.bind_bubbles(v.blocks, v.candidates.withColumnRenamed("cand_id", "bubble_id")).select("page", "block_id", "bubble_id", "text_class")


NEAREST = """
d as (select b.page, b.block_id, p.panel_id,
   greatest(0,p.x1-b.x2,b.x1-p.x2)::double as dx, greatest(0,p.y1-b.y2,b.y1-p.y2)::double as dy
   from blocks b join panels p on b.page=p.page),
near as (select * from (select page, block_id, panel_id, sqrt(dx*dx+dy*dy) as dist, row_number() over (partition by page, block_id
   order by sqrt(dx*dx+dy*dy), panel_id) rn from d) t where rn=1)"""


@query("j4_nearest_panel", f"""with {NEAREST} select b.page, b.block_id, near.panel_id, round(near.dist,6) as distance
from blocks b left join near on near.page=b.page and near.block_id=b.block_id""")
def _(v):
    return B.nearest_panel(v.blocks, v.panels).select("page", "block_id", "panel_id", R6("distance").alias("distance"))


@query("w4_panel_text_order", f"""with {NEAREST} select b.page, b.block_id, coalesce(near.panel_id,0) as panel_id,
cast(row_number() over (partition by b.page order by coalesce(near.panel_id,0), b.x1-b.y1 desc, b.block_id) as int) as position
from blocks b left join near on near.page=b.page and near.block_id=b.block_id""")
def _(v):
    return O.panel_text_order(v.blocks, v.panels).select("page", "block_id", "panel_id", "position")


@query("w3_panel_order", """
with b as (select page, block_id as panel_id, x1, y1, x2, y2 from blocks),
a as (select *, max(y2) over (partition by page order by y1, panel_id rows between unbounded preceding and 1 preceding) as top from b),
r as (select *, sum(case when top is null or y1>top then 1 else 0 end) over (partition by page order by y1, panel_id rows unbounded preceding) as row_no from a)
select page, panel_id, cast(row_no as int) as row_no, cast(row_number() over (partition by page order by row_no, x1-y1 desc, panel_id) as int) as position from r""")
def _(v):
    d = v.blocks.select("page", F.col("block_id").alias("panel_id"), "x1", "y1", "x2", "y2")
    return O.panel_order(d).select("page", "panel_id", "row_no", "position")


# Page by page, one region a step: the placed list and the index before which (or after whose entry) the next region goes.
SORTED = """with recursive s as (select page, block_id, (x1+x2)/2.0::double as cx, (y1+y2)/2.0::double as cy, y1, y2, bool_or(vertical) over (partition by page) as rtl from blocks),
o as (select *, row_number() over (partition by page order by cy, block_id) as rn, count(*) over (partition by page) as n from s),
r as (select page, 1::bigint as rn, n, [{'id': block_id, 'cx': cx, 'y1': y1, 'y2': y2}] as placed from o where rn = 1
 union all select page, rn, n, case when slot is null then list_append(placed, x) else list_concat(list_append(placed[:slot - 1], x), placed[slot:]) end
  from (select z.*, z.hit + (z.hit is not null and z.cy < placed[z.hit].y1)::int as slot from (
   select o.page, o.rn, o.n, r.placed, o.cy, {'id': o.block_id, 'cx': o.cx, 'y1': o.y1, 'y2': o.y2} as x,
    list_min(list_filter(range(1, len(r.placed) + 1), lambda i: o.cy <= r.placed[i].y2 and (o.cy < r.placed[i].y1 or case when o.rtl then o.cx > r.placed[i].cx else o.cx < r.placed[i].cx end))) as hit
   from r join o on o.page = r.page and o.rn = r.rn + 1) z))
select page, unnest(placed).id as block_id, unnest(range(1, len(placed) + 1))::int as position from r where rn = n"""


@query("w2_sort_regions", SORTED)
def _(v):
    return O.sort_regions(v.blocks)


@query("w14_split_blocks", """
with recursive l as (select page, block_id as line_id, x1,y1,x2,y2, font_size, vertical, sqrt((x1*x1+y1*y1)::double) as distance from blocks),
o as (select *, row_number() over (partition by page order by distance, line_id) as rn from l),
q as (select o.*, p.rn is null as first, coalesce(o.x1>p.x2 or p.x1>o.x2 or o.y1>p.y2 or p.y1>o.y2,false) as apart,
   abs(o.distance-p.distance) as jump, o.vertical and abs(o.y1-p.y1)>o.font_size as shifted
   from o left join o p on p.page=o.page and p.rn=o.rn-1),
s(page, rn, line_id, cut, part) as (select page, rn, line_id, true, 1 from q where rn=1
  union all select q.page, q.rn, q.line_id,
    q.apart and (q.jump>2*q.font_size or (q.shifted and (not s.cut or q.jump>q.font_size))),
    s.part + case when q.apart and (q.jump>2*q.font_size or (q.shifted and (not s.cut or q.jump>q.font_size))) then 1 else 0 end
  from s join q on q.page=s.page and q.rn=s.rn+1)
select page, line_id, part from s""")
def _(v):
    d = v.blocks.select("page", F.lit(1).alias("block_id"), F.col("block_id").alias("line_id"), "x1", "y1", "x2", "y2", "font_size", "vertical",
                        F.sqrt((F.col("x1") * F.col("x1") + F.col("y1") * F.col("y1")).cast("double")).alias("distance"))
    return O.split_blocks(d).select("page", "line_id", "part")
