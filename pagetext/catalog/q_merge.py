"""Queries that merge, prune, stitch and score boxes."""

from __future__ import annotations

from pyspark.sql import functions as F

from pagetext.catalog.registry import query
from pagetext.operators import aggregates as A
from pagetext.operators import merge as M
from pagetext.operators.boxes import assign_lines

IOU = """(greatest(0,least(a.x2,b.x2)-greatest(a.x1,b.x1))::double*greatest(0,least(a.y2,b.y2)-greatest(a.y1,b.y1)))"""
AREA = "((a.x2-a.x1)*(a.y2-a.y1)+(b.x2-b.x1)*(b.y2-b.y1))"
REACH = """r as (select page, block_id as n, block_id as m from blocks union select r.page, r.n, e.b from r join e on e.page=r.page and e.a=r.m),
comp as (select page, n as block_id, min(m) as component from r group by page, n)"""


def _text(v):
    return v.blocks.withColumn("text", F.concat("label", F.col("block_id").cast("string")))


def _merge_oracle(lo, hi, glo, ghi, ratio, gap, order, label):
    return f"""with recursive p as (select a.page, a.block_id as a, b.block_id as b from blocks a join blocks b on a.page=b.page and a.block_id<>b.block_id
  where greatest(0,least(a.{hi},b.{hi})-greatest(a.{lo},b.{lo}))::double/greatest(1e-6,least(a.{hi}-a.{lo},b.{hi}-b.{lo}))*100 >= {ratio}
  and greatest(a.{glo},b.{glo})-least(a.{ghi},b.{ghi}) <= {gap}), e as (select * from p),
{REACH}
select page, cast(component as int) as block_id, {label} as label, string_agg(label||block_id, '' order by {order}, block_id) as text, min(x1) as x1, min(y1) as y1,
 max(x2) as x2, max(y2) as y2, count(*) as members from blocks join comp using (page, block_id) group by page, component"""


@query("j16_merge_boxes", _merge_oracle("x1", "x2", "y1", "y2", 50, 20, "x1 desc", "arg_min(label, block_id)"))
def _(v):
    return M.merge_boxes(_text(v), "VERTICAL", max_vertical_gap=20, min_width_overlap_ratio=50, direction="RTL")


@query("j16b_merge_horizontal_combined", _merge_oracle("y1", "y2", "x1", "x2", 40, 60, "x1", """
 arg_min(label, block_id) || coalesce('+' || string_agg(case when block_id >= firstdiff then label end, '+' order by block_id), '')""").replace(
    "from blocks join comp using (page, block_id) group by", """from (select b.*, component, min(case when label<>lead_label then block_id end) over (partition by page, component) as firstdiff
  from (select b.*, component, first_value(label) over (partition by b.page, component order by b.block_id) as lead_label from blocks b join comp using (page, block_id)) b) z group by"""))
def _(v):
    return M.merge_boxes(_text(v), "HORIZONTAL", max_horizontal_gap=60, min_height_overlap_ratio=40, label_strategy="COMBINE")


@query("j16c_merge_two_pass")
def _(v):
    return M.merge_boxes(_text(v), "VERTICAL_THEN_HORIZONTAL", max_vertical_gap=20, min_width_overlap_ratio=50, max_horizontal_gap=30,
                         min_height_overlap_ratio=50, require_same_label=True, direction="TTB")


@query("j17_merge_duplicate_boxes", f"""with recursive e as (select a.page, a.block_id as a, b.block_id as b from blocks a join blocks b on a.page=b.page and a.block_id<>b.block_id
  where {IOU}/nullif({AREA}-{IOU},0) >= 0.2), {REACH}
select page, cast(component as int) as block_id, min(x1) as x1, min(y1) as y1, max(x2) as x2, max(y2) as y2, count(*) as members
from blocks join comp using (page, block_id) group by page, component""")
def _(v):
    return M.merge_duplicate_boxes(v.blocks, 0.2)


@query("g1_connected_components", f"""with recursive e as (select a.page, a.block_id as a, b.block_id as b from blocks a join blocks b on a.page=b.page and a.block_id<>b.block_id
  where {IOU} > 0), {REACH} select page, block_id, component from comp""")
def _(v):
    from pagetext.functions import geometry as g
    from pagetext.operators.graph import label_components
    from pagetext.operators.tiles import self_pairs

    pairs = self_pairs(v.blocks, "block_id").filter(g.inter_area() > 0).select("page", "block_id", "r_block_id")
    return label_components(v.blocks, pairs, ["page"], "block_id").select("page", "block_id", "component")


def _kept_sql(rows: str, covered: str) -> str:
    """Page by page, one box a step in the order of ``rn``: a box joins the kept list unless a kept one covers it."""
    both = "greatest(0, least(o.x2, k.x2) - greatest(o.x1, k.x1)) * greatest(0, least(o.y2, k.y2) - greatest(o.y1, k.y1))"
    return f"""with recursive o as ({rows}), r as (select page, 0::bigint as rn, [{{'id': 0, 'x1': 0, 'y1': 0, 'x2': 0, 'y2': 0}}][:0] as kept from (select distinct page from o)
 union all select o.page, o.rn, case when len(list_filter(r.kept, lambda k: {covered.format(both=both)})) > 0 then r.kept
  else list_append(r.kept, {{'id': o.block_id, 'x1': o.x1, 'y1': o.y1, 'x2': o.x2, 'y2': o.y2}}) end from r join o on o.page = r.page and o.rn = r.rn + 1),
l as (select page, arg_max(kept, rn) as kept from r group by page), u as (select page, unnest(kept) as k from l)
select page, k.id as block_id, k.x1 as x1, k.y1 as y1, k.x2 as x2, k.y2 as y2 from u"""


@query("w15_remove_contained", _kept_sql("""select *, (x2-x1)*(y2-y1) as area, row_number() over (partition by page order by (x2-x1)*(y2-y1) desc, block_id) as rn
 from blocks where (x2-x1)*(y2-y1) > 0""", "{both} / o.area::double >= 0.5"))
def _(v):
    return M.remove_contained(v.blocks, 0.5).select("page", "block_id", "x1", "y1", "x2", "y2")


@query("w15b_remove_contained_arrival", _kept_sql("select *, (x2-x1)*(y2-y1) as area, row_number() over (partition by page order by block_id) as rn from blocks", "{both} / (o.area + 1e-6::double) > 0.4"))
def _(v):
    return M.remove_contained(v.blocks, 0.4, by="arrival").select("page", "block_id", "x1", "y1", "x2", "y2")


@query("w15c_remove_fully_contained", """select page, block_id, x1, y1, x2, y2 from blocks a where not exists (select 1 from blocks b where b.page=a.page
 and b.block_id<>a.block_id and b.x1<=a.x1 and b.y1<=a.y1 and b.x2>=a.x2 and b.y2>=a.y2 and not (b.x1=a.x1 and b.y1=a.y1 and b.x2=a.x2 and b.y2=a.y2))""")
def _(v):
    return M.remove_fully_contained(v.blocks).select("page", "block_id", "x1", "y1", "x2", "y2")


@query("w16_stitch_slices")
def _(v):
    return M.stitch_slices(v.blocks.withColumn("start_y", F.col("block_id") % 3 * 40))


@query("j6_match_detections", """with recursive x as (select t.page, t.block_id as gt, f.cand_id as det, t.label='N' as dont_care, (f.x2-f.x1)*(f.y2-f.y1) as area, (t.x2-t.x1)*(t.y2-t.y1) as own,
  greatest(0, least(t.x2,f.x2)-greatest(t.x1,f.x1))*greatest(0, least(t.y2,f.y2)-greatest(t.y1,f.y1)) as common from blocks t join candidates f on f.page=t.page),
i as (select distinct page, det from x where common>0 and dont_care and area>0 and common/area::double>0.5),
c as (select x.page, gt, x.det, row_number() over (partition by x.page order by gt, x.det) as rn from x left join i on i.page=x.page and i.det=x.det where i.det is null and common>0 and not dont_care and own+area-common>0 and common/(own+area-common)::double>0.5),
r as (select page, 0::bigint as rn, []::int[] as gts, []::int[] as dets from (select distinct page from c)
 union all select c.page, c.rn, case when list_contains(gts, gt) or list_contains(dets, det) then gts else list_append(gts, gt) end, case when list_contains(gts, gt) or list_contains(dets, det) then dets else list_append(dets, det) end
  from r join c on c.page=r.page and c.rn=r.rn+1),
l as (select page, arg_max(gts, rn) as gts, arg_max(dets, rn) as dets from r group by page)
select page, unnest(gts) as gt, unnest(dets) as det from l""")
def _(v):
    truth = v.blocks.withColumn("ignore", F.col("label") == "N")
    return M.match_detections(truth, v.candidates.withColumnRenamed("cand_id", "block_id"))[0]


@query("j18_merge_textlines")
def _(v):
    return M.merge_textlines(v.blocks)


@query("a8_detection_scores", f"""with c as (select page, count(*) as n_gt from blocks where label<>'N' group by page),
d as (select page, count(*) as n_det from candidates group by page),
m as (select a.page, count(*) as matched from blocks a join candidates b on a.page=b.page and a.block_id=b.cand_id and a.label<>'N'
  where {IOU}/nullif({AREA}-{IOU},0) > 0.5 group by a.page),
t as (select page, coalesce(matched,0) as matched, coalesce(n_gt,0) as n_gt, coalesce(n_det,0) as n_det
  from (select distinct page from blocks) p left join c using(page) left join d using(page) left join m using(page)),
s as (select page, matched::bigint as matched, n_gt::bigint as n_gt, n_det::bigint as n_det,
  case when n_gt=0 then 1.0::double else matched::double/n_gt end as recall,
  case when n_gt=0 then case when n_det>0 then 0.0::double else 1.0::double end when n_det=0 then 0 else matched::double/n_det end as prec from t
 union all select null, sum(matched)::bigint, sum(n_gt)::bigint, sum(n_det)::bigint, sum(matched)::double/sum(n_gt), sum(matched)::double/sum(n_det) from t)
select page, matched, n_gt, n_det, round(recall,6) as recall, round(prec,6) as precision, round(case when prec+recall>0 then 2*prec*recall/(prec+recall) else 0 end,6) as hmean from s""")
def _(v):
    from pagetext.functions import geometry as g
    from pagetext.operators.tiles import box_pairs

    gt = v.blocks.filter("label <> 'N'")
    same = box_pairs(gt, v.candidates).filter((F.col("block_id") == F.col("r_cand_id")) & (g.plain_iou() > 0.5))
    counts = (v.blocks.groupBy("page").agg(F.count_if(F.col("label") != "N").alias("n_gt"))
              .join(v.candidates.groupBy("page").agg(F.count(F.lit(1)).alias("n_det")), "page", "left")
              .join(same.groupBy("page").agg(F.count(F.lit(1)).alias("matched")), "page", "left").fillna(0))
    d = A.detection_scores(counts)
    return d.select("page", "matched", "n_gt", "n_det", *[F.round(c, 6).alias(c) for c in ("recall", "precision", "hmean")])


@query("a3_vote_direction", """with d as (select page, block_id, vertical, greatest((x2-x1)::double/(y2-y1),1/((x2-x1)::double/(y2-y1))) as ext from blocks),
g as (select page, count(*) as n, count(*) filter (vertical) as nv, arg_max(vertical, (ext, -block_id)) as tie from d group by page)
select page, n, nv, case when nv*2=n then tie else nv*2>n end as majority, nv >= n//2 as simple from g""")
def _(v):
    return A.vote_direction(v.blocks, ["page"])


@query("a4_mean_colour", """select page, label, cast(round_even(avg(x1%256),0) as int) as fg_r, cast(round_even(avg(y1%256),0) as int) as fg_g,
 cast(round_even(avg(x2%256),0) as int) as fg_b, cast(round_even(avg(y2%256),0) as int) as bg_r, cast(round_even(avg(font_size),0) as int) as bg_g,
 cast(round_even(avg(block_id),0) as int) as bg_b from blocks group by page, label""")
def _(v):
    d = v.blocks.select("page", "label", (F.col("x1") % 256).alias("fg_r"), (F.col("y1") % 256).alias("fg_g"), (F.col("x2") % 256).alias("fg_b"),
                        (F.col("y2") % 256).alias("bg_r"), F.col("font_size").alias("bg_g"), F.col("block_id").alias("bg_b"))
    return A.mean_colour(d, ["page", "label"], ["fg_r", "fg_g", "fg_b", "bg_r", "bg_g", "bg_b"])


@query("a5_region_confidence", """with d as (select *, (x2-x1)*(y2-y1) as area, (font_size+1)/50.0::double as prob, 1.5::double+(block_id*13%20)/100.0::double as angle from blocks),
t as (select page, sum(area) as total from d group by page)
select page, label, round(sum(ln(prob)*area)/any_value(total),6) as log_confidence, min(font_size) as font_size,
 round(case when abs(degrees(avg(angle))-90)<3 then 0 else degrees(avg(angle))-90 end,6) as angle from d join t using (page) group by page, label""")
def _(v):
    d = v.blocks.withColumns({"prob": (F.col("font_size") + 1) / F.lit(50.0), "angle": F.lit(1.5) + (F.col("block_id") * 13 % 20) / F.lit(100.0)})
    return A.region_confidence(d, ["page", "label"]).select("page", "label", F.round("log_confidence", 6).alias("log_confidence"), "font_size",
                                                            F.round("angle", 6).alias("angle"))


@query("a12_line_scale", "select page, label, median(least(x2-x1,y2-y1))::double as scale from blocks group by page, label")
def _(v):
    return A.line_scale(v.blocks, ["page", "label"])


_LINES = """l as (select page, block_id as line_id, label, x1, y1, x2, y2 from blocks)"""


@query("a16_block_hull", """with p as (select c.page, c.cand_id, b.block_id,
  greatest(0,least(b.x2,c.x2)-greatest(b.x1,c.x1))::double*greatest(0,least(b.y2,c.y2)-greatest(b.y1,c.y1))/((c.x2-c.x1)*(c.y2-c.y1)) as score, c.x1,c.y1,c.x2,c.y2
  from candidates c join blocks b on b.page=c.page),
a as (select * from (select *, row_number() over (partition by page,cand_id order by score desc, block_id) rn from p) t where rn=1 and score>0.4),
u as (select page, block_id, x1,y1,x2,y2 from a union all select page, block_id, x1,y1,x2,y2 from blocks b where exists (select 1 from a where a.page=b.page and a.block_id=b.block_id))
select page, block_id, greatest(0,least(900,min(x1))) as x1, min(y1) as y1, greatest(0,least(900,max(x2))) as x2, max(y2) as y2 from u group by page, block_id""")
def _(v):
    lines = assign_lines(v.candidates.withColumnRenamed("cand_id", "line_id"), v.blocks).filter("block_id is not null")
    return A.block_hull(lines, ["page", "block_id"], v.blocks, x_range=(0, 900))


@query("a17_vote_alignment", """with s as (select page, label, round(stddev_pop(x1),9) as l, round(stddev_pop(x2),9) as r, round(stddev_pop((x1+x2)/2.0::double)*0.7::double,9) as c
 from blocks group by page, label) select page, label, case when l<r and l<c then 'left' when r<l and r<c then 'right' else 'center' end as alignment from s""")
def _(v):
    return A.vote_alignment(v.blocks, ["page", "label"])


_QUAD = """q as (select page, label, block_id as line_id, x1::double as px0, y1::double as py0, x2::double as px1, y1+block_id%5::double as py1, x2::double as px2,
  y2+block_id%5::double as py2, x1::double as px3, y2::double as py3, label='A' as vertical from blocks),
s as (select page, label, vertical, count(*) as n, sum((px2+px3-px0-px1)/2) as vx, sum((py2+py3-py0-py1)/2) as vy, sum((px1+px2-px0-px3)/2) as hx, sum((py1+py2-py0-py3)/2) as hy
  from q group by page, label, vertical),
u as (select *, case when vertical then vx else hx end as ux, case when vertical then vy else hy end as uy, case when vertical then sqrt(hx*hx+hy*hy) else sqrt(vx*vx+vy*vy) end as other from s),
k as (select *, cast(trunc(degrees(atan2(uy,ux))) as int) - case when vertical then 90 else 0 end as deg from u)"""


def _quads(v):
    c, s = F.col, F.col("block_id") % 5
    return v.blocks.select("page", "label", c("block_id").alias("line_id"), (c("label") == "A").alias("vertical"),
                           *[e.cast("double").alias(n) for n, e in (("px0", c("x1")), ("py0", c("y1")), ("px1", c("x2")), ("py1", c("y1") + s),
                                                                    ("px2", c("x2")), ("py2", c("y2") + s), ("px3", c("x1")), ("py3", c("y2")))])


@query("a18_line_stats", f"with {_QUAD} select page, label, vertical, n, cast(round_even(other/n,0) as int) as font_size, case when abs(deg)<3 then 0 else deg end as angle from k")
def _(v):
    return A.line_stats(_quads(v), ["page", "label"])[0]


@query("a18b_line_order", f"""with {_QUAD}, d as (select q.page, q.label, q.line_id,
  round(abs(((px0+px2)/2-case when q.vertical then 1050 else 0 end)*uy-((py0+py2)/2)*ux)/sqrt(ux*ux+uy*uy),6) as distance from q join k using (page, label))
select *, cast(row_number() over (partition by page, label order by distance, line_id) as int) as rank from d""")
def _(v):
    return A.line_stats(_quads(v), ["page", "label"])[1]
