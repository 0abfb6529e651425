"""Registered queries of the drawing rules, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import drawings
from ..sources.tables import table, tasks_for
from .queries import query


@query("select p_partkey, case p_partkey % 4 when 0 then concat('A-', 100 + p_size, ',S-', 500 + p_size) when 1 then concat('S-', 200 + p_size) when 2 then '' else concat('M', 10 + p_size) end as sheets from part")
def pointed_sheets(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "case p_partkey % 4 when 0 then concat('5/s-', 500 + p_size, ' and see A-', 100 + p_size, ' or SEE a-', 100 + p_size) when 1 then concat('REFER TO SHEET S-', 200 + p_size, ' ASTM A36/A572') when 2 then concat('COVER SHEET G-', 100 + p_size, ' S-', 1 + p_size) else concat('See detail 4 on M', 10 + p_size) end as text")
    return rows.select("p_partkey", F.array_join(drawings.pointed_sheets(F.col("text")), ",").alias("sheets"))


@query("select l_orderkey as page_id, count(distinct l_partkey % 10000) as n_sheets from lineitem group by 1 having count(distinct l_partkey % 10000) >= 5 and max(l_linenumber) >= 6")
def index_pages(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as page_id", "concat(if(l_linenumber >= 6, 'drawing index\\n', ''), 'S-', l_partkey % 10000, ' plan') as text")
    return drawings.index_pages(rows)


@query("select p_partkey, case when p_partkey % 2 = 0 then 'STOREFRONT SCHEDULE' else 'note' end as rest from part")
def without_index_entries(spark, d):
    rows = table(spark, d, "part").selectExpr("p_partkey", "if(p_partkey % 2 = 0, concat('A1.26 DOOR PLAN\\nSTOREFRONT SCHEDULE\\n| S-', p_size, ' | x |'), concat('S-', 100 + p_size, '\\nTITLE UNDER\\nnote')) as text")
    return rows.select("p_partkey", drawings.without_index_entries(F.col("text")).alias("rest"))


DETAILS = "have as (select distinct concat('S', p_size) as sheet, cast(p_partkey % 9 as varchar) as detail from part where p_brand < 'Brand#2'), links as (select p_partkey as page_id, concat('S', p_size) as sheet, cast(p_partkey % 12 as varchar) as detail from part), judged as (select sheet, count(*) as n_details from have group by 1 having count(*) >= 3)"


@query(f"with {DETAILS} select l.sheet, l.detail, count(distinct page_id) as n_pages, min(page_id) as first_page, min(n_details) as n_details from links l join judged using (sheet) left join have h on h.sheet = l.sheet and h.detail = l.detail where h.sheet is null group by 1, 2")
def missing_details(spark, d):
    part = table(spark, d, "part")
    links = part.selectExpr("p_partkey as page_id", "concat('s', p_size) as sheet", "cast(p_partkey % 12 as string) as detail")
    return drawings.missing_details(links, part.filter("p_brand < 'Brand#2'").selectExpr("concat('S', p_size) as sheet", "cast(p_partkey % 9 as string) as detail"))


BODIES = "bodies as (select p_brand as page, p_partkey as body_id, p_partkey * 13 % 1000 / 1.0 as centre, p_size / 2.0 as half from part), lines as (select b.page, chr(cast(65 + k as int)) as label, k * 100.0 as position from (select distinct p_brand as page from part) b, range(10) t(k)), near as (select page, body_id, min(struct_pack(d := abs(centre - position), label := label, position := position)) as n from bodies join lines using (page) where abs(centre - position) <= 40 group by all)"


def _axes(spark, d):
    part = table(spark, d, "part")
    bodies = part.selectExpr("p_brand as page", "p_partkey as body_id", "cast(p_partkey * 13 % 1000 as double) as centre", "p_size / 2D as half")
    lines = part.select(F.col("p_brand").alias("page")).distinct().select("page", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("k")).selectExpr("page", "char(65 + k) as label", "k * 100D as position")
    return bodies, lines


@query(f"with {BODIES} select b.page, b.body_id, n.n.label as label, cast(round(centre - n.n.position, 6) as double) as \"offset\", case when n.n is null then 'NO_GRID' when n.n.d <= 3 then 'CENTRED' when abs(n.n.d - half) <= 3 then 'FACE' when n.n.d >= 15 then 'OFFSET' else 'UNCERTAIN' end as state from bodies b left join near n using (page, body_id)")
def axis_states(spark, d):
    return drawings.axis_states(*_axes(spark, d), 40.0, 3.0, 15.0)


@query("with s as (select event_id, case event_id % 3 when 0 then 'CENTRED' when 1 then 'OFFSET' else 'FACE' end as x, case event_id % 5 when 0 then 'OFFSET' else 'CENTRED' end as y, event_id % 7 = 0 as near from events) select event_id, case when x = 'CENTRED' and y = 'CENTRED' then 'LOCATED' when (x = 'OFFSET' or y = 'OFFSET') and not near then 'OFF_GRID' else 'UNKNOWN' end as outcome from s")
def settled_occurrences(spark, d):
    rows = table(spark, d, "events").selectExpr("event_id", "case event_id % 3 when 0 then 'CENTRED' when 1 then 'OFFSET' else 'FACE' end as x", "case event_id % 5 when 0 then 'OFFSET' else 'CENTRED' end as y", "event_id % 7 = 0 as near")
    return rows.select("event_id", drawings.settled(F.col("x"), F.col("y"), F.col("near")).alias("outcome"))


@query("with c as (select l_orderkey as label_id, l_partkey as body_id, min(l_quantity) as distance, bool_or(case l_returnflag when 'A' then true when 'R' then false end) as agrees from lineitem group by 1, 2), r as (select *, row_number() over (partition by label_id order by distance, body_id) as place from c), t as (select label_id, max(body_id) filter (where place = 1) as body, max(distance) filter (where place = 1) as d0, max(distance) filter (where place = 2) as d1, bool_or(agrees) filter (where place = 1) as fits, bool_or(agrees) filter (where place = 2) as next_fits from r where place <= 2 group by 1), o as (select *, case when d1 is not null and d1 <= greatest(d0 * 1.5, d0 + 4) and coalesce(next_fits, true) then 'ambiguous' when not coalesce(fits, true) then 'size_mismatch' else 'associated' end as outcome from t) select label_id, outcome, case when outcome = 'associated' then body end as body_id from o")
def associated_labels(spark, d):
    rows = table(spark, d, "lineitem").selectExpr("l_orderkey as label_id", "l_partkey as body_id", "l_quantity as distance", "case l_returnflag when 'A' then true when 'R' then false end as agrees")
    return drawings.associated(rows.groupBy("label_id", "body_id").agg(F.min("distance").alias("distance"), F.bool_or("agrees").alias("agrees")))


@query("with n as (select p_partkey // 20 as page, cast(p_partkey as varchar) as label, p_partkey % 20 * 1.0 as position from part) select c.page, concat(c.label, '/', r.label) as crossing, cast(c.position as double) as x, cast(r.position as double) as y from n c join n r using (page)")
def grid_crossings(spark, d):
    lines = table(spark, d, "part").selectExpr("p_partkey div 20 as page", "cast(p_partkey as string) as label", "cast(p_partkey % 20 as double) as position")
    return drawings.intersections(lines, lines)


@query("select p_brand as page, string_agg(lpad(cast(p_partkey as varchar), 8, '0'), ',' order by p_partkey) as labels, cast(p_size * 3 as double) as position from part group by p_brand, p_size having count(*) > 1")
def shared_grid_lines(spark, d):
    lines = table(spark, d, "part").selectExpr("p_brand as page", "lpad(cast(p_partkey as string), 8, '0') as label", "p_size * 3D as position")
    return drawings.shared_lines(lines)


@query("with m as (select l_suppkey as page, l_returnflag as family, l_linenumber as left_, l_orderkey as mark_id, cast(l_orderkey as double) as y, l_partkey % 5 as text from lineitem group by all), l as (select *, case when coalesce(y - lag(y) over w, 301) > 300 then 1 else 0 end as new from m window w as (partition by page, family, left_ order by y, mark_id, text)), c as (select *, sum(new) over (partition by page, family, left_ order by y, mark_id, text rows unbounded preceding) as chain from l), k as (select page, family, left_, chain from c group by all having count(distinct text) >= 3) select page, family, cast(left_ as int) as \"left\", mark_id, text from c semi join k using (page, family, left_, chain)")
def schedule_rows(spark, d):
    # distinct rows, chains and their texts by one shuffle, over as many tasks as the rows need
    lines = table(spark, d, "lineitem")
    marks = lines.selectExpr("l_suppkey as page", "l_returnflag as family", "l_linenumber as left", "l_orderkey as mark_id", "cast(l_orderkey as double) as y", "l_partkey % 5 as text").repartition(tasks_for(lines), "page", "family", "left").distinct()
    return drawings.schedule_rows(marks, 300.0).select("page", "family", "left", "mark_id", "text")


@query("with a as (select p_partkey // 20 as pair, cast(p_partkey as varchar) as label, p_partkey % 20 * 10.0 as position from part), b as (select p_partkey // 20 as pair, cast(p_partkey as varchar) as label, p_partkey % 20 * 10.0 + case when p_partkey % 4 = 0 then 2 else 0 end as position from part), x as (select pair, label as start, lead(label) over w as e, lead(position) over w - position as wa from a window w as (partition by pair order by position)), y as (select pair, label as start, lead(label) over w as e, lead(position) over w - position as wb from b window w as (partition by pair order by position)) select pair, start, x.e as \"end\", cast(wa as double) as width_a, cast(wb as double) as width_b, cast(wb - wa as double) as difference from x join y using (pair, start) where x.e = y.e and abs(wb - wa) > 1")
def spacing_differences(spark, d):
    n = table(spark, d, "part").selectExpr("p_partkey", "p_partkey div 20 as pair", "cast(p_partkey as string) as label", "p_partkey % 20 * 10D as position")
    a = n.select("pair", "label", "position")
    return drawings.spacing_differences(a, n.selectExpr("pair", "label", "position + if(p_partkey % 4 = 0, 2, 0) as position"), 1.0)


@query("with s as (select l_partkey as mark, min(l_orderkey) as schedule_page from lineitem where l_returnflag = 'R' group by 1), p as (select l_partkey as mark, min(l_orderkey) as plan_page from lineitem where l_linestatus = 'F' group by 1) select mark, schedule_page, plan_page from s join p using (mark)")
def schedule_loops(spark, d):
    rows = table(spark, d, "lineitem")
    schedule = rows.selectExpr("l_partkey as mark", "l_orderkey as page_id", "if(l_returnflag = 'R', 'see  plan', '12x12') as note")
    return drawings.schedule_loops(schedule, rows.selectExpr("l_partkey as mark", "l_orderkey as page_id", "if(l_linestatus = 'F', 'See schedule', 'ok') as note"))


@query("with l as (select c_nationkey as project, round(c_custkey % 37 / 1.0, 0) as place, c_mktsegment as label, c_custkey % 3 as discipline from customer) select project, cast(place as double) as place, string_agg(distinct label, ',' order by label) as labels, count(distinct label) as n_labels, count(distinct discipline) as n_disciplines from l group by 1, 2 having count(distinct label) > 1")
def line_aliases(spark, d):
    return drawings.line_aliases(table(spark, d, "customer").selectExpr("c_nationkey as project", "cast(c_custkey % 37 as double) as position", "c_mktsegment as label", "c_custkey % 3 as discipline"))
