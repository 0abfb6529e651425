"""Registered queries of sheets to compare: orders as sheets of their customers' projects."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import pairing
from ..sources.tables import table
from .queries import query

SHEETS = """s as (select o_custkey as project, o_orderkey as page_id, 'S' || o_orderkey as label, case when o_orderkey % 11 = 0 then null else 'LEVEL ' || o_orderkey % 3 end as level,
    (['architectural', 'structural', 'plumbing', 'electrical', null])[o_orderkey // 3 % 5 + 1] as discipline, (['plan', 'plan', 'enlarged_plan', 'section', null])[o_orderkey // 7 % 5 + 1] as kind,
    case when o_orderkey % 13 = 0 then [] else [9.0 + o_orderkey % 3 * 9, 36.0 + o_orderkey % 2] end as scales, o_orderkey % 17 = 0 as views from orders)"""


def _sheets(spark, d):
    return table(spark, d, "orders").selectExpr(
        "o_custkey as project", "o_orderkey as page_id", "concat('S', o_orderkey) as label", "if(o_orderkey % 11 = 0, null, concat('LEVEL ', o_orderkey % 3)) as level",
        "element_at(array('architectural', 'structural', 'plumbing', 'electrical', null), cast(o_orderkey div 3 % 5 + 1 as int)) as discipline", "element_at(array('plan', 'plan', 'enlarged_plan', 'section', null), cast(o_orderkey div 7 % 5 + 1 as int)) as kind",
        "if(o_orderkey % 13 = 0, cast(array() as array<double>), array(9D + o_orderkey % 3 * 9, 36D + o_orderkey % 2)) as scales", "o_orderkey % 17 = 0 as views",
    )


PAIRS = f"""{SHEETS}, open as (select *, list_min(scales) as smallest, coalesce(discipline in ('architectural', 'structural'), false) as governs from s where kind in ('plan', 'enlarged_plan') and level is not null and len(scales) > 0 and not views),
  pairs as (select a.project, 'same_level' as kind, a.page_id as a, b.page_id as b, a.level, null::double as ratio from open a join open b using (project, level)
      where a.kind = 'plan' and b.kind = 'plan' and a.discipline < b.discipline and (a.governs or b.governs) and len(list_filter(a.scales, lambda x: len(list_filter(b.scales, lambda y: abs(x - y) <= 0.02 * greatest(x, y))) > 0)) > 0
    union all select a.project, 'enlarged', a.page_id, b.page_id, a.level, round(a.smallest / b.smallest, 6) from open a join open b using (project, level) where a.page_id <> b.page_id and b.kind = 'plan' and a.smallest / b.smallest >= 1.5
      and case when a.kind = 'plan' then a.smallest / b.smallest >= 2 and a.discipline is not distinct from b.discipline else a.discipline is not distinct from b.discipline or a.governs or b.governs end)"""


@query(f"with {PAIRS} select project, kind, a, b, level, ratio::double as ratio from pairs")
def sheet_pairs(spark, d):
    return pairing.sheet_pairs(_sheets(spark, d))[0].withColumn("ratio", F.round("ratio", 6))


@query(f"""with {PAIRS}, paired as (select project, a as page_id from pairs union select project, b from pairs), there as (select project, level, list(distinct discipline) filter (where discipline is not null) as ds from open group by 1, 2)
  select project, page_id, case when level is null then '{pairing.NO_LEVEL}' when len(scales) = 0 then '{pairing.NO_SCALE}' else '{pairing.VIEWS}' end as reason from s where kind in ('plan', 'enlarged_plan') and (level is null or len(scales) = 0 or views)
  union all select o.project, page_id, case when discipline is null then '{pairing.NO_DISCIPLINE}' when len(list_filter(ds, lambda x: x <> discipline)) = 0 then '{pairing.ALONE}'
    when not governs and len(list_filter(ds, lambda x: x <> discipline and x in ('architectural', 'structural'))) = 0 then '{pairing.NOT_GOVERNED.replace("'", "''")}' else '{pairing.OTHER_SCALE.replace("'", "''")}' end
    from open o join there using (project, level) where page_id not in (select page_id from paired)""")
def sheets_left_out(spark, d):
    return pairing.sheet_pairs(_sheets(spark, d))[1]


@query("""with p as (select p_partkey, 100.0::double + p_partkey % 700 as w, 150.0::double + p_size * 20 as h, 400.0::double + p_partkey % 90 as bw, p_size * 3.0::double as tx from part),
  n as (select *, greatest(1, ceil(w / (240 * (1 - 0.12::double)))::int) as nx, greatest(1, ceil(h / (240 * (1 - 0.12::double)))::int) as ny, least(240.0::double, w) as tw, least(240.0::double, h) as th from p),
  t as (select *, unnest(range(nx * ny)) as k from n),
  r as (select *, case when nx > 1 then (w - tw) * (k % nx) / (nx - 1) else 0 end as x0, case when ny > 1 then (h - th) * (k // nx) / (ny - 1) else 0 end as y0 from t),
  c as (select p_partkey, k, x0, y0, least(x0 + tw, bw - tx) as x1, least(y0 + th, 900.0::double) as y1 from r)
  select p_partkey, round(x0, 6) as x0, round(y0, 6) as y0, round(x1, 6) as x1, round(y1, 6) as y1 from c where x1 - x0 >= 60 and y1 - y0 >= 60""")
def tiles_of_pairs(spark, d):
    """Tiles of an area beside a narrower sheet: they are cut at its edge, slivers go."""
    parts = table(spark, d, "part")
    area = F.struct(F.lit(0.0).alias("x0"), F.lit(0.0).alias("y0"), (F.lit(100.0) + F.col("p_partkey") % 700).alias("x1"), (F.lit(150.0) + F.col("p_size") * 20).alias("y1"))
    cut = pairing.tiles(area, F.lit(1.0), F.col("p_size") * 3.0, F.lit(0.0), F.lit(400.0) + F.col("p_partkey") % 90, F.lit(900.0), 240.0)
    return parts.select("p_partkey", F.explode(cut).alias("t")).select("p_partkey", *[F.round(f"t.a.{e}", 6).alias(e) for e in ("x0", "y0", "x1", "y1")])


@query(f"""with {SHEETS}, of_first as (select project, arg_min({{'s': label, 'l': level}}, (case kind when 'plan' then 0 when 'enlarged_plan' then 1 else 2 end, case when level is null then 2 else 1 end, page_id)) as pick from s where discipline = 'architectural' and coalesce(kind, 'plan') in ('plan', 'enlarged_plan') group by 1),
  first as (select c_custkey as project, pick, exists (select 1 from s where project = c_custkey and discipline = 'architectural') as has_a, exists (select 1 from s where project = c_custkey and discipline = 'structural') as has_s from customer left join of_first on project = c_custkey),
  of_second as (select f.project, arg_min(label, (case kind when 'plan' then 0 when 'enlarged_plan' then 1 when 'section' then 3 else 2 end, case when pick.l is not null and level = pick.l then 0 when level is not null then 1 else 2 end, page_id)) as pick2 from first f join s on s.project = f.project and discipline = 'structural' group by 1)
  select f.project as element_id, array_to_string(list_filter([pick.s, pick2], lambda x: x is not null), ',') as sheets, array_to_string(list_filter([case when not has_a then 'Arch plans' end, case when not has_s then 'Struct' end], lambda x: x is not null), ',') as missing, 'Geotech' as outside
  from first f left join of_second using (project)""")
def sheet_suggestions(spark, d):
    """For each customer the sheets of an element that compares across plans, a discipline and a document."""
    sheets = _sheets(spark, d).select("project", F.col("label").alias("sheet"), F.col("page_id").alias("page"), "discipline", "kind", "level", F.lit(None).cast("string").alias("title"), F.array().cast("array<string>").alias("headings"))
    none = F.lit(None).cast("string")
    elements = table(spark, d, "customer").select(F.col("c_custkey").alias("project"), F.col("c_custkey").alias("element_id"), F.array(F.lit("Arch plans"), F.lit("Geotech"), F.lit("Struct")).alias("entries"), none.alias("name"), none.alias("stage"))
    found = pairing.suggested(elements, sheets)
    return found.select("element_id", *[F.array_join(c, ",").alias(c) for c in ("sheets", "missing", "outside")])
