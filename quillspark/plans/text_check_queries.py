"""Registered queries of the checks that run from raw text: order lines as notes, the SQL takes what they say from the columns."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import contexts
from ..operators import text_checks
from ..sources.tables import table
from .queries import query


@query("""with r as (select l_suppkey % 500 as tag, l_orderkey as sheet, l_linenumber * 10.5 as value from lineitem where l_suppkey % 2 = 1), v as (select tag, value, count(distinct sheet) as sheets from r group by 1, 2)
  select 'EF-' || tag as tag, 'CFM' as unit, count(*) as n_values, (select count(distinct sheet) from r x where x.tag = v.tag) as n_sheets, min(value)::double as low, max(value)::double as high, case when max(sheets) >= 2 then 'high' else 'medium' end as confidence
  from v group by tag having count(*) >= 2 and n_sheets >= 2""")
def rating_conflicts(spark, d):
    """Fans rated in their labels; every second one's two values are supply and exhaust."""
    text = F.expr("""concat('see fan schedule\n  ef-', l_suppkey % 500, ' ', if(l_suppkey % 2 = 1, '', if(l_linenumber % 2 = 0, 'supply ', 'exhaust ')), if(l_suppkey % 2 = 1, l_linenumber, 1 + l_linenumber % 2) * 10.5, ' cfm. 10 hp or 12 hp')""")
    return text_checks.tag_value_conflicts(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), text.alias("text")))


@query("""select p_partkey, 'RTU-' || p_size as tag, 'TONS' as unit, (p_size + 0.5)::double as value, case p_partkey % 3 when 0 then 'MIN' when 1 then 'COOLING,TOTAL' else '' end as qualifiers from part""")
def rating_qualifiers(spark, d):
    text = F.expr("concat(p_name, '\nrtu-', p_size, if(p_partkey % 3 = 1, ' total cooling ', ' '), p_size, if(p_partkey % 2 = 0, '-1/2', '.5'), ' tons', if(p_partkey % 3 = 0, ' minimum', ''), '\n', p_brand)")
    rows = table(spark, d, "part").select("p_partkey", F.explode(contexts.rated_tags(text)).alias("r"))
    return rows.select("p_partkey", "r.tag", "r.unit", F.round("r.value", 6).alias("value"), F.array_join(F.array_sort("r.qualifiers"), ",").alias("qualifiers"))


@query("""select family, 'PC' || n as mark, count(distinct page_id) as n_pages, min(page_id) as first_page from (select 'PC' as family, l_partkey % 300 as n, l_orderkey as page_id from lineitem where l_linenumber % 5 = 0)
  where n not in (select l_partkey % 300 from lineitem where l_orderkey % 90 = 0) group by 1, 2""")
def unscheduled_in_text(spark, d):
    """Marks as drawn, or as the tail of a room, after SEE, at a grid, in a listing or a callout: only the first are used."""
    said = F.expr("""concat('Note ', l_linenumber, ': ', case l_linenumber % 5 when 0 then 'pile cap ' when 1 then 'room 12-' when 2 then 'refer to ' when 3 then 'grid lines ' else 'ASTM ' end, 'pc', if(l_linenumber % 5 in (0, 1), '-', ''), l_partkey % 300, if(l_linenumber % 5 = 4 and l_partkey % 300 < 10, '/A-201', ''))""")
    # of one digit, a number is no listing's: there a callout hides it
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), said.alias("text"))
    schedule = table(spark, d, "lineitem").filter("l_orderkey % 90 = 0").select(F.col("l_orderkey").alias("page_id"), F.expr("concat('PC', l_partkey % 300)").alias("text"))
    return text_checks.unscheduled_marks(notes, schedule)


@query("""with r as (select distinct l_orderkey as page_id, l_suppkey % 400 + 500 as n from lineitem where l_linenumber % 3 < 2), issued as (select distinct s_suppkey % 400 + 500 as n from supplier where s_suppkey % 3 > 0)
  select 'S' || n as sheet, count(*) as n_pages, min(page_id) as first_page from r where n not in (select n from issued) group by n""")
def dangling_in_text(spark, d):
    """Sheets that notes point at by a word or a callout; those of a listing are no references."""
    said = F.expr("case l_linenumber % 3 when 0 then concat('see sheet s-', l_suppkey % 400 + 500, ' and on') when 1 then concat('4 / S-', l_suppkey % 400 + 500) else concat('on S-', l_suppkey % 400 + 500, ' or U419 series') end")
    notes = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page_id"), said.alias("text"))
    issued = table(spark, d, "supplier").filter("s_suppkey % 3 > 0").select(F.expr("concat('S-', s_suppkey % 400 + 500)").alias("sheet"))
    return text_checks.dangling_references(notes, issued).select("sheet", "n_pages", "first_page")


@query("""select p_partkey, case p_size % 4 when 0 then upper(p_type) || ' CAP SCHEDULE' when 1 then 'PILE CAP SCHEDULE|STUD ' || upper(p_type) || ' SCHEDULE' else '' end as titles, p_size % 4 = 1 or (p_size % 4 = 0 and p_type like 'P%') as of_pile_caps from part""")
def titles_of_schedules(spark, d):
    """Titles in running text; pointers at schedules are none."""
    said = F.expr("""case p_size % 4 when 0 then concat('note 1.\n', p_type, '  cap schedule: rows') when 1 then concat('pile cap schedule\n(stud ', p_type, ' schedule)') when 2 then concat('for ', p_type, ' schedule, ', p_name) else concat(p_type, ' schedule - refer to S-', p_size) end""")
    found = table(spark, d, "part").select("p_partkey", contexts.schedule_titles(said).alias("titles"))
    return found.select("p_partkey", F.array_join("titles", "|").alias("titles"), F.exists("titles", lambda t: contexts.names_family(t, F.lit("PC"))).alias("of_pile_caps"))


@query("""select p_partkey, case p_size % 3 when 0 then 'D' || p_size when 1 then 'E' || p_size else '' end as details, case p_size % 3 when 0 then '' when 1 then 'A' || 30 + p_size else 'A' || 300 + p_size || ',A36' end as catalogue from part""")
def numbers_of_others(spark, d):
    """Detail numbers beside a sheet's, and numbers of makers and grades: none of them a mark."""
    said = F.expr("case p_size % 3 when 0 then concat('see d', p_size, '/A3.11 ', p_name) when 1 then concat('a2.87 e', p_size, ' and simpson a', 30 + p_size, ', ', p_name) else concat('from either A', 300 + p_size, ' or a36 steel, D', p_size) end")
    found = table(spark, d, "part").select("p_partkey", contexts.detail_numbers(said).alias("a"), contexts.catalogue_numbers(said).alias("b"))
    return found.select("p_partkey", F.array_join("a", ",").alias("details"), F.array_join("b", ",").alias("catalogue"))


@query("select p_partkey, unnest(case when p_size % 2 = 0 then [round(72.0::double / (1 + p_size), 4), 108.0::double] else [18.0::double] end) as points_a_foot from part")
def printed_scales(spark, d):
    said = F.expr("""if(p_size % 2 = 0, concat('SCALE: 1/', 1 + p_size, '" = 1\\'-0"\nDETAIL 1 1/2" = 1\\'-0" ', p_name), concat('2026.02.', p_size, ' 1/4'' = 1 foot, PLAN 1/4″ = 1′-0″'))""")
    return table(spark, d, "part").select("p_partkey", F.explode(contexts.scales_in(said)).alias("points_a_foot"))
