"""Registered queries of review runs, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import retrieval, review
from ..sources.tables import table
from . import views
from .queries import IDENTIFIERS, query


@query("select p_partkey % 20 as project, p_size as level, count(distinct p_brand) as n_sheets, min(p_brand) as first_sheet from part group by 1, 2")
def level_index(spark, d):
    return review.level_index(table(spark, d, "part").selectExpr("p_partkey % 20 as project", "p_size as level", "p_brand as sheet"))


@query(f"with {IDENTIFIERS} select identifier, count(*) as n from index_ where chunk_id in (select l_partkey from lineitem where l_quantity > 45) group by 1")
def identifier_counts(spark, d):
    chosen = table(spark, d, "lineitem").filter("l_quantity > 45").select(F.col("l_partkey").alias("chunk_id"))
    return review.identifier_counts(retrieval.identifier_index(views.chunks(spark, d)), chosen)


@query("with c as (select distinct l_orderkey as page_id, l_partkey as chunk_id from lineitem), s as (select distinct l_orderkey as page_id, l_partkey + case when l_orderkey % 3 = 0 then 1000000 else 0 end as chunk_id from lineitem where l_orderkey % 5 <> 0) select distinct page_id from c where page_id not in (select c.page_id from c join s using (page_id, chunk_id))")
def pages_to_summarise(spark, d):
    lines = table(spark, d, "lineitem")
    cited = lines.filter("l_orderkey % 5 <> 0").selectExpr("l_orderkey as page_id", "l_partkey + if(l_orderkey % 3 = 0, 1000000, 0) as chunk_id")
    return review.pages_to_summarise(lines.selectExpr("l_orderkey as page_id", "l_partkey as chunk_id"), cited)


@query("select distinct l_orderkey, l_linenumber from lineitem where not (l_linestatus = 'F' and l_returnflag = 'A') and (l_orderkey, l_linenumber) not in (select (l_orderkey, l_linenumber) from lineitem where l_linestatus = 'F' and l_returnflag = 'A')")
def remaining_pages(spark, d):
    lines = table(spark, d, "lineitem")
    done = lines.filter("l_linestatus = 'F' and l_returnflag = 'A'")
    return review.remaining(lines.select("l_orderkey", "l_linenumber").distinct(), done, ["l_orderkey", "l_linenumber"])


@query("select event_id from events where event_id % 4 <> 2 or event_id % 4 is null or event_type = 'error'")
def stale_pages(spark, d):
    pages = table(spark, d, "events").selectExpr("event_id", "nullif(event_id % 4, 3) as region_version", "nullif(event_type, 'error') as title")
    return review.stale_pages(pages, 2).select("event_id")


@query("select l_orderkey as page_id, l_linenumber, l_partkey, l_suppkey from lineitem where l_linestatus <> 'F' and (l_suppkey % 5 = 0 or coalesce(nullif(l_returnflag, 'R'), 'unsorted') in ('A', 'unsorted'))")
def due_pages(spark, d):
    pages = table(spark, d, "lineitem").selectExpr("l_suppkey as project", "l_orderkey as page_id", "l_linenumber", "l_partkey", "nullif(l_returnflag, 'R') as discipline", "l_linestatus = 'F' as processed")
    projects = table(spark, d, "supplier").selectExpr("s_suppkey as project", "s_suppkey % 5 = 0 as process_all", "array('A', 'unsorted') as chosen")
    return review.due_pages(pages, projects).select("page_id", "l_linenumber", "l_partkey", F.col("project").alias("l_suppkey"))


@query("with m as (select event_id, case event_id % 5 when 0 then 'alpha' when 1 then 'alpha-batch' when 2 then 'alpha-2024' when 3 then 'beta-mini-batch' else 'other' end as model from events) select event_id, case model when 'alpha' then 3.0::double when 'alpha-batch' then 1.5 when 'alpha-2024' then 3.0 when 'beta-mini-batch' then 1.0 end as rate, case model when 'alpha' then 'exact' when 'alpha-batch' then 'exact' when 'other' then 'unknown' else 'family' end as confidence from m")
def family_rates(spark, d):
    models = table(spark, d, "events").selectExpr("event_id", "case event_id % 5 when 0 then 'alpha' when 1 then 'alpha-batch' when 2 then 'alpha-2024' when 3 then 'beta-mini-batch' else 'other' end as model")
    return review.family_rates(models, [("alpha", 3.0), ("beta", 1.0)]).select("event_id", "rate", "confidence")


@query("with r as (select l_partkey as case_id, l_suppkey % 5 as run, bool_or(l_returnflag = 'R') as hit from lineitem group by 1, 2) select case_id, count(*) as runs, count(*) filter (where hit) as hits, round(avg(case when hit then 1.0 else 0.0 end), 6) as share from r group by 1")
def repeat_table(spark, d):
    return review.repeat_table(table(spark, d, "lineitem").selectExpr("l_partkey as case_id", "l_suppkey % 5 as run", "l_returnflag = 'R' as hit"))


@query("select p_partkey, row_number() over (partition by p_partkey % 40 order by floor((p_partkey * 13 % 700) / 36.0), p_partkey * 7 % 300, p_partkey) as place from part")
def reading_order(spark, d):
    blocks = table(spark, d, "part").selectExpr("p_partkey % 40 as page", "p_partkey", "p_partkey as block_id", "p_partkey * 7 % 300 as x", "cast(p_partkey * 13 % 700 as double) as y")
    return review.reading_order(blocks, "page").select("p_partkey", F.col("place").cast("bigint").alias("place"))


BOXES = "b as (select p_partkey % 40 as page, p_partkey as id, cast(p_partkey * 7 % 300 as double) as x0, cast(p_partkey * 7 % 300 + 80 as double) as x1, cast(p_partkey * 13 % 700 as double) as y0, cast(p_partkey * 13 % 700 + 12 as double) as y1, p_partkey // 40 % 4 = 0 as heading from part)"


def _boxes(spark, d):
    return table(spark, d, "part").selectExpr("p_partkey % 40 as page", "p_partkey as id", "cast(p_partkey * 7 % 300 as double) as x0", "cast(p_partkey * 7 % 300 + 80 as double) as x1", "cast(p_partkey * 13 % 700 as double) as y0", "cast(p_partkey * 13 % 700 + 12 as double) as y1", "p_partkey div 40 % 4 = 0 as heading")


@query(f"with {BOXES} select h.page, h.id as heading_id, c.id as chunk_id from b h join b c on h.page = c.page and h.heading and not c.heading and c.y0 >= h.y1 and c.y0 - h.y1 <= 60 and c.x0 < h.x1 and h.x0 < c.x1")
def under_headings(spark, d):
    boxes = _boxes(spark, d)
    return review.under_headings(boxes.filter("heading").withColumnRenamed("id", "heading_id"), boxes.filter("not heading").withColumnRenamed("id", "chunk_id").drop("heading", "y1"), 60.0)


@query(f"with {BOXES}, j as (select h.page, h.id as mark_id, c.id as size_id, row_number() over (partition by h.page, h.id order by c.y0, c.id) as place from b h join b c on h.page = c.page and h.heading and not c.heading and c.y0 >= h.y1 and c.y0 - h.y1 <= 60 and c.x0 < h.x1 and h.x0 < c.x1) select page, mark_id, size_id from j where place = 1")
def nearest_below(spark, d):
    boxes = _boxes(spark, d)
    return review.nearest_below(boxes.filter("heading").withColumnRenamed("id", "mark_id"), boxes.filter("not heading").withColumnRenamed("id", "size_id"), 60.0)


@query("select l_orderkey as target, l_partkey as page_id, row_number() over (partition by l_orderkey order by max(case when l_returnflag = 'A' then 1 else 0 end) desc, max(case when l_linestatus = 'F' then 1 else 0 end) desc, max(nullif(l_linenumber, 3)) asc nulls last, l_partkey) as place from lineitem group by l_orderkey, l_partkey")
def best_matches(spark, d):
    pages = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("target"), F.col("l_partkey").alias("page_id")).agg(F.bool_or(F.col("l_returnflag") == "A").alias("has_grid"), F.bool_or(F.col("l_linestatus") == "F").alias("shares_scale"), F.max(F.expr("nullif(l_linenumber, 3)")).alias("page_number"))
    return review.best_matches(pages).select("target", "page_id", F.col("place").cast("bigint").alias("place"))
