"""Registered queries of whole pages' chunks, of replies read back and of what calls will cost."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import replies, text
from ..operators import pages
from ..sources.tables import table
from .queries import query


def _pages(spark, d):
    """Documents as pages: lines as blocks in three columns, and order lines as tables."""
    lines = table(spark, d, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", "\n")).alias("at", "text"))
    place = ("at % 3 * 320D as x0", "at div 3 * 40D as y0", "at % 3 * 320D + 250 as x1", "at div 3 * 40D + 20 + at % 2 * 15 as y1", "1000D as width", "1400D as height")
    blocks = lines.selectExpr("page", "cast(at as bigint) as block_id", *place, "text")
    cells = F.sort_array(F.collect_list(F.struct("l_linenumber", F.expr("array(concat('P', l_partkey), cast(l_quantity as string))").alias("r"))))
    listed = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("page")).agg(cells.alias("xs"))
    tables = listed.select("page", F.lit(1).cast("bigint").alias("table_id"), *[F.lit(float(v)).alias(c) for c, v in (("x0", 0), ("y0", 0), ("x1", 260), ("y1", 50))], F.transform("xs", lambda x: x["r"]).alias("rows"))
    return blocks, tables


@query()
def page_chunks(spark, d):
    return pages.page_chunks(*_pages(spark, d))


@query("""with t as (select l_orderkey as page, list('| P' || l_partkey || ' | ' || l_quantity || ' |' order by l_linenumber, 'P' || l_partkey, cast(l_quantity as varchar)) as xs from lineitem group by 1 having count(*) > 1)
  select page, 0 as piece, array_to_string(list_concat([xs[1], '| --- | --- |'], xs[2:]), '\n') as text from t""")
def page_tables(spark, d):
    return pages.table_chunks(_pages(spark, d)[1]).select("page", "piece", "text")


@query("""with a as (select p_partkey, p_partkey % 4 as position, 'S-' || p_size as sheet, 'structural' as discipline from part where p_partkey % 4 < 3
    union all select p_partkey, 1, null, null from part where p_partkey % 4 <> 1)
  select p_partkey, cast(position as int) as position, case when p_size % 2 = 0 then sheet end as sheet, case when p_size % 2 = 0 then discipline end as discipline from a join part using (p_partkey)""")
def sheet_batches(spark, d):
    first = "concat('{\"index\": ', p_partkey % 4 + 1, ', \"sheet_number\": \" s-', p_size, '\", \"prefix\": \"?\", \"confidence\": ', if(p_size % 2 = 0, 0.9, 0.1), '}')"
    raw = F.expr(f"concat('```json\n{{\"sheets\": [', {first}, ', {{\"index\": \"2\", \"sheet_number\": \"Q-1\", \"confidence\": 1}}, {{\"index\": \"two\"}}, {{\"index\": 9}}]}}\n```')")
    answers = table(spark, d, "part").select("p_partkey", F.explode(replies.sheet_answers(raw, F.lit(3))).alias("x"))
    return answers.select("p_partkey", "x.*").withColumn("discipline", F.lower("discipline"))


@query("""with t as (select l_suppkey as scan, count(*) as n, max(l_linenumber) * 10 as extra from lineitem group by 1), c as (select *, ceil(n * 0.05::double)::bigint as low, ceil(n * 0.35::double)::bigint as high from t)
  select scan, n as calls, 2 * n as images, n * (5500 + extra) as input, n * 700 as output, low as close_low, low * 5600 as close_input_low, low * 600 as close_output_low, high as close_high, high * 5600 as close_input_high, high * 600 as close_output_high from c""")
def look_estimates(spark, d):
    tiles = table(spark, d, "lineitem").groupBy(F.col("l_suppkey").alias("scan")).agg(F.count("*").alias("n"), (F.max("l_linenumber") * 10).alias("extra"))
    return tiles.select("scan", replies.look_estimate(F.col("n"), F.col("extra")).alias("x")).select("scan", "x.*")


@query("""with e as (select source, sum(greatest(1, length(coalesce(text, '')) // 4) + 40)::bigint as evidence, count(*) as chunks from documents group by 1), b as (select *, least(12, greatest(1, ceil(evidence / 97500.0::double)))::bigint as batches from e)
  select source, batches + 2 as calls, batches * 2500 + least(evidence, batches * 100000) + 2500 + 5000 * batches + chunks * 15 + 4500 + floor(evidence / 2.0::double + 0.5)::bigint as input, 5000 * batches + 4000 as output from b""")
def review_estimates(spark, d):
    tokens = text.approximate_tokens(F.coalesce("text", F.lit("")))
    scope = table(spark, d, "documents").groupBy("source").agg(F.sum(tokens + replies.CHUNK_OVERHEAD).alias("evidence"), F.count("*").alias("chunks"))
    return scope.select("source", replies.review_estimate(F.col("evidence"), F.col("chunks"), F.lit(4), 100_000, 12).alias("x")).select("source", "x.*")
