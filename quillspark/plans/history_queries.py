"""Registered queries of evaluation over time: orders as scored runs, their lines as tags."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import evaluation
from ..sources.tables import table
from .queries import query

RUNS = """runs as (select o_orderkey as run_id, o_orderdate as ran_at, floor(o_totalprice)::bigint % 101 as pct, 'p' || o_custkey % 50 as project, nullif(o_orderpriority, '5-LOW') as label,
    case when o_orderkey % 4 = 0 then [] when o_orderkey % 4 = 1 then ['c' || o_custkey, 'c' || o_custkey % 7] else ['c' || o_custkey % 7, 'c' || o_custkey] end as ids from orders),
  keyed as (select *, case when len(ids) > 0 then sha256(array_to_string(list_sort(ids), ',')) else 'none:' || run_id end as corpus from runs),
  last as (select *, count(*) over (partition by corpus) as n_runs from keyed qualify row_number() over (partition by corpus order by ran_at desc, run_id desc) = 1)"""


def _runs(spark, d):
    ids = "case when o_orderkey % 4 = 0 then cast(array() as array<string>) when o_orderkey % 4 = 1 then array(concat('c', o_custkey), concat('c', o_custkey % 7)) else array(concat('c', o_custkey % 7), concat('c', o_custkey)) end as ids"
    return table(spark, d, "orders").selectExpr("o_orderkey as run_id", "o_orderdate as ran_at", "cast(floor(o_totalprice) as bigint) % 101 as pct", "concat('p', o_custkey % 50) as project", "nullif(o_orderpriority, '5-LOW') as label", ids)


@query(f"with {RUNS} select run_id, n_runs, len(ids) > 0 as described, pct, project, label from last")
def scored_corpora(spark, d):
    return evaluation.corpora(_runs(spark, d)).select("run_id", "n_runs", "described", "pct", "project", "label")


@query(f"with {RUNS} select corpus, arg_min(project, (ran_at, run_id)) as project, min(pct) as low, max(pct) as high, count(distinct pct) as n_scores from keyed where len(ids) > 0 group by 1 having count(distinct pct) > 1")
def rescored_corpora(spark, d):
    return evaluation.rescored(_runs(spark, d))


@query(f"""with {RUNS}, tags as (select l_orderkey as run_id, l_returnflag || l_linestatus as tag, max(l_quantity) as pct from lineitem group by 1, 2),
  per_tag as (select label, tag, max(t.pct) - min(t.pct) as apart from last join tags t using (run_id) where label is not null group by 1, 2 having count(*) > 1),
  whole as (select label, count(*) as n, min(pct) as low, max(pct) as high from last where label is not null group by 1 having count(*) > 1),
  worst as (select * from per_tag qualify row_number() over (partition by label order by apart desc, tag) = 1)
  select label, n, low, high, high - low as spread, tag as worst_tag, apart as worst_spread from whole left join worst using (label)""")
def repeated_experiments(spark, d):
    tags = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("run_id"), F.concat("l_returnflag", "l_linestatus").alias("tag")).agg(F.max("l_quantity").alias("pct"))
    return evaluation.repeats(_runs(spark, d), tags)
