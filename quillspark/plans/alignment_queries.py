"""Registered queries of drawings laid over each other: orders as pairs of sheets, their lines as grid lines and as elements."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import alignment
from ..sources.tables import table
from .queries import query


def _numbered(spark, d, *more):
    """Lines with their number k in the order, and further columns."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice", "l_quantity", *more)
    return lines.withColumn("k", F.row_number().over(Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_extendedprice", "l_quantity")))


@query("""with n as (select l_orderkey, count(*) as n from lineitem group by 1)
  select l_orderkey as project, 2 * l_orderkey as a_id, 2 * l_orderkey + 1 as b_id, n as shared, '3=X' as renamed, 'numbered' as word, case when n - 1 >= 4 then 'medium' else 'low' end as confidence from n where n >= 4""")
def renamed_grids(spark, d):
    """Each order's grid on two sheets, shifted; the third line has another name on one of them."""
    lines = _numbered(spark, d)
    at = F.col("k") * F.col("k") * 20.0
    grid = lambda shift, label: F.sort_array(F.collect_list(F.struct((at + shift).alias("position"), label.alias("label"))))
    name = F.col("k").cast("string")
    both = lines.groupBy("l_orderkey").agg(grid(F.lit(0.0), name).alias("a"), grid(7.5 + F.col("l_orderkey") % 5, F.when(F.col("k") == 3, "X").otherwise(name)).alias("b"))
    side = lambda c, own, discipline: both.select(F.col("l_orderkey").alias("project"), (2 * F.col("l_orderkey") + own).alias("system_id"), F.lit(own).alias("page_id"), F.lit("solid").alias("style"), F.lit(discipline).alias("discipline"), F.lit("plan").alias("kind"), F.array(F.lit(9.0)).alias("scales"), F.lit("x").alias("axis"), F.col(c).alias("lines"))
    found = alignment.grid_mismatches(side("a", 0, "architectural").unionByName(side("b", 1, "structural")))
    return found.select("project", "a_id", "b_id", "shared", F.array_join(F.transform("renamed", lambda p: F.concat(p["a"], F.lit("="), p["b"])), ",").alias("renamed"), "word", "confidence")


def _plans(spark, d):
    """Each order's elements on two sheets at half the scale, all of different sizes; one of them lacks, resizes or moves an element."""
    size, half = F.lit(20.0) * F.pow(F.lit(1.4), F.col("k")), F.lit(0.5)
    places = _numbered(spark, d).select("l_orderkey", F.col("k").alias("element_id"), F.lit(1).alias("detail"), (F.col("l_extendedprice") % 5000).alias("cx"), (F.col("l_partkey") * 37 % 3000).cast("double").alias("cy"), size.alias("w"), size.alias("h"))
    odd = F.col("element_id") == 2
    on_b = {
        "cx": F.col("cx") * half + 7.25, "cy": F.col("cy") * half - 3.5 + F.when(odd & (F.col("l_orderkey") % 3 == 2), 20.0).otherwise(0.0), "w": F.col("w") * half * F.when(odd & (F.col("l_orderkey") % 3 == 1), 2.0).otherwise(1.0), "h": F.col("h") * half,
    }
    sheet = lambda s, sides: F.struct(F.concat(F.lit(s), F.col("l_orderkey").cast("string")).alias("sheet"), *[c.alias(name) for name, c in sides.items()])
    # both sheets from one row, so that lines are numbered once
    drawn = F.array(sheet("A", {c: F.col(c) for c in on_b}), F.when(~(odd & (F.col("l_orderkey") % 3 == 0)), sheet("B", on_b)))
    elements = places.select("element_id", "detail", F.explode(drawn).alias("e")).filter("e is not null").select("e.sheet", "element_id", "detail", *[f"e.{c}" for c in on_b])
    pairs = table(spark, d, "lineitem").select("l_orderkey").distinct().selectExpr("l_orderkey as pair", "concat('A', l_orderkey) as a_sheet", "concat('B', l_orderkey) as b_sheet", "0.5D as scale", "4.5D as tolerance")
    return pairs, elements


@query("select l_orderkey as pair, 7.25::double as tx, (-3.5)::double as ty, count(*) - 1 as inliers from lineitem group by 1 having count(*) >= 4")
def aligned_plans(spark, d):
    found = alignment.align_plans(*_plans(spark, d))
    return found.select("pair", F.round("tx", 6).alias("tx"), F.round("ty", 6).alias("ty"), F.size("inliers").alias("inliers"))


@query("select l_orderkey as pair, (['only_a', 'size', 'moved'])[l_orderkey % 3 + 1] as kind, 2 as a, case when l_orderkey % 3 > 0 then 2 end as b, case when l_orderkey % 3 = 2 then 20.0::double end as distance from lineitem group by 1 having count(*) >= 4")
def plan_differences(spark, d):
    found = alignment.differing_plans(*_plans(spark, d), 54.0)
    return found.select("pair", "kind", "a", "b", F.round("offset", 6).alias("distance"))


@query("""select l_orderkey as pair, k::varchar as first, (k + 1)::varchar as second, case when k = 2 then 9.0::double else -9.0::double end as diff from (select l_orderkey from lineitem where l_orderkey % 3 = 0 group by 1 having count(*) >= 6), (values (2), (3)) as v(k)""")
def bay_differences(spark, d):
    """Each order's grid on two sheets at half the scale; every third one's third line stands a foot further."""
    lines = _numbered(spark, d)
    label, at = F.col("k").cast("string"), F.col("k") * 540.0
    grid = lambda position: F.sort_array(F.collect_list(F.struct(position.alias("position"), label.alias("label"))))
    moved = F.when((F.col("k") == 3) & (F.col("l_orderkey") % 3 == 0), 9.0).otherwise(0.0)
    both = lines.groupBy("l_orderkey").agg(grid(at).alias("a"), grid(at / 2 + 31.5 + moved).alias("b"))
    found = both.select(F.col("l_orderkey").alias("pair"), F.explode(alignment.bay_differences(F.col("a"), F.col("b"), F.lit(0.5), F.lit(31.5), F.lit(9.0))).alias("x"))
    return found.select("pair", "x.first", "x.second", F.round("x.diff", 6).alias("diff"))
