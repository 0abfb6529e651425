"""Registered queries of boxes and wall lines: order lines as clouds, strokes, readings and walls of a page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import boxes
from ..sources.tables import table
from .alignment_queries import _numbered
from .queries import query

NUMBERED = "n as (select *, row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_extendedprice, l_quantity) as k from lineitem)"


@query(f"with {NUMBERED}, b as (select l_orderkey as page, k, 12.0::double * k + 100 * (k // 3) as x0, l_discount * 10 as y0, 12.0::double * k + 100 * (k // 3) + 8 as x1, l_discount * 10 + 6 + l_tax as y1 from n) select page, round(min(x0), 6) as x0, round(min(y0), 6) as y0, round(max(x1), 6) as x1, round(max(y1), 6) as y1, count(*) as n from b group by page, k // 3")
def merged_clouds(spark, d):
    """Clouds in a row, every third step a far one: neighbours become one."""
    left = F.col("k") * 12.0 + F.floor(F.col("k") / 3) * 100
    clouds = _numbered(spark, d, "l_discount", "l_tax").select(F.col("l_orderkey").alias("page"), "k", left.alias("x0"), (F.col("l_discount") * 10).alias("y0"), (left + 8).alias("x1"), (F.col("l_discount") * 10 + 6 + F.col("l_tax")).alias("y1"))
    return boxes.merged(clouds, "page", "k", 5.0).select("page", *[F.round(e, 6).alias(e) for e in boxes.EDGES], "n")


@query(f"""with recursive {NUMBERED}, s as (select l_orderkey as page, k, l_quantity * 4 as x0, l_partkey % 97 * 2.0::double as y0, l_quantity * 4 + 12 as x1, l_partkey % 97 * 2.0::double + 20 as y1 from n),
  links as (select a.page, a.k as a, b.k as b from s a join s b on a.page = b.page and abs(floor(a.x0 / 60) - floor(b.x0 / 60)) <= 1 and abs(floor(a.y0 / 60) - floor(b.y0 / 60)) <= 1 and greatest(a.x0 - b.x1, b.x0 - a.x1) <= 2 and greatest(a.y0 - b.y1, b.y0 - a.y1) <= 2),
  reach as (select page, k, k as other from s union select r.page, r.k, l.b from reach r join links l on l.page = r.page and l.a = r.other),
  root as (select page, k, min(other) as root from reach group by 1, 2)
  select page, min(x0) as x0, min(y0) as y0, max(x1) as x1, max(y1) as y1, count(*) as strokes from s join root using (page, k) group by page, root""")
def stroke_symbols(spark, d):
    strokes = table(spark, d, "lineitem").selectExpr("l_orderkey as page", "l_quantity * 4 as x0", "l_partkey % 97 * 2D as y0", "l_quantity * 4 + 12 as x1", "l_partkey % 97 * 2D + 20 as y1")
    return boxes.symbols(strokes, "page")


@query(f"with {NUMBERED} select l_orderkey as page, max(k) as id from n group by l_orderkey, k // 2")
def single_readings(spark, d):
    """Two readings of each spot, the second longer and wider."""
    left = F.floor(F.col("k") / 2) * 50.0
    lines = _numbered(spark, d).select(F.col("l_orderkey").alias("page"), F.col("k").alias("id"), F.expr("repeat('8', 1 + k)").alias("text"), F.lit(0.9).alias("confidence"), left.alias("x0"), F.lit(0.0).alias("y0"), (left + 20 + F.col("k")).alias("x1"), F.lit(10.0).alias("y1"))
    return boxes.without_repeats(lines, "page", "id").select("page", "id")


def _walls(spark, d):
    """Each order's lines as walls of two sheets: a third drawn alike, a third moved by a foot, a third missing."""
    lines = _numbered(spark, d).filter("k > 0")
    pos, run = F.col("k") * 50.0, F.col("l_quantity")
    wall = lambda side, moved, along: F.struct(F.concat(F.lit(side), F.col("l_orderkey").cast("string")).alias("sheet"), F.col("k").alias("wall_id"), (F.col("k") % 2 == 0).alias("horizontal"), (pos + moved).alias("pos"), (run + along).alias("lo"), (run + 100 + along).alias("hi"))
    drawn = F.array(wall("A", F.lit(0.0), 0), F.when(F.col("k") % 3 < 2, wall("B", 7 + F.when(F.col("k") % 3 == 1, 9.0).otherwise(0.0), 7)))
    walls = lines.select(F.explode(F.array_compact(drawn)).alias("w")).select("w.*")
    page = {f"{s}{e}": F.lit(v) for s in "ab" for e, v in zip(boxes.EDGES, (-1e4, -1e4, 1e4, 1e4), strict=True)}
    orders = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("window")).distinct()
    windows = orders.withColumns({"a_sheet": F.expr("concat('A', window)"), "b_sheet": F.expr("concat('B', window)"), **page, "scale": F.lit(1.0), "tx": F.lit(7.0), "ty": F.lit(7.0), "feet": F.lit(9.0)})
    return boxes.compared_lines(windows, walls)


@query(f"with {NUMBERED} select l_orderkey as window, count(*) as n_a, count(*) filter (where k % 3 < 2) as n_b, count(*) filter (where k % 3 = 0) as matched_a, count(*) filter (where k % 3 = 0) as matched_b from n group by 1")
def wall_matches(spark, d):
    return _walls(spark, d)[0]


@query(f"with {NUMBERED} select l_orderkey as window, k as wall, k % 2 = 0 as horizontal, 9.0::double as distance from n where k % 3 = 1")
def near_misses(spark, d):
    return _walls(spark, d)[1].select("window", F.col("a").alias("wall"), "horizontal", F.round("offset", 6).alias("distance"))
