"""Summaries rolled up a tree of tiers: pages to sections, sections to larger ones, until each portion has one, then projects.

Every node folds at most FAN nodes below it, so no task ever gathers a portion, however many pages it has: there are as
many tiers as powers of FAN in the longest one. A page's place in its portion is numbered once, in two levels; a node's
place at tier k is that place divided by FAN^k. Tiers are written one by one, and a run that finds a tier written goes
on from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import numbering

# Nodes that one node folds, items and characters that it keeps.
FAN, ITEMS, CHARACTERS = 10, 8, 1500
#: Pages between two steps of the coarse order by which places are numbered.
COARSE = 1_000

ITEM = "array<struct<text:string,chunk_ids:array<string>,page:bigint>>"


def resolved(summaries: DataFrame, chunk_pages: DataFrame, key: str) -> DataFrame:
    """summaries (key, items, ...) with the items that a page can be named for: chunk ids that exist and their first page.

    An item none of whose chunks exists keeps the page it came with; without one it goes.
    """
    items = summaries.select(key, F.posexplode("items").alias("place", "item"))
    ids = items.select(key, "place", F.posexplode("item.chunk_ids").alias("_nth", "chunk_id")).join(chunk_pages, "chunk_id")
    known = ids.groupBy(key, "place").agg(F.transform(F.sort_array(F.collect_list(F.struct("_nth", "chunk_id"))), lambda x: x["chunk_id"]).alias("ids"), F.min("page").alias("first"))
    rows = items.join(known, [key, "place"], "left").withColumn("page", F.coalesce("first", "item.page")).filter("page is not null")
    item = F.struct("place", F.struct(F.col("item.text").alias("text"), F.coalesce("ids", F.array().cast("array<string>")).alias("chunk_ids"), F.col("page").cast("bigint").alias("page")).alias("item"))
    kept = rows.groupBy(key).agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["item"]).alias("items"))
    return summaries.drop("items").join(kept, key, "left").withColumn("items", F.coalesce("items", F.array().cast(ITEM)))


def cut(joined: Column) -> Column:
    """What a node keeps of a joined text: CHARACTERS of it and one more, a dot if anything but blanks follows them.

    So the blanks at the end of the whole text are told from blanks at the cut, however many tiers are above.
    """
    return F.when(F.length(F.rtrim(joined)) > CHARACTERS, F.concat(F.left(joined, F.lit(CHARACTERS)), F.lit("."))).otherwise(F.left(joined, F.lit(CHARACTERS + 1)))


def finished(nodes: DataFrame) -> DataFrame:
    """Root nodes with the overview that they tell: without the blanks at its end, then CHARACTERS of it."""
    return nodes.withColumn("overview", F.left(F.rtrim("overview"), F.lit(CHARACTERS))).drop("at")


def folded(nodes: DataFrame, *keys: str) -> DataFrame:
    """One node for each combination of keys (with `at` among them): overviews in order, `cut` at CHARACTERS, items up to ITEMS.

    nodes: keys, below (order), start_page, end_page, overview, items. A node without either isn't written.
    """
    listed = nodes.groupBy(*keys).agg(F.min("start_page").alias("start_page"), F.max("end_page").alias("end_page"), F.sort_array(F.collect_list(F.struct("below", "overview", "items"))).alias("xs"))
    told = F.filter(F.transform("xs", lambda x: x["overview"]), lambda o: F.coalesce(o, F.lit("")) != "")
    overview = cut(F.array_join(told, " "))
    items = F.slice(F.flatten(F.transform("xs", lambda x: F.coalesce(x["items"], F.array().cast(ITEM)))), 1, ITEMS)
    return listed.select(*keys, "start_page", "end_page", overview.alias("overview"), items.alias("items")).filter((F.col("overview") != "") | (F.size("items") > 0))


def _written(spark: SparkSession, path: str) -> bool:
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def _tier(df: DataFrame | None, spark: SparkSession, path: str) -> DataFrame:
    """The table at path, written first if it isn't there yet."""
    if not _written(spark, path):
        df.write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def _tree(nodes: DataFrame, keys: list[str], root: str, name: str) -> DataFrame:
    """Folds nodes (keys, at, ...) tier by tier until each combination of keys has one."""
    spark, k = nodes.sparkSession, 0
    nodes = _tier(nodes, spark, f"{root}/{name}-0")
    while (nodes.agg(F.max("at")).first()[0] or 0) > 0:
        k += 1
        above = nodes.withColumn("below", F.col("at")).withColumn("at", F.floor(F.col("at") / FAN))
        nodes = _tier(folded(above, *keys, "at"), spark, f"{root}/{name}-{k}")
    return nodes


def rolled_up(pages: DataFrame, root: str) -> tuple[DataFrame, DataFrame]:
    """Of page summaries (project, portion, page, overview, items) those of portions and of projects, kept under root.

    Portions of a project are taken in the order of their names. Null portions are portions like others.
    """
    name = F.to_json(F.struct("project", "portion"))
    numbered = numbering.running(pages.withColumn("portion_key", name), "portion_key", F.floor(F.col("page") / COARSE), ["page", "overview"])
    base = numbered.select("project", "portion", F.col("before").cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("below"), F.col("page").alias("start_page"), F.col("page").alias("end_page"), F.trim("overview").alias("overview"), "items")
    portions = finished(_tree(folded(base, "project", "portion", "at"), ["project", "portion"], root, "portion"))

    named = portions.withColumn("_name", F.coalesce(F.col("portion").cast("string"), F.lit("")))
    placed = numbering.running(named, "project", F.left("_name", F.lit(2)), ["_name"])
    nodes = placed.select("project", F.col("before").cast("bigint").alias("at"), F.lit(0).cast("bigint").alias("below"), "start_page", "end_page", "overview", "items")
    projects = finished(_tree(folded(nodes, "project", "at"), ["project"], root, "project"))
    return portions, projects
