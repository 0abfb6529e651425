"""Page groups: portions by discipline, rollups, sheet maps and status."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def portions(pages: DataFrame) -> DataFrame:
    """Per project and discipline: first and last combined page and the number of pages."""
    return pages.groupBy("project", "discipline").agg(F.min("combined_page").alias("start_page"), F.max("combined_page").alias("end_page"), F.count("*").alias("page_count"))


def stale(before: DataFrame, after: DataFrame) -> DataFrame:
    """Portions whose set of pages changed between the two: compared by count and an order-free hash."""
    def sets(pages: DataFrame, suffix: str) -> DataFrame:
        pages = pages.select("project", "discipline", "page_id").distinct()
        return pages.groupBy("project", "discipline").agg(F.count("*").alias(f"n_{suffix}"), F.bit_xor(F.xxhash64("page_id")).alias(f"h_{suffix}"))

    both = sets(before, "before").join(sets(after, "after"), ["project", "discipline"], "full_outer")
    same = F.col("n_before").eqNullSafe(F.col("n_after")) & F.col("h_before").eqNullSafe(F.col("h_after"))
    return both.filter(~same).select("project", "discipline", F.coalesce("n_before", F.lit(0)).alias("n_before"), F.coalesce("n_after", F.lit(0)).alias("n_after"))


def worst_status(documents: DataFrame) -> DataFrame:
    """Per project: failed if any is, else processing if any is, else completed; empty without documents' status."""
    has = lambda s: F.bool_or(F.col("status") == s)
    status = F.when(has("failed"), "failed").when(has("processing"), "processing").when(has("completed"), "completed").otherwise("empty")
    return documents.groupBy("project").agg(status.alias("status"), F.count("*").alias("n"))


def sheet_map(pages: DataFrame) -> DataFrame:
    """Edges of a project's sheets: references that resolve, and those that don't, by normalised sheet key.

    pages: project, page_id, sheet, refs array<string>.
    """
    key = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    nodes = pages.groupBy("project", key(F.col("sheet")).alias("key")).agg(F.min("page_id").alias("target"))
    edges = pages.select("project", F.col("page_id").alias("source"), key(F.col("sheet")).alias("own"), F.explode("refs").alias("ref")).select("project", "source", "own", key(F.col("ref")).alias("key")).filter("own <> key").distinct()
    return edges.join(nodes, ["project", "key"], "left").select("project", "source", "key", "target", F.col("target").isNull().alias("missing"))


def referenced_by(edges: DataFrame) -> DataFrame:
    """Inverse edges: how many pages refer to each sheet."""
    return edges.filter("target is not null").groupBy("project", F.col("target").alias("page_id")).agg(F.countDistinct("source").alias("n_references"))


def merged_summaries(lower: DataFrame, keys: list[str], most_chars: int = 1500, most_items: int = 20) -> DataFrame:
    """The deterministic rollup: overviews in order joined up to a length, items in order up to a number.

    lower: keys, at (order), overview, items array<string>. Null overviews and items count as none. One portion may
    hold a third of all rows: rows that start beyond both bounds are dropped, first within what the portion has in one
    input partition (what comes before a row there does so in the portion too), then within the portion. What is
    collected is at most most_chars + most_items + 2 rows, each cut to what the result can hold. An overview that
    starts right behind the last character still gives the blank before it.
    """
    rows = lower.select(*keys, "at", "overview", F.coalesce("items", F.array().cast("array<string>")).alias("items"), F.spark_partition_id().alias("_part"))

    def placed(rows: DataFrame, *group: str) -> DataFrame:
        """rows with _chars and _n, the characters and items before each, less those that start beyond both bounds."""
        w = Window.partitionBy(*group).orderBy("at", "overview", "items")
        before = lambda c: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumns({"_chars": before(F.length("overview") + 1), "_n": before(F.size("items")), "_first": F.row_number().over(w) == 1})
        told = F.col("overview").isNotNull() & (F.col("_chars") <= most_chars)
        return rows.filter(F.col("_first") | told | (F.size("items") > 0) & (F.col("_n") < most_items))

    near = placed(placed(rows, *keys, "_part").drop("_chars", "_n", "_first"), *keys)
    overview = F.when(F.col("_chars") <= most_chars, F.substring("overview", 1, most_chars))
    items = F.when(F.col("_n") < most_items, F.slice("items", 1, most_items)).otherwise(F.array().cast("array<string>"))
    # each row but one without overview and items adds to one of the two sums, so they give the order
    joined = near.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("_chars", "_n", overview.alias("overview"), items.alias("items")))).alias("rows"))
    overview = F.substring(F.array_join(F.transform("rows", lambda r: r["overview"]), " "), 1, most_chars)
    return joined.select(*keys, overview.alias("overview"), F.slice(F.flatten(F.transform("rows", lambda r: r["items"])), 1, most_items).alias("items"))
