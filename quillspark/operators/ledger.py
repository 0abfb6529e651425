"""Usage ledger: rates, costs and rollups of token events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

CACHE_READ, CACHE_WRITE, BATCH = 0.1, 1.25, 0.5


def rated(events: DataFrame, rates: DataFrame) -> DataFrame:
    """events with rate_in and rate_out (USD per million tokens): exact model, or half of it with `-batch`; else null.

    The optimizer broadcasts rates, a price list, if its size allows.
    """
    plain = F.regexp_replace("model", "-batch$", "")
    half = F.when(F.col("model").endswith("-batch"), BATCH).otherwise(1.0)
    prices = rates.select(F.col("model").alias("plain"), "rate_in", "rate_out")
    out = events.withColumn("plain", plain).join(prices, "plain", "left").drop("plain")
    return out.withColumn("rate_in", F.col("rate_in") * half).withColumn("rate_out", F.col("rate_out") * half)


def cost() -> Column:
    """USD of a row: cached reads at a tenth, cache writes at five quarters of the input rate; null without a price."""
    given = F.col("input_tokens") + F.col("cache_read") * CACHE_READ + F.col("cache_write") * CACHE_WRITE
    return (given * F.col("rate_in") + F.col("output_tokens") * F.col("rate_out")) / 1e6


def by_model(events: DataFrame) -> DataFrame:
    """Counts, token sums and cost per model; an unknown price leaves the cost null."""
    sums = [F.sum(c).cast("bigint").alias(c) for c in ("input_tokens", "output_tokens", "cache_read", "cache_write")]
    return events.groupBy("model").agg(F.count("*").alias("n"), *sums, F.round(F.sum("cost"), 6).alias("cost"))


def rollup(events: DataFrame) -> DataFrame:
    """One pass for five groupings: all, by kind, by model, by project and by UTC day."""
    sets = [[], ["kind"], ["model"], ["project"], ["day"]]
    grouped = events.groupingSets([[F.col(c) for c in s] for s in sets], "kind", "model", "project", "day")
    return grouped.agg(F.sum("tokens").cast("bigint").alias("tokens"), F.count("*").alias("n"))


def dense_days(events: DataFrame, first: str, days: int) -> DataFrame:
    """One row per calendar day, days without events as zeros."""
    spark = events.sparkSession
    calendar = spark.range(days).select(F.date_add(F.lit(first).cast("date"), F.col("id").cast("int")).alias("day"))
    per_day = events.groupBy("day").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("n"))
    return calendar.join(per_day, "day", "left").select("day", F.coalesce("tokens", F.lit(0)).cast("bigint").alias("tokens"), F.coalesce("n", F.lit(0)).alias("n"))


def spent(events: DataFrame, key: str) -> DataFrame:
    """Cost per key, null as soon as one of its rows has no price."""
    known = F.count("cost") == F.count("*")
    return events.groupBy(key).agg(F.when(known, F.round(F.sum("cost"), 6)).alias("cost"), F.count("*").alias("n"), F.count_if(F.col("cost").isNull()).alias("n_unpriced"))


def summary_estimate(portions: DataFrame) -> DataFrame:
    """Calls of a page-section-portion rollup: sections only beyond 10 pages; the page tier halves from 4 calls on when batched."""
    pages = F.col("pages")
    sections = F.when(pages > 10, F.ceil(pages / 10)).otherwise(0)
    price = F.when(pages >= 4, pages * BATCH).otherwise(pages.cast("double"))
    return portions.withColumn("section_calls", sections.cast("bigint")).withColumn("page_units", price).withColumn("calls", (pages + F.col("section_calls") + 1).cast("bigint"))
