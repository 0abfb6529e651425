"""Counts and sums over pages, runs and usage, and the joins that tie chunks to portions.

Every rollup is one grouped aggregation with partial sums before its shuffle. Rows with null keys form a group of
their own unless the docstring says otherwise; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

UNSORTED = "unsorted"
#: What a usage row's stage starts with where it is spent on a discipline.
PROCESS_STAGE = "process:"
PLAN_KINDS = ("plan", "enlarged_plan")


def processing_spend(usage: DataFrame) -> DataFrame:
    """project, discipline, cost_usd and tokens of the usage rows (project, stage, tokens, cost) of processing stages.

    Unknown costs count as nothing.
    """
    mine = usage.filter(F.col("stage").startswith(PROCESS_STAGE)).withColumn("discipline", F.substring("stage", len(PROCESS_STAGE) + 1, 1 << 20))
    return mine.groupBy("project", "discipline").agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_usd"), F.sum("tokens").alias("tokens"))


def processing_state(pages: DataFrame, projects: DataFrame, spend: DataFrame) -> DataFrame:
    """Per project and discipline: pages, how many are processed, whether it is chosen, and what it has cost so far.

    pages: project, discipline (null: unsorted), processed. projects: project, process_all, chosen (array); a project
    that isn't among them has nothing chosen.
    """
    counts = pages.groupBy("project", F.coalesce("discipline", F.lit(UNSORTED)).alias("discipline")).agg(F.count("*").alias("n_pages"), F.count_if("processed").alias("n_processed"))
    rows = counts.join(projects, "project", "left").join(spend, ["project", "discipline"], "left")
    chosen = F.coalesce(F.col("process_all") | F.array_contains("chosen", F.col("discipline")), F.lit(False))
    return rows.select("project", "discipline", "n_pages", "n_processed", chosen.alias("is_chosen"), F.coalesce("cost_usd", F.lit(0.0)).alias("cost_usd"), F.coalesce("tokens", F.lit(0)).alias("tokens"))


def project_disciplines(pages: DataFrame) -> DataFrame:
    """Per project and named discipline: sheets, and plans among those whose kind was read (null if none was)."""
    plans, read = F.count_if(F.col("sheet_kind").isin(*PLAN_KINDS)), F.count("sheet_kind")
    return pages.filter("discipline is not null").groupBy("project", "discipline").agg(F.count("*").alias("sheets"), F.when(read > 0, plans).alias("plans"))


def counts_by(rows: DataFrame, *keys: str) -> DataFrame:
    """How many rows each combination of keys has, as n."""
    return rows.groupBy(*keys).agg(F.count("*").alias("n"))


def portion_pages(portions: DataFrame, pages: DataFrame) -> DataFrame:
    """portion_id, page_id of the pages of live documents that carry a portion's discipline in its project."""
    return portions.join(pages.filter("superseded_at is null"), ["project", "discipline"]).select("portion_id", "page_id")


def assigned_portions(chunks: DataFrame, pages: DataFrame, portions: DataFrame) -> DataFrame:
    """chunks with portion_id anew: that of their page's discipline; the old one stays where there is none."""
    found = pages.join(portions.withColumnRenamed("portion_id", "found_"), ["project", "discipline"]).select("page_id", "found_")
    return chunks.join(found, "page_id", "left").withColumn("portion_id", F.coalesce("found_", "portion_id")).drop("found_")


def waiting_chunks(chunks: DataFrame, pages: DataFrame, portions: DataFrame) -> DataFrame:
    """Chunks without a vector with what goes beside it: page numbers, portion and both disciplines."""
    named = portions.select("portion_id", F.col("discipline").alias("portion_discipline"))
    rows = chunks.filter("embedding_id is null").join(pages, "page_id").join(named, "portion_id", "left")
    return rows.select("chunk_id", "page_id", "combined_page", "portion_id", "portion_discipline", F.col("discipline").alias("page_discipline"))


def set_cost(estimates: DataFrame, *keys: str) -> DataFrame:
    """low and high summed per key, null for both if any estimate lacks either."""
    known = F.count_if(F.col("low").isNotNull() & F.col("high").isNotNull()) == F.count("*")
    return estimates.groupBy(*keys).agg(F.when(known, F.sum("low")).alias("low"), F.when(known, F.sum("high")).alias("high"))


def symbol_range(symbols: DataFrame, *keys: str, least_strokes: int = 4, least_marks: int = 8, least_size: float = 6.0) -> DataFrame:
    """What stroke counts and sides the marked symbols of each key span, without the outer tenth at either end.

    symbols: strokes, width, height. Of n sorted values the one at floor(q * (n - 1)) counts: percentile_disc takes
    another place, so values are ranked. Keys with fewer than least_marks symbols, or only small ones, give no row.
    """
    sized = symbols.filter(F.col("strokes") >= least_strokes).withColumns({"long": F.greatest("width", "height"), "short": F.least("width", "height")})
    at = lambda c, q: F.element_at(F.array_sort(F.collect_list(c)), (F.floor(q * (F.count("*") - 1)) + 1).cast("int"))
    # one sheet's symbols of one family, bounded by what a page draws
    low = sized.groupBy(*keys).agg(F.count("*").alias("n"), *(at(c, q).cast("double").alias(f"{c}_{name}") for c in ("strokes", "long", "short") for name, q in (("low", 0.1), ("high", 0.9))))
    kept = low.filter((F.col("n") >= least_marks) & (F.col("long_low") >= least_size))
    return kept.select(
        *keys, F.col("strokes_low").alias("fewest"), (2.5 * F.col("strokes_high")).alias("most"), (0.8 * F.col("long_low")).alias("shortest_long"), (1.4 * F.col("long_high")).alias("longest_long"),
        F.greatest(F.lit(2.0), 0.8 * F.col("short_low")).alias("shortest_short"),
    )
