"""Deterministic checks over pages and chunks. Each gives findings with a fingerprint and a confidence."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

CONFIDENCE = ("high", "medium", "low")
# Markers of open items and their confidence.
OPEN_ITEMS = ((r"\bTBD\b", "high"), (r"\bTO BE (?:CONFIRMED|DETERMINED)\b", "high"), (r"\?\?+", "medium"), (r"\bVERIFY\b", "low"))


def confidence_rank(c: Column) -> Column:
    """high before medium before low, not alphabetical."""
    return F.array_position(F.array(*map(F.lit, CONFIDENCE)), c)


def dangling_references(references: DataFrame, issued: DataFrame) -> DataFrame:
    """References (page_id, sheet) to sheets that aren't issued but have the shape of one that is.

    Needs two issued sheets at least; a reference of a shape that no issued sheet has is another kind of label.
    """
    known = issued.select(text.normalize(F.col("sheet")).alias("sheet")).distinct()
    shapes = known.select(text.shape(F.col("sheet")).alias("shape")).filter("shape is not null").groupBy("shape").agg(F.count("*").alias("n_shape"))
    wanted = references.select("page_id", text.normalize(F.col("sheet")).alias("sheet")).distinct()
    missing = wanted.join(known, "sheet", "left_anti").withColumn("shape", text.shape(F.col("sheet"))).join(shapes, "shape")
    found = missing.groupBy("sheet").agg(F.count("*").alias("n_pages"), F.min("page_id").alias("first_page"), F.max("n_shape").alias("n_shape"))
    return found.select("sheet", "n_pages", "first_page", F.when(F.col("n_shape") >= 2, "high").otherwise("low").alias("confidence"), text.fingerprint(F.lit("dangling_reference"), F.col("sheet")).alias("fingerprint"))


def tag_value_conflicts(ratings: DataFrame) -> DataFrame:
    """Tags with two values or more of one unit on two sheets or more; high if some value stands on two sheets."""
    per_value = ratings.groupBy("tag", "unit", F.round("value", 3).alias("value")).agg(F.countDistinct("sheet").alias("sheets"))
    sheets = ratings.groupBy("tag", "unit").agg(F.countDistinct("sheet").alias("n_sheets"))
    per_tag = per_value.groupBy("tag", "unit").agg(F.count("*").alias("n_values"), F.min("value").alias("low"), F.max("value").alias("high"), F.max("sheets").alias("most"))
    found = per_tag.join(sheets, ["tag", "unit"]).filter("n_values >= 2 and n_sheets >= 2")
    return found.select("tag", "unit", "n_values", "n_sheets", "low", "high", F.when(F.col("most") >= 2, "high").otherwise("medium").alias("confidence"))


def open_items(chunks: DataFrame) -> DataFrame:
    """Notes with an open-item marker, grouped by their normalised text: pages, and the strongest confidence."""
    strength = F.least(*[F.when(F.upper("text").rlike(p), CONFIDENCE.index(c) + 1) for p, c in OPEN_ITEMS])
    marked = chunks.withColumn("strength", strength).filter("strength is not null")
    quote = F.trim(F.regexp_replace(F.upper("text"), r"\s+", " "))
    grouped = marked.groupBy(quote.alias("quote")).agg(F.min("strength").alias("strength"), F.countDistinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))
    return grouped.select("quote", "n_pages", "first_page", F.element_at(F.array(*map(F.lit, CONFIDENCE)), F.col("strength")).alias("confidence"))


def unscheduled_marks(marks: DataFrame, scheduled: DataFrame) -> DataFrame:
    """Marks on plans that their family's schedule lacks; families without a schedule are not judged."""
    families = scheduled.select("family").distinct()
    judged = marks.join(families, "family", "left_semi")
    return judged.join(scheduled.select("family", "mark").distinct(), ["family", "mark"], "left_anti").groupBy("family", "mark").agg(F.countDistinct("page_id").alias("n_pages"), F.min("page_id").alias("first_page"))


def missing_levels(plans: DataFrame, least: int = 3) -> DataFrame:
    """Levels inside a series' range that it lacks while a sibling series of its discipline has them."""
    series = plans.groupBy("discipline", "series").agg(F.min("level").alias("low"), F.max("level").alias("high"), F.collect_set("level").alias("have"))
    open_ = series.filter((F.size("have") >= least) & (F.col("high") - F.col("low") > 1))
    gap = open_.select("discipline", "series", F.explode(F.array_except(F.sequence(F.col("low") + 1, F.col("high") - 1), F.col("have"))).alias("level"))
    siblings = series.filter(F.size("have") >= least).select("discipline", F.col("series").alias("sibling"), F.explode("have").alias("level"))
    # siblings per level are few: counted before the join, so that no pair of series is made
    counts = siblings.groupBy("discipline", "level").agg(F.count("*").alias("n_siblings"))
    found = gap.join(counts, ["discipline", "level"])
    return found.select("discipline", "series", "level", "n_siblings", F.when(F.col("n_siblings") >= 2, "high").otherwise("medium").alias("confidence"))


def value_conflicts(readings: DataFrame) -> DataFrame:
    """Element and field with different values from different sources: the pair of extremes."""
    return readings.groupBy("element", "field").agg(F.countDistinct("value").alias("n_values"), F.countDistinct("source").alias("n_sources"), F.min("value").alias("low"), F.max("value").alias("high")).filter("n_values >= 2 and n_sources >= 2")


def without_dismissed(findings: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings that neither an item rule nor a family rule covers."""
    items = rules.filter("key is not null").select("check_type", "key").distinct()
    families = rules.filter("key is null and family is not null").select("check_type", "family").distinct()
    family = F.regexp_extract("key", "^([A-Z]+)", 1)
    return findings.withColumn("family", family).join(items, ["check_type", "key"], "left_anti").join(families, ["check_type", "family"], "left_anti")


def outcomes(catalogue: DataFrame, found: DataFrame, ran: DataFrame) -> DataFrame:
    """Exactly one outcome for every question: issue, clear or not_run."""
    issues = found.groupBy("question").agg(F.count("*").alias("n"))
    done = ran.select("question").distinct().withColumn("ran", F.lit(True))
    joined = catalogue.join(issues, "question", "left").join(done, "question", "left")
    return joined.select("question", F.when(F.col("n") > 0, "issue").when(F.col("ran"), "clear").otherwise("not_run").alias("outcome"), F.coalesce("n", F.lit(0)).alias("n"))


def strongest(findings: DataFrame, most: int = 100) -> DataFrame:
    w = Window.partitionBy("check_type").orderBy(confidence_rank(F.col("confidence")), "fingerprint")
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
