"""Work lists, reuse, estimates and page geometry of a review run."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Pairs of a heading and a chunk in one band that one task joins, about.
PAIRS = 1_000_000


def level_index(sources: DataFrame) -> DataFrame:
    """Per project and level: the number of different sheets that print it, and the first."""
    return sources.groupBy("project", "level").agg(F.countDistinct("sheet").alias("n_sheets"), F.min("sheet").alias("first_sheet"))


def identifier_counts(index: DataFrame, chosen: DataFrame) -> DataFrame:
    """Mentions of each identifier in the chosen chunks, added up by normal form."""
    inside = index.join(chosen.select("chunk_id").distinct(), "chunk_id", "left_semi").groupBy("identifier").agg(F.count("*").alias("n"))
    return inside.groupBy(F.regexp_replace(F.upper("identifier"), "[^A-Z0-9]", "").alias("identifier")).agg(F.sum("n").cast("bigint").alias("n"))


def pages_to_summarise(chunks: DataFrame, cited: DataFrame) -> DataFrame:
    """Pages with chunks that were never summarised, or none of whose cited chunks is left.

    chunks: page_id, chunk_id. cited: page_id, chunk_id of the stored summary.
    """
    pages = chunks.select("page_id").distinct()
    alive = cited.join(chunks.select("page_id", "chunk_id"), ["page_id", "chunk_id"], "left_semi").select("page_id").distinct()
    return pages.join(alive, "page_id", "left_anti")


def remaining(expected: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Expected work without what is done: what a resumed run still has to do."""
    return expected.join(done.select(*keys).distinct(), keys, "left_anti")


def stale_pages(pages: DataFrame, version: int) -> DataFrame:
    """Pages whose region was read by another version, or whose title was never read (null, not blank)."""
    return pages.filter(~F.col("region_version").eqNullSafe(F.lit(version)) | F.col("title").isNull())


def due_pages(pages: DataFrame, projects: DataFrame) -> DataFrame:
    """Pages not fully processed whose discipline (unsorted where unknown) is chosen, or whose project takes all."""
    joined = pages.join(projects, "project")
    return joined.filter(~F.col("processed") & (F.col("process_all") | F.array_contains("chosen", F.coalesce("discipline", F.lit("unsorted"))))).select(*pages.columns)


def family_rates(models: DataFrame, families: list[tuple[str, float]]) -> DataFrame:
    """models (model) with rate and confidence: exact, else half for -batch, else the first family named in it, else none."""
    plain = F.regexp_replace("model", "-batch$", "")
    exact = family = F.lit(None).cast("double")
    for name, rate in reversed(families):
        exact = F.when(plain == name, rate).otherwise(exact)
        family = F.when(F.contains("model", F.lit(name)), rate).otherwise(family)
    half = F.when(F.col("model").endswith("-batch"), 0.5).otherwise(1.0)
    confidence = F.when(exact.isNotNull(), "exact").when(family.isNotNull(), "family").otherwise("unknown")
    return models.withColumn("rate", F.coalesce(exact * half, family)).withColumn("confidence", confidence)


def repeat_table(runs: DataFrame) -> DataFrame:
    """Per case: runs, runs that hit it, and the share."""
    per_run = runs.groupBy("case_id", "run").agg(F.bool_or("hit").alias("hit"))
    return per_run.groupBy("case_id").agg(F.count("*").alias("runs"), F.count_if("hit").alias("hits"), F.round(F.avg(F.col("hit").cast("int")), 6).alias("share"))


def reading_order(blocks: DataFrame, page: str, band: float = 36.0) -> DataFrame:
    """blocks (page, block_id, x, y) with place: bands from the top, then from the left."""
    w = Window.partitionBy(page).orderBy(F.floor(F.col("y") / band), "x", "block_id")
    return blocks.withColumn("place", F.row_number().over(w))


def under_headings(headings: DataFrame, chunks: DataFrame, gap: float, pairs: int = PAIRS) -> DataFrame:
    """Chunks that start within gap below a heading and overlap it in x. Rows meet by page and band of height gap."""
    h = headings.select("page", "heading_id", F.col("x0").alias("hx0"), F.col("x1").alias("hx1"), F.col("y1").alias("hy"), F.explode(F.array(F.floor(F.col("y1") / gap), F.floor(F.col("y1") / gap) + 1)).alias("band"))
    c = chunks.withColumn("band", F.floor(F.col("y0") / gap))
    # a band's pairs are dealt over tasks: chunks by their hash, headings repeated
    n = lambda df, name: df.groupBy("page", "band").agg(F.count("*").alias(name))
    counts = n(h, "n").join(n(c, "m"), ["page", "band"])
    tasks = (counts.agg(F.sum(F.col("n") * F.col("m"))).first()[0] or 0) // pairs + headings.sparkSession.sparkContext.defaultParallelism
    dealt, met = counts.select("page", "band", F.ceil(F.col("n") * F.col("m") / pairs).alias("parts")), ["page", "band", "part"]
    few = h.join(dealt, ["page", "band"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("parts") - 1))).drop("parts")
    many = c.join(dealt, ["page", "band"]).withColumn("part", F.pmod(F.xxhash64("chunk_id"), F.col("parts"))).drop("parts")
    hits = few.repartition(tasks, *met).join(many.repartition(tasks, *met), met).filter("y0 >= hy and x0 < hx1 and hx0 < x1").filter(F.col("y0") - F.col("hy") <= gap)
    return hits.select("page", "heading_id", "chunk_id")


def nearest_below(marks: DataFrame, sizes: DataFrame, gap: float) -> DataFrame:
    """Each mark with the nearest size line below it within gap that overlaps it in x.

    Marks of one place share their answer, and of size lines of one place only the smallest id can be one: places meet.
    """
    places = marks.groupBy("page", "x0", "x1", "y1").agg(F.min("mark_id").alias("heading_id"))
    lines = sizes.groupBy("page", "x0", "x1", "y0").agg(F.min("size_id").alias("chunk_id"))
    placed = under_headings(places, lines, gap).join(lines.select("page", "chunk_id", "y0"), ["page", "chunk_id"])
    found = placed.groupBy("page", "heading_id").agg(F.min(F.struct("y0", "chunk_id")).alias("s")).join(places, ["page", "heading_id"])
    each = marks.select("page", "mark_id", "x0", "x1", "y1").join(found.drop("heading_id"), ["page", "x0", "x1", "y1"])
    return each.groupBy("page", "mark_id").agg(F.min("s").alias("s")).select("page", "mark_id", F.col("s.chunk_id").alias("size_id"))


def best_matches(pages: DataFrame) -> DataFrame:
    """Sheets of a target's level in the order of use: draws a grid, then shares a scale, then page order with nulls last."""
    w = Window.partitionBy("target").orderBy(F.desc("has_grid"), F.desc("shares_scale"), F.asc_nulls_last("page_number"), "page_id")
    return pages.withColumn("place", F.row_number().over(w))
