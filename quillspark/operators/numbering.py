"""Ordered-sequence operators: page numbering, ranges, gaps, fills and batches.

One project or queue may hold a third of all rows. Running sums and fills are
therefore taken in two levels: within (key, coarse), where coarse is an
expression that grows with the order (a month, a thousand ids), and over one
row per (key, coarse). No task gets all rows of a key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _joined(rows: DataFrame, groups: DataFrame, key: str) -> DataFrame:
    """rows with the other columns of groups, one row per (key, _coarse); null keys are keys like others."""
    other = groups.withColumnsRenamed({key: "_key", "_coarse": "_group"})
    return rows.join(other, F.col(key).eqNullSafe(F.col("_key")) & F.col("_coarse").eqNullSafe(F.col("_group"))).drop("_key", "_group")


def running(rows: DataFrame, key: str, coarse: Column, order: list[str], value: Column | None = None) -> DataFrame:
    """rows with before: the sum of value (default: the number) of the key's rows that come earlier in the order.

    coarse must not fall along the order. The result is that of one window per key; rows with a null key are one more.
    """
    rows = rows.withColumn("_coarse", coarse).withColumn("_value", F.lit(1) if value is None else value)
    totals = rows.groupBy(key, "_coarse").agg(F.sum("_value").alias("_total"))
    base = totals.withColumn("_base", F.sum("_total").over(Window.partitionBy(key).orderBy("_coarse")) - F.col("_total")).drop("_total")
    inner = Window.partitionBy(key, "_coarse").orderBy(*order)
    within = rows.withColumn("_within", F.sum("_value").over(inner.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_value"))
    return _joined(within, base, key).withColumn("before", (F.col("_base") + F.col("_within")).cast("bigint")).drop("_coarse", "_value", "_base", "_within")


def offsets(documents: DataFrame, project: str, coarse: Column, order: list[str]) -> DataFrame:
    """documents with offset: the pages of the project's documents before each. Superseded ones take no numbers."""
    live = documents.filter("superseded_at is null") if "superseded_at" in documents.columns else documents
    return running(live, project, coarse, order, F.col("pages")).withColumnRenamed("before", "offset")


def manifest(documents: DataFrame, project: str, key: str, coarse: Column, order: list[str]) -> DataFrame:
    """One row per page: project, document, page number and combined number."""
    numbered = offsets(documents, project, coarse, order).filter("pages > 0")
    return numbered.select(project, key, "offset", F.explode(F.sequence(F.lit(1), F.col("pages").cast("int"))).alias("page_number")).select(
        project, key, "page_number", (F.col("offset") + F.col("page_number")).alias("combined_page")
    )


def lookup(documents: DataFrame, wanted: DataFrame, project: str, key: str, coarse: Column, order: list[str]) -> DataFrame:
    """wanted (project, combined_page) with the document and page that carry that number."""
    numbered = offsets(documents, project, coarse, order).select(project, key, "offset", "pages")
    inside = (F.col("combined_page") > F.col("offset")) & (F.col("combined_page") <= F.col("offset") + F.col("pages"))
    return wanted.join(numbered, project).filter(inside).select(project, "combined_page", key, (F.col("combined_page") - F.col("offset")).cast("int").alias("page_number"))


def disagreements(stored: DataFrame, rule: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose stored combined_page differs from the rule's, nulls being equal."""
    both = stored.select(*keys, F.col("combined_page").alias("stored")).join(rule.select(*keys, F.col("combined_page").alias("expected")), keys, "left")
    return both.filter(~F.col("stored").eqNullSafe(F.col("expected")))


def ranges(rows: DataFrame, key: str, number: str) -> DataFrame:
    """Maximal runs of consecutive numbers per key: first, last, n."""
    distinct = rows.select(key, number).distinct()
    island = distinct.withColumn("island", F.col(number) - F.row_number().over(Window.partitionBy(key).orderBy(number)))
    return island.groupBy(key, "island").agg(F.min(number).alias("first"), F.max(number).alias("last"), F.count("*").alias("n")).drop("island")


def gaps(rows: DataFrame, key: str, number: str, least: int = 3) -> DataFrame:
    """Numbers strictly between a series' smallest and largest that it lacks, of series with at least `least` numbers."""
    series = rows.groupBy(key).agg(F.min(number).alias("low"), F.max(number).alias("high"), F.collect_set(number).alias("have"))
    inner = series.filter((F.size("have") >= least) & (F.col("high") - F.col("low") > 1))
    return inner.select(key, F.explode(F.array_except(F.sequence(F.col("low") + 1, F.col("high") - 1), F.col("have"))).alias("missing"))


def filled(rows: DataFrame, key: str, coarse: Column, order: list[str], value: str, default: str = "unclassified") -> DataFrame:
    """value carried forward, then backward over a leading run; default where a key has none."""
    rows = rows.withColumn("_coarse", coarse)
    inner = Window.partitionBy(key, "_coarse").orderBy(*order)
    near = rows.withColumn("_last", F.last(value, True).over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    at = F.when(F.col(value).isNotNull(), F.struct(*order))
    ends = rows.groupBy(key, "_coarse").agg(F.max_by(value, at).alias("_end"), F.min_by(value, at).alias("_start"))
    outer = Window.partitionBy(key).orderBy("_coarse")
    ends = ends.select(
        key, "_coarse", F.last("_end", True).over(outer.rowsBetween(Window.unboundedPreceding, -1)).alias("_earlier"),
        F.first("_start", True).over(outer.rowsBetween(0, Window.unboundedFollowing)).alias("_later"),
    )
    return _joined(near, ends, key).withColumn("filled", F.coalesce("_last", "_earlier", "_later", F.lit(default))).drop("_coarse", "_last", "_earlier", "_later")


def batches(rows: DataFrame, key: str, coarse: Column, order: list[str], size: int = 10) -> DataFrame:
    """section: consecutive rows of a key in groups of size."""
    return running(rows, key, coarse, order).withColumn("section", F.expr(f"before div {size}")).drop("before")


def stride_sample(rows: DataFrame, key: str, coarse: Column, order: list[str], count: int) -> DataFrame:
    """Every (n / count)-th row of a key, the first `count` of them."""
    steps = rows.groupBy(key).agg(F.greatest(F.lit(1), F.floor(F.count("*") / max(1, count))).alias("_step"))
    numbered = running(rows, key, coarse, order).join(steps, key)
    return numbered.filter((F.col("before") % F.col("_step") == 0) & (F.col("before") / F.col("_step") < count)).drop("before", "_step")


def queue_place(jobs: DataFrame, queue: str, coarse: Column, order: list[str]) -> DataFrame:
    """ahead: waiting jobs of the queue that came earlier."""
    return running(jobs, queue, coarse, order).withColumnRenamed("before", "ahead")


def percentiles(rows: DataFrame, key: str, value: str, coarse: Column, shares: tuple[float, ...] = (0.5, 0.95, 0.99)) -> DataFrame:
    """Exact interpolated percentiles per key, from running counts of its distinct values. Null values don't count."""
    counts = rows.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    totals = counts.groupBy(key).agg(F.sum("n").alias("total"))
    placed = running(counts, key, coarse, [value], F.col("n")).join(totals, key)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("before") <= place) & (place < F.col("before") + F.col("n")), F.col(value)))

    def share(p: float) -> Column:
        place = (F.col("total") - 1) * F.lit(p)
        low, high = at(F.floor(place)), at(F.ceil(place))
        return F.round(low + (high - low) * F.max(place - F.floor(place)), 6).alias(f"p{round(100 * p)}")

    return placed.groupBy(key).agg(*map(share, shares), F.max("total").alias("n"))


def spacing(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Median of the gaps between neighbouring positions per key; 0 with fewer than two."""
    gap = F.lead(position).over(Window.partitionBy(key).orderBy(position)) - F.col(position)
    return rows.select(key, position).distinct().withColumn("gap", gap).groupBy(key).agg(F.coalesce(F.median("gap"), F.lit(0.0)).alias("spacing"))


def capped(findings: DataFrame, check: str, rank: str, key: str, most: int = 100) -> DataFrame:
    """The strongest `most` findings of each check: rank first, then key."""
    w = Window.partitionBy(check).orderBy(rank, key)
    return findings.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= most)
