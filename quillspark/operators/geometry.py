"""Geometry over rows of coordinates: alignment by voting, nearest matches and tilings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Differences of positions that numpy takes at a time.
DIFFERENCES = 200_000


def axes(marks: DataFrame, page: str, line: str, tolerance: float, least: int) -> DataFrame:
    """marks with axis: chains of marks whose `line` follows within tolerance; chains under `least` marks go."""
    w = Window.partitionBy(page).orderBy(line, "mark_id")
    new = (F.coalesce(F.col(line) - F.lag(line).over(w), F.lit(tolerance + 1)) > tolerance).cast("int")
    chained = marks.withColumn("new", new).withColumn("axis", F.sum("new").over(w)).drop("new")
    return chained.withColumn("n", F.count("*").over(Window.partitionBy(page, "axis"))).filter(F.col("n") >= least)


def vote_shift(a: DataFrame, b: DataFrame, pair: str, tolerance: float, least: int = 3, margin: int = 1) -> DataFrame:
    """The shift per pair of sheets that most position differences agree on.

    A difference votes for its bin and both neighbours; the winner needs `least` votes and `margin` more than the best
    bin that isn't next to it. a and b: pair, position. A sheet has tens of lines, so a pair has few differences: a pair
    is one row on the way, and differences and votes never leave it.
    """

    def chosen(at: np.ndarray, d: np.ndarray) -> tuple[np.ndarray, ...]:
        """Pairs (numbers, ascending), the shift, votes and second most votes of each, from all differences of some pairs."""
        bins = (np.rint(d / tolerance).astype(np.int64)[:, None] + np.array([-1, 0, 1])).ravel()
        at, d = np.repeat(at, 3), np.repeat(d, 3)
        order = np.lexsort((bins, at))
        at, bins, d = at[order], bins[order], d[order]
        first = np.flatnonzero(np.r_[True, (at[1:] != at[:-1]) | (bins[1:] != bins[:-1])])
        votes = np.diff(np.r_[first, len(at)])
        at, bins, shift = at[first], bins[first], np.add.reduceat(d, first) / votes
        order = np.lexsort((bins, -votes, at))
        best = order[np.r_[True, at[order][1:] != at[order][:-1]]]
        pairs, own = np.unique(at, return_inverse=True)
        second = np.zeros(len(pairs), np.int64)
        np.maximum.at(second, own, np.where(np.abs(bins - bins[best][own]) > 2, votes, 0))
        return pairs, shift[best], votes[best], second

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = np.cumsum([len(x) * len(y) for x, y in zip(pdf["pa"], pdf["pb"], strict=True)])
            low = 0
            while low < len(pdf):
                # pairs up to so many differences, one at least
                high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + DIFFERENCES, side="right")))
                each = [np.subtract.outer(y, x).ravel() for x, y in zip(pdf["pa"][low:high], pdf["pb"][low:high], strict=True)]
                pairs, shift, votes, second = chosen(np.repeat(np.arange(low, high), [len(x) for x in each]), np.concatenate(each))
                yield pd.DataFrame({pair: pdf[pair].to_numpy()[pairs], "shift": shift, "most": votes, "second": second})
                low = high

    listed = lambda df, name: df.groupBy(pair).agg(F.collect_list(F.col("position").cast("double")).alias(name)).filter(F.size(name) > 0)
    voted = listed(a, "pa").join(listed(b, "pb"), pair).mapInPandas(run, f"`{pair}` {a.schema[pair].dataType.simpleString()}, shift double, most bigint, second bigint")
    return voted.filter((F.col("most") >= least) & (F.col("most") >= F.col("second") + margin)).select(pair, F.round("shift", 6).alias("shift"), F.col("most").alias("votes"), "second")


def nearest(points: DataFrame, targets: DataFrame, page: str, reach: float) -> DataFrame:
    """points (page, point_id, x, y) with the nearest target within reach, or null: a range join over grid cells.

    A target is dealt to the nine cells around it, so that each point meets only targets of its own cell. Points of one
    place share their answer, and of targets of one place only the smallest id can be one: places meet, not rows.
    """
    cell = lambda c: F.floor(F.col(c) / reach)
    p = points.select(page, "x", "y").distinct().withColumn("cx", cell("x")).withColumn("cy", cell("y"))
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.lit(j).alias("j")) for i in (-1, 0, 1) for j in (-1, 0, 1)]))
    places = targets.groupBy(page, F.col("x").alias("tx"), F.col("y").alias("ty")).agg(F.min("target_id").alias("target_id"))
    t = places.select(page, "target_id", "tx", "ty", around.alias("o")).withColumn("cx", F.floor(F.col("tx") / reach) + F.col("o.i")).withColumn("cy", F.floor(F.col("ty") / reach) + F.col("o.j"))
    distance = F.sqrt((F.col("x") - F.col("tx")) ** 2 + (F.col("y") - F.col("ty")) ** 2)
    hits = p.join(t, [page, "cx", "cy"]).withColumn("distance", distance).filter(F.col("distance") <= reach)
    best = hits.groupBy(page, "x", "y").agg(F.min(F.struct("distance", "target_id")).alias("b"))
    return points.join(best, [page, "x", "y"], "left").select(*points.columns, F.col("b.target_id").alias("target_id"), F.round("b.distance", 6).alias("distance"))


def unmatched(points: DataFrame, targets: DataFrame, page: str, reach: float) -> DataFrame:
    """Points without a target within reach."""
    return nearest(points, targets, page, reach).filter("target_id is null").drop("target_id", "distance")


def windows(areas: DataFrame, size: float, overlap: float) -> DataFrame:
    """Windows of one extent, evenly spaced with the last on its end: n = ceil(extent / (size * (1 - overlap)))."""
    n = F.greatest(F.lit(1), F.when(F.col("extent") <= size, 1).otherwise(F.ceil(F.col("extent") / (size * (1 - overlap))))).cast("int")
    cut = areas.withColumn("n", n).select("*", F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("k"))
    step = F.when(F.col("n") > 1, (F.col("extent") - size) / (F.col("n") - 1)).otherwise(0.0)
    return cut.select(*areas.columns, "k", F.round(F.col("k") * step, 6).alias("low"), F.round(F.least(F.col("extent"), F.col("k") * step + size), 6).alias("high"))


def rotated(boxes: DataFrame) -> DataFrame:
    """Boxes (x, y, w, h on a page of page_w x page_h) as displayed under a rotation of 0, 90, 180 or 270 degrees."""
    r, x, y, w, h, pw, ph = (F.col(c) for c in ("rotation", "x", "y", "w", "h", "page_w", "page_h"))
    turned = r.isin(90, 270)
    dx = F.when(r == 90, ph - y - h).when(r == 180, pw - x - w).when(r == 270, y).otherwise(x)
    dy = F.when(r == 90, x).when(r == 180, ph - y - h).when(r == 270, pw - x - w).otherwise(y)
    return boxes.select("*", dx.alias("dx"), dy.alias("dy"), F.when(turned, h).otherwise(w).alias("dw"), F.when(turned, w).otherwise(h).alias("dh"))
