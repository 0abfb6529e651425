"""Cutting texts into chunks: word windows, ordered packing and box clusters.

Windows are built from built-in functions. The greedy folds and the union-find,
whose next step depends on the one before, run along sorted partitions, batch by batch.
"""

from __future__ import annotations

import os
import pickle
import tempfile
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text

WINDOW_WORDS = int(text.MAX_TOKENS / text.TOKENS_PER_WORD)
STEP_WORDS = WINDOW_WORDS - int(text.OVERLAP_TOKENS / text.TOKENS_PER_WORD)
TARGET_TOKENS = 400
#: Boxes beyond which a page is one cluster (a fixed value), or where it is to be grouped whole its rows wait in a file.
PAGE_BOXES = 4000


def word_windows(docs: DataFrame, key: str, body: str = "text", window: int = WINDOW_WORDS, step: int = STEP_WORDS) -> DataFrame:
    """key, piece (from 0), text, n_words, tokens. The last window is the first that reaches the end."""
    words = docs.select(key, text.words(F.col(body)).alias("words")).filter(F.size("words") > 0)
    last = F.greatest(F.lit(0), F.ceil((F.size("words") - window) / step)).cast("int")
    cut = words.select(key, "words", F.explode(F.sequence(F.lit(0), last)).alias("piece"))
    part = F.slice("words", F.col("piece") * step + 1, F.lit(window))
    out = cut.select(key, "piece", F.array_join(part, " ").alias("text"), F.size(part).alias("n_words"))
    return out.withColumn("tokens", text.estimated_tokens(F.col("text")))


def packed(blocks: DataFrame, key: str, order: str, most: int = text.MAX_TOKENS, target: int = TARGET_TOKENS) -> DataFrame:
    """blocks (key, order, tokens) with chunk: closed when the next block would exceed `most` and `target` is reached.

    The fold runs along sorted partitions, batch by batch, so that a long key costs time but no memory.
    """

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, chunk, size = None, 0, 0
        for pdf in batches:
            out = []
            for name, tokens in zip(pdf[key], pdf["tokens"], strict=True):
                if name != current:
                    current, chunk, size = name, 0, 0
                elif size + tokens > most and size >= target:
                    chunk, size = chunk + 1, 0
                size += tokens
                out.append(chunk)
            yield pdf.assign(chunk=out)

    schema = blocks.withColumn("chunk", F.lit(0)).schema
    return blocks.repartition(key).sortWithinPartitions(key, order).mapInPandas(fold, schema)


class Near:
    """The clusters of a page's boxes, which are added in the order of x0: two join when their gap is at most `reach` on both axes.

    Of the boxes that may meet later ones only the furthest to the right is kept over each stretch of y: boxes that share a
    stretch are joined already. So a box costs a search and the stretches that it meets, however many boxes are beside it.
    Boxes whose y isn't in order or isn't known have no stretch and are compared one by one.
    """

    def __init__(self, reach: float):
        self.reach, self.parent, self.least = reach, [], []
        self.right, self.low, self.high = array("d"), array("d"), array("d")
        self.odd: list[int] = []
        self.lows, self.highs, self.rights, self.boxes = [], [], [], []  # the stretches, in the order of y

    def root(self, i: int) -> int:
        parent = self.parent
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    def join(self, i: int, j: int) -> None:
        i, j = self.root(i), self.root(j)
        if i != j:
            self.parent[i] = j
            self.least[j] = min(self.least[i], self.least[j])

    def add(self, x0: float, y0: float, x1: float, y1: float, name: object) -> None:
        i, reach = len(self.parent), self.reach
        self.parent.append(i)
        self.least.append(name)
        if y0 <= y1:
            for j in self.odd:
                if self.right[j] + reach >= x0 and not self.low[j] - y1 > reach and not y0 - self.high[j] > reach:
                    self.join(j, i)
            self._meet(i, x0, y0, x1, y1)
        else:
            right, low, high = map(np.array, (self.right, self.low, self.high))
            for j in np.flatnonzero((right + reach >= x0) & ~(low - y1 > reach) & ~(y0 - high > reach)).tolist():
                self.join(j, i)
            self.odd.append(i)
        self.right.append(x1)
        self.low.append(y0)
        self.high.append(y1)

    def _meet(self, i: int, x0: float, y0: float, x1: float, y1: float) -> None:
        reach, kept, start = self.reach, [], y0
        open_ = x1 + reach >= x0  # whether a part of it is still to be placed
        at = bisect_left(self.highs, y0 - reach)
        while at and y0 - self.highs[at - 1] <= reach:
            at -= 1
        end = at
        while end < len(self.lows) and self.lows[end] - y1 <= reach:
            low, high, right, box = self.lows[end], self.highs[end], self.rights[end], self.boxes[end]
            end += 1
            if not right + reach >= x0:
                continue
            if y0 - high <= reach:
                self.join(box, i)
            if not open_ or high < y0:
                kept.append((low, high, right, box))
            elif low > y1:
                kept += [(start, y1, x1, i), (low, high, right, box)]
                open_ = False
            elif right >= x1:
                kept += [(start, low, x1, i)] * (start < low) + [(low, high, right, box)]
                start, open_ = max(start, high), high < y1
            else:
                kept += [(low, y0, right, box)] * (low < y0)
                if high > y1:
                    kept += [(start, y1, x1, i), (y1, high, right, box)]
                    open_ = False
        if open_:
            kept.append((start, y1, x1, i))
        for k, column in enumerate((self.lows, self.highs, self.rights, self.boxes)):
            column[at:end] = [x[k] for x in kept]

    def found(self) -> list:
        """Of each box, as they were added, the smallest name in its cluster."""
        return [self.least[self.root(i)] for i in range(len(self.parent))]


class Waiting:
    """A page's rows in a file of the task's own until all of its boxes are known."""

    def __init__(self, near: Near):
        self.near, self.parts = near, 0
        self.file = tempfile.TemporaryFile(dir=os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None)  # noqa: SIM115

    def add(self, rows: pd.DataFrame) -> None:
        pickle.dump(rows, self.file)
        self.parts += 1

    def rows(self) -> Iterator[pd.DataFrame]:
        found, at = self.near.found(), 0
        self.file.seek(0)
        for _ in range(self.parts):
            rows = pickle.load(self.file)  # noqa: S301
            yield rows.assign(cluster=pd.Series(found[at : at + len(rows)], index=rows.index, dtype=rows["cluster"].dtype))
            at += len(rows)
        self.file.close()


def clusters(boxes: DataFrame, page: str, least_gap: float = 18.0, share: float = 0.02, box_id: str = "box_id", whole: bool = False) -> DataFrame:
    """boxes (page, box_id, x0, y0, x1, y1, width, height) with cluster: its smallest box_id.

    Two boxes join when their gap is at most max(18, 2 % of the page's short side, if known) on both axes; a sweep over x
    finds them. A page of more than PAGE_BOXES boxes is one cluster and its rows pass by, unless the `whole` pages are to
    be grouped, however many boxes they have. One page is held at a time; of one beyond PAGE_BOXES the boxes alone.
    """

    def near(row) -> Near:
        short = min(row.width, row.height)
        return Near(max(least_gap, share * short) if short > 0 else least_gap)

    def joined(found: Near, rows: pd.DataFrame) -> Near:
        for x0, y0, x1, y1, name in zip(*[rows[c].tolist() for c in ("x0", "y0", "x1", "y1", box_id)], strict=True):
            found.add(x0, y0, x1, y1, name)
        return found

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = waiting = None  # the rows of a page that goes on in the next batch
        for batch in batches:
            pdf = batch if held is None else pd.concat([held, batch], ignore_index=True)
            names, sizes = pdf[page].to_numpy(), pdf["_boxes"].tolist()
            starts = [0, *(np.flatnonzero(names[1:] != names[:-1]) + 1).tolist()] if len(pdf) else []
            if starts and starts[-1] + sizes[-1] > len(pdf) and sizes[-1] <= most:
                held, pdf = pdf.iloc[starts[-1] :], pdf.iloc[: starts[-1]]
                starts.pop()
            else:
                held = None
            pdf = pdf.drop(columns="_boxes")
            found, out = pdf["cluster"].tolist(), np.ones(len(pdf), bool)
            for low, high in pairwise([*starts, len(pdf)]):
                rows = pdf.iloc[low:high]
                if 1 < sizes[low] <= most:
                    found[low:high] = joined(near(rows.iloc[0]), rows).found()
                elif sizes[low] > 1 and whole:
                    waiting = waiting or Waiting(near(rows.iloc[0]))
                    waiting.add(rows)
                    out[low:high] = False
                    if len(joined(waiting.near, rows).parent) == sizes[low]:
                        yield from waiting.rows()
                        waiting = None
            yield pdf.assign(cluster=pd.Series(found, index=pdf.index, dtype=pdf["cluster"].dtype))[out]

    # one shuffle: a page's rows lie together, by x, and each knows how many they are
    w, most = Window.partitionBy(page), PAGE_BOXES
    counted = boxes.filter(F.col(page).isNotNull()).repartition(page).withColumn("_boxes", F.count("*").over(w)).withColumn("cluster", F.min(box_id).over(w))
    ordered = counted.sortWithinPartitions(page, F.col("x0").asc_nulls_last(), box_id)
    return ordered.mapInPandas(run, counted.drop("_boxes").schema)
