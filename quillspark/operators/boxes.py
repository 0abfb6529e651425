"""Boxes and lines of drawings: merging, removal of repeats, and wall lines of two sheets held against each other.

A page is the unit: its boxes are few enough for one task, and pages are many. Lines of two sheets meet in the order of
their places, never all pairs of a page.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The largest symbol and the gap within it (points), and the share of a reading that makes it a repeat.
SYMBOL, SYMBOL_GAP, REPEATED = 60.0, 2.0, 0.6
# Fixed values of wall lines: the same line (points, inches), a near miss (inches, feet), and shares of overlap.
SAME_POINTS, SAME_INCHES, NEAR_INCHES, NEAR_FEET = 0.75, 1.5, 3.0, 2.0
SAME_OVERLAP, NEAR_OVERLAP = 0.6, 0.8

#: Boxes of a page up to which pages of one size are merged together, and pairs of boxes that numpy takes at a time.
TOGETHER, BATCH_PAIRS = 32, 1_000_000

EDGES = ("x0", "y0", "x1", "y1")


def _per_page(boxes: DataFrame, page: str, key: str | None, work: Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]], counted: str) -> DataFrame:
    """page, x0, y0, x1, y1, counted: what work gives of the boxes of many pages (each page's in the order of key).

    A page is one row on the way; work takes a batch's boxes and their pages' numbers, in order, and gives boxes, a number
    each and their pages' numbers, so that many small pages cost little each.
    """
    box = F.array(*[F.col(e).cast("double") for e in EDGES])
    listed = F.transform(F.sort_array(F.collect_list(F.struct(F.col(key), box.alias("box")))), lambda x: x["box"]) if key else F.collect_list(box)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sizes = [len(flat) // 4 for flat in pdf["flat"]]
            if sum(sizes):
                found, numbers, at = work(np.concatenate(pdf["flat"].to_list()).astype(np.float64).reshape(-1, 4), np.repeat(np.arange(len(sizes)), sizes))
                out = pd.DataFrame(found, columns=list(EDGES))
                yield out.assign(**{page: pdf[page].to_numpy()[at], counted: numbers})[[page, *EDGES, counted]]

    kind = boxes.schema[page].dataType.simpleString()
    return boxes.groupBy(page).agg(F.flatten(listed).alias("flat")).mapInPandas(run, f"{page} {kind}, x0 double, y0 double, x1 double, y1 double, {counted} bigint")


def merged(boxes: DataFrame, page: str, key: str, gap: float, max_area: float | None = None) -> DataFrame:
    """page, x0, y0, x1, y1, n: boxes that touch or nearly touch become one, to a fixed point.

    Boxes are tried in the order of key, and a union starts the search anew; none grows beyond max_area. A grown box
    that only touches another on its edge doesn't meet it. Small pages of one size take their steps together.
    """

    def meeting(a: np.ndarray, out: np.ndarray) -> np.ndarray:
        meets = (np.minimum(a[..., 2] + gap, out[..., 2]) > np.maximum(a[..., 0] - gap, out[..., 0])) & (np.minimum(a[..., 3] + gap, out[..., 3]) > np.maximum(a[..., 1] - gap, out[..., 1]))
        if max_area is not None:
            meets &= (np.maximum(a[..., 2], out[..., 2]) - np.minimum(a[..., 0], out[..., 0])) * (np.maximum(a[..., 3], out[..., 3]) - np.minimum(a[..., 1], out[..., 1])) <= max_area
        return meets

    def union(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.concatenate([np.minimum(a[..., :2], b[..., :2]), np.maximum(a[..., 2:], b[..., 2:])], axis=-1)

    def one(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = np.ones(len(out), np.int64)
        i = 0
        while i < len(out):
            meets = meeting(out[i], out)
            meets[: i + 1] = False
            if meets.any():
                j = int(np.argmax(meets))
                out[i], count[i] = union(out[i], out[j]), count[i] + count[j]
                out, count, i = np.delete(out, j, axis=0), np.delete(count, j), 0
            else:
                i += 1
        return out, count

    def together(out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same for pages x boxes x edges: a box that is taken in counts 0."""
        n = out.shape[1]
        count, busy, later = np.ones(out.shape[:2], np.int64), np.arange(len(out)), np.triu(np.ones((n, n), bool), 1)
        while len(busy):
            now, live = out[busy], count[busy] > 0
            meets = meeting(now[:, :, None], now[:, None]) & later & live[:, :, None] & live[:, None]
            first = meets.reshape(len(busy), -1).argmax(axis=1)
            some = meets.reshape(len(busy), -1)[np.arange(len(busy)), first]
            busy, i, j = busy[some], first[some] // n, first[some] % n
            out[busy, i] = union(out[busy, i], out[busy, j])
            count[busy, i] += count[busy, j]
            count[busy, j] = 0
        return out, count

    def merge(r: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.flatnonzero(np.r_[True, at[1:] != at[:-1]])
        sizes, parts = np.diff(np.r_[starts, len(at)]), []
        for size in np.unique(sizes):
            own = starts[sizes == size]
            if size > TOGETHER:
                parts += [(*one(r[k : k + size]), at[k]) for k in own]
                continue
            for some in np.array_split(own, -(-len(own) * size * size // BATCH_PAIRS)):
                out, count = together(r[some[:, None] + np.arange(size)])
                parts.append((out[count > 0], count[count > 0], np.repeat(at[some], (count > 0).sum(axis=1))))
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.concatenate([np.broadcast_to(p[2], len(p[1])) for p in parts])

    return _per_page(boxes, page, key, merge, "n")


def symbols(strokes: DataFrame, page: str, gap: float = SYMBOL_GAP, cell: float = SYMBOL) -> DataFrame:
    """page, x0, y0, x1, y1, strokes: strokes within a gap of each other, however many steps it takes, are one symbol.

    Strokes are looked for in the cells around the one they start in: three runs of cells, each in one piece once strokes
    are sorted by page and cell.
    """

    def join(r: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        x, y = np.floor(r[:, :2] / cell).astype(np.int64).T
        order = np.lexsort((y, x, at))
        r, at, x, y = r[order], at[order], x[order], y[order]
        # cells as numbers that sort alike: what is next to each other within a page stays so, larger gaps are cut to three
        column = np.cumsum(np.r_[0, np.where(at[1:] != at[:-1], 3, np.minimum(np.diff(x), 3))])
        rows, row = np.unique(y, return_inverse=True)
        near = np.cumsum(np.r_[1, np.minimum(np.diff(rows), 3)])
        wide = int(near[-1]) + 2
        place = column * wide + near[row]
        root, pairs = np.arange(len(r)), []
        for dx in (-1, 0, 1):
            start, end = np.searchsorted(place, place + dx * wide - 1), np.searchsorted(place, place + dx * wide + 1, side="right")
            n = end - start
            # owners in runs of bounded numbers of candidates, one at least
            ends = np.cumsum(n)
            k = 0
            while k < len(r):
                to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + BATCH_PAIRS, side="right")))
                own = np.repeat(np.arange(k, to), n[k:to])
                other = np.arange(len(own)) - np.repeat(ends[k:to] - n[k:to] - (ends[k - 1] if k else 0), n[k:to]) + np.repeat(start[k:to], n[k:to])
                a, b = r[own], r[other]
                close = (np.maximum(b[:, 0] - a[:, 2], a[:, 0] - b[:, 2]) <= gap) & (np.maximum(b[:, 1] - a[:, 3], a[:, 1] - b[:, 3]) <= gap)
                pairs.append((own[close], other[close]))
                k = to
        a, b = np.concatenate([p[0] for p in pairs]), np.concatenate([p[1] for p in pairs])
        while True:
            before = root.copy()
            np.minimum.at(root, a, before[b])
            root = root[root]
            if (root == before).all():
                break
        first, group, count = np.unique(root, return_inverse=True, return_counts=True)
        out = r[first]
        np.minimum.at(out[:, :2], group, r[:, :2])
        np.maximum.at(out[:, 2:], group, r[:, 2:])
        return out, count, at[first]

    return _per_page(strokes, page, None, join, "strokes")


def without_repeats(lines: DataFrame, page: str, key: str, share: float = REPEATED) -> DataFrame:
    """Readings of one spot once: of two, one mostly inside the other, the longer stays, then the surer, then the first by key."""
    order = F.struct((-F.length("text")).alias("long"), (-F.col("confidence")).alias("sure"), F.col(key).alias("key"), *EDGES)
    listed = lines.groupBy(page).agg(F.sort_array(F.collect_list(order)).alias("xs"))

    def inside(a: Column, b: Column) -> Column:
        width = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
        height = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
        return width * height / F.greatest(F.lit(1e-6), (a["x1"] - a["x0"]) * (a["y1"] - a["y0"])) >= share

    kept = F.aggregate("xs", F.slice("xs", 1, 0), lambda out, x: F.when(F.exists(out, lambda o: inside(x, o)), out).otherwise(F.array_append(out, x)))
    return lines.join(listed.select(page, F.explode(kept).alias("x")).select(page, F.col("x.key").alias(key)), [page, key], "left_semi")


#: What a window's lines are told by once they are placed on its second sheet.
PLACED = ("p", "l", "h", "place", "feet")


def _runs(n: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Owners of n candidates each, in runs of at most that many candidates, or of one owner."""
    ends, k = np.cumsum(n), 0
    while k < len(n):
        to = max(k + 1, int(np.searchsorted(ends, (ends[k - 1] if k else 0) + most, side="right")))
        yield k, to
        k = to


def _met(rows: pa.RecordBatch) -> pa.RecordBatch:
    """What the lines of whole windows say: a row for each window. Lines meet in the order of their places."""
    names = rows["window"].dictionary_encode("encode")
    at, windows = names.indices.to_numpy().astype(np.int64), len(names.dictionary)
    first, there = (rows[c].to_numpy(zero_copy_only=False).astype(bool) for c in ("first", "there"))
    way = rows["way"].to_numpy().astype(np.int64)
    p, l, h, place, feet = (rows[c].to_numpy(zero_copy_only=False).astype(np.float64) for c in PLACED)
    same = np.fmax(SAME_POINTS, feet * (SAME_INCHES / 12))
    low, high = np.fmax(same, feet * (NEAR_INCHES / 12)), feet * NEAR_FEET
    rank = pc.rank(rows["wall_id"], null_placement="at_start", tiebreaker="dense").to_numpy().astype(np.int64)
    group = at * 2 + way
    line = group * (int(rank.max()) + 1) + rank
    a, b = (np.flatnonzero(there & side & (way < 2)) for side in (first, ~first))
    # a's reach, a bit wider than what is asked of a pair, among the places of b
    reach = np.fmax(same, high)[a] * (1 + 1e-9) + np.abs(p[a]) * 1e-12
    kind = np.repeat([0, 1, 2], [len(a), len(b), len(a)])
    order = np.lexsort((kind, np.r_[p[a] - reach, p[b], p[a] + reach], np.r_[group[a], group[b], group[a]]))
    seen = np.empty(len(order), np.int64)
    seen[order] = np.cumsum(kind[order] == 1)
    start, n = seen[: len(a)], seen[len(a) + len(b) :] - seen[: len(a)]
    near_by = b[order[kind[order] == 1] - len(a)]
    hit, twin = np.zeros(len(at), bool), np.full(len(at), -1)
    for k, to in _runs(n, BATCH_PAIRS):
        i = np.repeat(a[k:to], n[k:to])
        j = near_by[np.arange(len(i)) + np.repeat(start[k:to] - np.cumsum(n[k:to]) + n[k:to], n[k:to])]
        away, shared = np.abs(p[j] - p[i]), np.fmax(0.0, np.fmin(h[i], h[j]) - np.fmax(l[i], l[j]))
        exact = (away <= same[i]) & (shared >= SAME_OVERLAP * np.fmin(h[i] - l[i], h[j] - l[j]))
        hit[i[exact]] = hit[j[exact]] = True
        beside = np.flatnonzero((away >= low[i]) & (away <= high[i]) & (shared >= NEAR_OVERLAP * np.fmax(h[i] - l[i], h[j] - l[j])))
        beside = beside[np.lexsort((rank[j[beside]], away[beside], i[beside]))]
        best = beside[np.r_[True, np.diff(i[beside]) > 0][: len(beside)]]
        twin[i[best]] = j[best]
    # of lines with one id, the nearest twin; none if one of them has a partner
    own = a[(twin[a] >= 0) & ~np.isin(line[a], line[a][hit[a]])]
    own = own[np.lexsort((rank[twin[own]], np.abs(p[twin[own]] - p[own]), line[own]))]
    own = own[np.r_[True, np.diff(line[own]) > 0][: len(own)]]
    # the place of a line with a partner, whatever its direction
    spots = np.unique(place[b], return_inverse=True)[1]
    spot = np.zeros(len(at), np.int64)
    spot[b] = at[b] * (len(b) + 1) + spots
    own = own[~np.isin(spot[twin[own]], spot[b][hit[b]])]
    other = twin[own]

    count = lambda of: np.bincount(at[of], minlength=windows)
    once = lambda side: side[hit[side]][np.unique(line[side][hit[side]], return_index=True)[1]]
    near = pa.StructArray.from_arrays([rows["wall_id"].take(pa.array(own)), rows["wall_id"].take(pa.array(other)), pa.array(way[own] == 1), pa.array(p[other] - p[own])], names=["a", "b", "horizontal", "offset"])
    ends = np.r_[0, np.cumsum(count(own))].astype(np.int32)
    sums = [pa.array(count(of), pa.int64()) for of in (there & first, there & ~first, once(a), once(b))]
    return pa.RecordBatch.from_arrays([names.dictionary, *sums, pa.ListArray.from_arrays(ends, near)], names=["window", "n_a", "n_b", "matched_a", "matched_b", "near"])


def compared_lines(windows: DataFrame, walls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """What the wall lines of two sheets say about windows that show one area.

    windows: window, a_sheet, b_sheet, ax0 ... by1, scale, tx, ty (b = scale * a + t), feet (points a foot on b).
    walls: sheet, wall_id, horizontal, pos, lo, hi; a line is in a window if its middle is.
    First: window, n_a, n_b, matched_a, matched_b. Second, near misses: window, a, b, horizontal, offset: a line without
    a partner whose twin runs beside it, unless the twin's own line has a partner (the other face of a wall).
    Lines are shuffled twice, by sheet and by window, and never broadcast: lists of them look smaller than they are. Numpy
    takes the windows of a batch together, each whole.
    """
    side = lambda s: F.struct(F.lit(s == "a").alias("first"), F.col(f"{s}_sheet").alias("sheet"), *[F.col(f"{s}{e}").alias(e) for e in EDGES])
    sides = windows.select("window", F.explode(F.array(side("a"), side("b"))).alias("s"), "scale", "tx", "ty", "feet").select("window", "s.*", "scale", "tx", "ty", "feet")
    middle, level = (F.col("lo") + F.col("hi")) / 2, F.col("horizontal")
    across = F.when(level, F.col("pos").between(F.col("y0"), F.col("y1"))).otherwise(F.col("pos").between(F.col("x0"), F.col("x1")))
    along = F.when(level, middle.between(F.col("x0"), F.col("x1"))).otherwise(middle.between(F.col("y0"), F.col("y1")))
    held = sides.join(walls.withColumnRenamed("sheet", "of").hint("merge"), (F.col("sheet") == F.col("of")) & across & along, "left")
    shift, run = F.when(level, F.col("ty")).otherwise(F.col("tx")), F.when(level, F.col("tx")).otherwise(F.col("ty"))
    on_b = lambda c, t: F.when(F.col("first"), F.col(c) * F.col("scale") + t).otherwise(F.col(c))
    placed = (on_b("pos", shift), on_b("lo", run), on_b("hi", run), F.when(~F.col("first"), F.round("pos", 6)), F.col("feet"))
    # a line of unknown direction is counted and meets none
    rows = held.select("window", "first", F.col("of").isNotNull().alias("there"), F.coalesce(level.cast("int"), F.lit(2)).alias("way"), "wall_id", *[c.cast("double").alias(name) for c, name in zip(placed, PLACED, strict=True)])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
        open_rows: list[pa.RecordBatch] = []
        for batch in batches:
            if batch.num_rows:
                window = batch["window"].dictionary_encode("encode").indices.to_numpy()
                last = int(np.searchsorted(window, window[-1]))
                if last:
                    yield _met(whole([*open_rows, batch.slice(0, last)]))
                    open_rows = []
                open_rows.append(batch.slice(last))
        if open_rows:
            yield _met(whole(open_rows))

    window, wall = (f.schema[c].dataType.simpleString() for f, c in ((windows, "window"), (walls, "wall_id")))
    found = rows.repartition("window").sortWithinPartitions("window").mapInArrow(compare, f"window {window}, n_a bigint, n_b bigint, matched_a bigint, matched_b bigint, near array<struct<a:{wall},b:{wall},horizontal:boolean,offset:double>>")
    return found.drop("near"), found.select("window", F.explode("near").alias("n")).select("window", "n.*")
