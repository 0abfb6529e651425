"""Benchmark decontamination with suffix arrays over the training text.

Each task turns a shard of documents into word numbers of the benchmark's own
vocabulary, keeps the stretches whose neighbouring words also stand next to each
other in the benchmark (no window can lie outside them), and sorts all suffixes
of these stretches by prefix doubling. Every suffix of the benchmark is then
searched in the shard's suffix array, all at once and word by word: two bisections narrow its
range, so that its longest verbatim match and all places of its window are
known. Words inside a place of a window are hit.

The benchmark is read and broadcast in blocks of at most BLOCK_WORDS words; longer
items are cut at overlapping windows. Each further block takes a further pass over
the rows, which carry what was found so far and are stored in between: driver and
tasks hold one block at a time, however large the benchmark is.

Cases: null texts have no words. Items without words are ignored; an item with
fewer words than the window is one window. Rows with equal item_id count as one
item; the windows of one with a null item_id hit, but there is no id to count or
name. Rows with equal doc_id are each judged alone. An empty benchmark hits
nothing; an empty table gives no rows. Very long texts are judged whole, in a shard
of their own. Columns of docs with the names in FOUND are replaced by find() and
come back untouched from clean(); others stay.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

WINDOW = 10
#: Words of the benchmark that are broadcast at a time (8 bytes each, and its vocabulary).
BLOCK_WORDS = 2_000_000
#: Bytes of text in a shard.
SHARD_CHARS = 4_000_000
#: Columns that find() adds; columns of docs with these names are replaced.
FOUND = ("n_words", "n_hit", "n_items", "items_sha256", "contaminated", "hit_ranges", "items", "longest_match")


class TestSuffixes:
    """The suffixes of some benchmark items, as numbers of their own vocabulary (from 1)."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], window: int):
        self.vocabulary: dict[bytes, int] = {}
        number = self.vocabulary.setdefault
        text, starts, lengths, owners = [], [], [], []
        for k, (_, words) in enumerate(items):
            at, n = len(text), len(words)
            text += [number(w, len(self.vocabulary) + 1) for w in words] + [0]
            for i in range(max(1, n - window + 1)):
                starts.append(at + i)
                lengths.append(min(n, window))
                owners.append(k)
        self.ids = [name for name, _ in items]
        self.longest = max((len(w) for _, w in items), default=0)
        self.text = np.array(text + [0], np.int64)
        self.starts, self.lengths, self.owners = (np.array(x, np.int64) for x in (starts, lengths, owners))
        self.shortest = int(self.lengths.min()) if len(starts) else 0
        self.base = len(self.vocabulary) + 1
        pairs = self.text[:-1] * self.base + self.text[1:]
        self.pairs = np.unique(pairs[(self.text[:-1] > 0) & (self.text[1:] > 0)])


def stretches(ids: np.ndarray, test: TestSuffixes) -> np.ndarray:
    """Positions of the words that may lie in a window, in order; maximal runs of known pairs of enough words."""
    if test.shortest <= 1:
        return np.flatnonzero(ids)
    both = np.flatnonzero((ids[:-1] > 0) & (ids[1:] > 0))
    pair = ids[both] * test.base + ids[both + 1]
    found = np.searchsorted(test.pairs, pair)
    good = both[(found < len(test.pairs)) & (test.pairs[np.minimum(found, len(test.pairs) - 1)] == pair)] if len(test.pairs) else both[:0]
    if not len(good):
        return good
    run = np.cumsum(np.concatenate([[1], np.diff(good) > 1])) - 1
    enough = np.bincount(run)[run] >= test.shortest - 1
    good = good[enough]
    return np.unique(np.concatenate([good, good + 1]))


def suffix_array(text: np.ndarray, depth: int) -> np.ndarray:
    """Starts of the suffixes of text in the order of their first `depth` words at least."""
    _, rank = np.unique(text, return_inverse=True)
    step = 1
    order = np.argsort(rank, kind="stable")
    while step < depth and rank.max(initial=0) < len(text) - 1:
        after = np.zeros(len(text), np.int64)
        after[:-step] = rank[step:] + 1 if step < len(text) else 0
        key = rank.astype(np.int64) * (len(text) + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        rank = np.empty(len(text), np.int64)
        rank[order] = np.cumsum(np.concatenate([[0], sorted_key[1:] != sorted_key[:-1]]))
        step *= 2
    return order


def _bisect(text: np.ndarray, order: np.ndarray, lo: np.ndarray, hi: np.ndarray, depth: int, word: np.ndarray, right: bool) -> np.ndarray:
    """In each range of order, the first place whose word at this depth is >= word (> word if right)."""
    lo, hi = lo.copy(), hi.copy()
    open_ = np.flatnonzero(lo < hi)
    while len(open_):
        mid = (lo[open_] + hi[open_]) >> 1
        there = text[order[mid] + depth]
        below = there <= word[open_] if right else there < word[open_]
        lo[open_[below]] = mid[below] + 1
        hi[open_[~below]] = mid[~below]
        open_ = open_[lo[open_] < hi[open_]]
    return lo


def search(text: np.ndarray, order: np.ndarray, test: TestSuffixes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each window: its range in order (empty if it doesn't occur); of each text position: its longest match."""
    padded = np.concatenate([text, np.zeros(test.longest + 1, text.dtype)])
    n = len(test.starts)
    lo, hi = np.zeros(n, np.int64), np.full(n, len(order))
    first, last = np.zeros(n, np.int64), np.zeros(n, np.int64)
    best = np.zeros(len(text), np.int64)
    active, depth = np.arange(n), 0
    while len(active):
        word = test.text[test.starts[active] + depth]
        active, word = active[word > 0], word[word > 0]
        a = _bisect(padded, order, lo[active], hi[active], depth, word, False)
        b = _bisect(padded, order, a, hi[active], depth, word, True)
        lo[active], hi[active] = a, b
        active = active[a < b]
        depth += 1
        full = active[test.lengths[active] == depth]
        first[full], last[full] = lo[full], hi[full]
        long = active[test.lengths[active] <= depth]
        ranges = np.unique(np.stack([lo[long], hi[long]], axis=1), axis=0) if len(long) else np.zeros((0, 2), np.int64)
        for a1, b1 in ranges:
            best[order[a1:b1]] = depth
    return first, last, best


def judge(texts: list[str | None], test: TestSuffixes) -> tuple[list[int], list[np.ndarray], list[list[str]], list[int]]:
    """For each text: words, hit word positions, ids of the items found, words of the longest match."""
    words = [common.alnum_words(t) if t else [] for t in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    begins = np.cumsum(sizes + 1) - sizes - 1
    ids = np.zeros(int(sizes.sum()) + len(words) + 1, np.int64)
    get = test.vocabulary.get
    for at, w in zip(begins, words, strict=True):
        ids[at : at + len(w)] = np.fromiter(map(get, w, repeat(0)), np.int64, len(w))
    hits = [np.zeros(0, np.int64)] * len(words)
    items: list[list[str]] = [[] for _ in words]
    longest = [0] * len(words)
    kept = stretches(ids, test)
    if len(kept):
        gaps = np.flatnonzero(np.diff(kept) > 1) + 1
        place = np.insert(kept, gaps, -1)  # a separator between stretches
        text = np.where(place >= 0, ids[place], 0)
        order = suffix_array(text, test.longest)
        first, last, best = search(text, order, test)
        covered = np.zeros(len(ids) + 1, np.int64)
        found: set[tuple[int, int]] = set()
        seen: dict[tuple[int, int], np.ndarray] = {}
        for k in np.flatnonzero(first < last):
            key = (int(first[k]), int(test.lengths[k]))
            if key not in seen:
                at = place[order[first[k] : last[k]]]
                np.add.at(covered, at, 1)
                np.add.at(covered, at + test.lengths[k], -1)
                seen[key] = np.unique(np.searchsorted(begins, at, side="right") - 1)
            found.update(zip(seen[key].tolist(), repeat(int(test.owners[k]))))
        hit = np.flatnonzero(np.cumsum(covered) > 0)
        owner = np.searchsorted(begins, hit, side="right") - 1
        cuts = np.flatnonzero(np.diff(owner)) + 1
        for part in np.split(hit, cuts) if len(hit) else []:
            d = int(np.searchsorted(begins, part[0], side="right") - 1)
            hits[d] = part - begins[d]
        for d, k in found:
            if test.ids[k] is not None:
                items[d].append(test.ids[k])
        long = np.flatnonzero(best)
        for d, n in zip((np.searchsorted(begins, place[long], side="right") - 1).tolist(), best[long].tolist(), strict=True):
            longest[d] = max(longest[d], n)
    return sizes.tolist(), hits, items, longest


def _blocks(benchmark: DataFrame, window: int, block_words: int) -> Iterator[TestSuffixes]:
    """The benchmark in blocks: each is made when it is asked for. At least one, be it empty."""
    held: list[tuple[str | None, list[bytes]]] = []
    size = made = 0
    for row in common.only(benchmark, "item_id", "text").filter(F.col("text").isNotNull()).toLocalIterator():
        words, name = common.alnum_words(row["text"]), None if row["item_id"] is None else str(row["item_id"])
        step = max(1, block_words - window + 1)
        for at in range(0, max(1, len(words) - window + 1) if words else 0, step):
            piece = words[at : at + step + window - 1]
            if held and size + len(piece) > block_words:
                yield TestSuffixes(held, window)
                held, size, made = [], 0, made + 1
            held.append((name, piece))
            size += len(piece)
    if held or not made:
        yield TestSuffixes(held, window)


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated, hit_ranges [start, end, ...) in words, items, longest_match."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = docs.drop(*FOUND)
    more = [("n_words", pa.int64()), ("hit_ranges", pa.list_(pa.int64())), ("items", pa.list_(pa.string())), ("longest_match", pa.int64())]
    out = docs.withColumns({"n_words": F.lit(None).cast("bigint"), "hit_ranges": F.lit(None).cast("array<bigint>"), "items": F.lit(None).cast("array<string>"), "longest_match": F.lit(None).cast("bigint")})
    test = None
    for block in _blocks(benchmark, window, block_words):
        if test is not None:
            out = common.stored(out, "judged-documents")
            test.unpersist()
        test = spark.sparkContext.broadcast(block)

        def work(batch: pa.RecordBatch, test=test) -> pa.RecordBatch:
            names = batch.schema.names
            col = {c: batch.column(names.index(c)).to_pylist() for c in ("text", "hit_ranges", "items", "longest_match")}
            found = ([], [], [], [])
            for a, b in common.parts([len(t or "") for t in col["text"]], SHARD_CHARS):
                n, hits, items, longest = judge(col["text"][a:b], test.value)
                for k in range(b - a):
                    before = np.array(col["hit_ranges"][a + k] or [], np.int64).reshape(-1, 2)
                    at = np.unique(np.concatenate([hits[k], *(np.arange(*r) for r in before)])) if len(before) else hits[k]
                    edge = np.flatnonzero(np.diff(at) > 1)
                    ranges = np.stack([at[np.concatenate([[0], edge + 1])], at[np.concatenate([edge, [len(at) - 1]])] + 1], axis=1).ravel() if len(at) else []
                    for to, x in zip(found, (n[k], list(ranges), sorted({*items[k], *(col["items"][a + k] or [])}), max(longest[k], col["longest_match"][a + k] or 0)), strict=True):
                        to.append(x)
            arrays = [pa.array(x, kind) for x, (_, kind) in zip(found, more, strict=True)]
            return pa.RecordBatch.from_arrays([*batch.columns[: -len(more)], *arrays], names=names)

        out = out.mapInArrow(common.per_batch(work), out.schema)
    ends = F.filter("hit_ranges", lambda x, i: i % 2 == 1)
    starts = F.filter("hit_ranges", lambda x, i: i % 2 == 0)
    total = lambda xs: F.aggregate(xs, F.lit(0).cast("bigint"), lambda a, x: a + x)
    out = out.withColumn("n_hit", total(ends) - total(starts)).withColumn("n_items", F.size("items").cast("bigint"))
    return out.withColumn("items_sha256", F.sha2(F.array_join("items", ","), 256)).withColumn("contaminated", F.col("n_hit") > 0)


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The documents without any window of the benchmark, with their own columns."""
    rows, back = common.set_aside(docs, *FOUND)
    return back(find(rows, benchmark, window).filter(~F.col("contaminated")))


def sha256_of(items: list[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()
