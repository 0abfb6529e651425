"""Ranked lexical search over a two-level quantised index.

A term's impact in a document is I = (SCALE * tf) div (1000 tf + 8 m), m growing
with the document's length; a query scores a document by the sum of w * I over its
terms, w from the term's document frequency. The index is a stored table of
segments, each holding the inverted lists of some thousand documents:

- Level 1: a byte for each posting, its impact in steps of the list, rounded up.
  Summed with w it gives an upper bound of the score, and one step less a lower one.
- Level 2: the posting's exact frequency and the document's exact length.

A search sums bytes first. Whatever reaches the k-th best lower bound of a query
(or the k-th exact score found before in the same task) is scored again from
level 2 in whole numbers, and only exact scores are compared. Nothing else can be
among the first k, so results are whole, ties included.

Scale: segments are built where the texts are read and searched where they are
stored: no posting is ever shuffled, so a term in every document is no hot key.
A task passes on at most k rows for each query. Queries go to the tasks in blocks
of at most BLOCK_TERMS words, one block at a time; each block reads the index once,
and its results are stored before the next one starts.

Cases: a null text, and a text without terms, isn't indexed and never found. Rows
with equal or null ids are documents of their own; equal scores go by id, nulls
last. A query without terms, or with terms that no document has, gives no rows.
Repeated queries each give their rows. Very long texts are taken whole; a document
is never split over segments. Other columns aren't read. Empty tables on either
side give no rows.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import common

#: Results of a query, and what impacts are of.
RESULTS, SCALE = 10, 1_000_000_000
#: Documents and postings that a segment holds at most, unless one document has more postings.
SEGMENT_DOCS, SEGMENT_POSTINGS = 4096, 400_000
#: Words of queries in a block at most, unless one query has more.
BLOCK_TERMS = 50_000
#: Segments in an Arrow batch: each is some MB.
SEGMENT_BATCH = 4
#: Bytes of segments that a task holds while it writes them.
ROW_GROUP = 16 << 20
#: Keys over which a query's rows of all tasks are dealt before the last choice.
PARTS = 64

_EXACT = pa.schema([("docs", pa.list_(pa.int64())), ("unnamed", pa.binary()), ("lengths", pa.binary()), ("terms", pa.list_(pa.string())), ("df", pa.list_(pa.int32())), ("places", pa.binary()), ("tf", pa.binary()), ("n_docs", pa.int64()), ("n_terms", pa.int64())])
_EXACT_SQL = "docs array<bigint>, unnamed binary, lengths binary, terms array<string>, df array<int>, places binary, tf binary, n_docs bigint, n_terms bigint"


def _segment(docs: list[int | None], held: list[list[bytes]]) -> pa.RecordBatch:
    """One row: the inverted lists of these documents' terms, by term and document."""
    number: dict[bytes, int] = {}
    for words in held:
        for w in words:
            if w not in number:
                number[w] = len(number)
    sizes = np.array([len(x) for x in held], np.int64)
    ids = np.fromiter((number[w] for words in held for w in words), np.int64, int(sizes.sum()))
    keys, tf = np.unique(ids * len(held) + np.repeat(np.arange(len(held)), sizes), return_counts=True)
    df = np.bincount(keys // len(held), minlength=len(number)).astype(np.int32)
    named = np.array([d if d is not None else 0 for d in docs], np.int64)
    row = [
        pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), pa.array(named)), pa.array([np.array([d is None for d in docs]).tobytes()]), pa.array([sizes.astype(np.int32).tobytes()]),
        pa.ListArray.from_arrays(pa.array([0, len(number)], pa.int32()), pa.array(list(number), pa.binary()).cast(pa.string())), pa.ListArray.from_arrays(pa.array([0, len(df)], pa.int32()), pa.array(df)),
        pa.array([(keys % len(held)).astype(np.uint32).tobytes()]), pa.array([tf.astype(np.uint32).tobytes()]), pa.array([len(docs)], pa.int64()), pa.array([int(sizes.sum())], pa.int64()),
    ]
    return pa.RecordBatch.from_arrays(row, schema=_EXACT)


def _invert(segment_docs: int, segment_postings: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    docs, held, postings = [], [], 0
    for batch in batches:
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            words = common.alnum_words(text.as_py() or "")
            if not words:
                continue
            own = len(set(words))
            if docs and (len(docs) >= segment_docs or postings + own > segment_postings):
                yield _segment(docs, held)
                docs, held, postings = [], [], 0
            docs.append(doc)
            held.append(words)
            postings += own
    if docs:
        yield _segment(docs, held)


def _impacts(tf: np.ndarray, lengths: np.ndarray, n_docs: int, n_terms: int) -> np.ndarray:
    """Exact impacts of postings in documents of these lengths."""
    m = 25 + 75 * lengths.astype(np.int64) * n_docs // n_terms
    return SCALE * tf.astype(np.int64) // (1000 * tf.astype(np.int64) + 8 * m)


def _packed(batch: pa.RecordBatch, row: int, column: str, kind: type) -> np.ndarray:
    return np.frombuffer(batch.column(column)[row].as_buffer(), kind)


def _listed(batch: pa.RecordBatch, row: int, column: str) -> np.ndarray:
    return batch.column(column)[row].values.to_numpy()


def _quantise(n_docs: int, n_terms: int, batch: pa.RecordBatch) -> pa.RecordBatch:
    """Level 1 beside level 2: for each list a step, and for each posting how many steps its impact takes, rounded up."""
    steps, levels = [], []
    for row in range(batch.num_rows):
        df = _listed(batch, row, "df").astype(np.int64)
        lengths = _packed(batch, row, "lengths", np.int32)[_packed(batch, row, "places", np.uint32)]
        impact = _impacts(_packed(batch, row, "tf", np.uint32), lengths, n_docs, n_terms)
        step = np.maximum(1, -(-np.maximum.reduceat(impact, np.cumsum(df) - df) // 255))
        steps.append(step.astype(np.int32))
        levels.append((-(-impact // np.repeat(step, df))).astype(np.uint8).tobytes())
    offsets = pa.array(np.cumsum([0, *(len(s) for s in steps)]).astype(np.int32))
    return pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(offsets, pa.array(np.concatenate(steps))), pa.array(levels, pa.binary())], names=[*batch.schema.names, "steps", "levels"])


@dataclass
class Index:
    """A stored index: its segments, documents with a term, and their terms with repeats."""

    segments: DataFrame
    n_docs: int
    n_terms: int


def build(docs: DataFrame, segment_docs: int = SEGMENT_DOCS, segment_postings: int = SEGMENT_POSTINGS) -> Index:
    """Indexes all terms of all documents (doc_id, text)."""
    exact = common.only(docs, "doc_id", "text").mapInArrow(lambda batches: _invert(segment_docs, segment_postings, batches), _EXACT_SQL)
    with common.batches_of(docs.sparkSession, common.BATCH_ROWS):
        exact = common.stored(exact, "search-postings", row_group=ROW_GROUP)
    n_docs, n_terms = (x or 0 for x in exact.agg(F.sum("n_docs"), F.sum("n_terms")).first())
    with common.batches_of(docs.sparkSession, SEGMENT_BATCH):
        levels = exact.mapInArrow(common.per_batch(lambda batch: _quantise(n_docs, n_terms, batch)), f"{_EXACT_SQL}, steps array<int>, levels binary")
        return Index(common.stored(levels, "search-index", row_group=ROW_GROUP), n_docs, n_terms)


def weight(n_docs: int, df: int) -> int:
    """A term's weight by the documents that hold it."""
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _blocks(queries: DataFrame, block_terms: int) -> Iterator[list[tuple[int, Counter]]]:
    """Number and terms of each query, in blocks of bounded size: one block at a time is on the driver."""
    held, size = [], 0
    for r in queries.select("query", "text").toLocalIterator():
        if words := common.alnum_words(r["text"] or ""):
            if held and size + len(words) > block_terms:
                yield held
                held, size = [], 0
            held.append((r["query"], Counter(words)))
            size += len(words)
    if held:
        yield held


def _frequencies(index: Index, vocabulary: list[str]) -> dict[str, int]:
    """Documents that hold each of a block's terms, of those that any does."""
    sent = index.segments.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = pa.array(sent.value)
        total = np.zeros(len(wanted), np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                number = pc.index_in(batch.column("terms")[row].values, wanted).fill_null(-1).to_numpy(zero_copy_only=False)
                total[number[number >= 0]] += _listed(batch, row, "df")[number >= 0]  # a term has one list in a segment
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["k", "n"])

    rows = index.segments.select("terms", "df").mapInArrow(count, "k bigint, n bigint").groupBy("k").agg(F.sum("n").alias("n")).collect()
    return {vocabulary[r["k"]]: r["n"] for r in rows}


class _Best:
    """The best exact scores of each query so far in a task: (score, place in `docs`) with at most k of them."""

    def __init__(self, n: int, k: int):
        self.k, self.rows = k, [[] for _ in range(n)]

    def least(self, q: int) -> int:
        """A score below this can't be among the first k."""
        return self.rows[q][-1][0] if len(self.rows[q]) == self.k else 1

    def add(self, q: int, scores: list[int], docs: list[int | None]) -> None:
        found = self.rows[q] + list(zip(scores, docs, strict=True))
        found.sort(key=lambda x: (-x[0], x[1] is None, x[1] or 0))
        self.rows[q] = found[: self.k]


def _search_segment(batch: pa.RecordBatch, row: int, vocabulary: pa.Array, queries: list[tuple[np.ndarray, np.ndarray]], n_docs: int, n_terms: int, best: _Best) -> int:
    """Scores one segment for all queries of a block; gives how many (query, document) were scored again.

    queries: of each query the numbers of its terms and what each counts for (weight times repeats).
    """
    df = _listed(batch, row, "df").astype(np.int64)
    end = np.cumsum(df)
    start = end - df
    lengths, places = _packed(batch, row, "lengths", np.int32), _packed(batch, row, "places", np.uint32)
    tf, levels = _packed(batch, row, "tf", np.uint32), _packed(batch, row, "levels", np.uint8)
    steps, docs, unnamed = _listed(batch, row, "steps").astype(np.int64), _listed(batch, row, "docs"), _packed(batch, row, "unnamed", bool)
    number = pc.index_in(batch.column("terms")[row].values, vocabulary).fill_null(-1).to_numpy(zero_copy_only=False)
    list_of = np.full(len(vocabulary), -1)
    list_of[number[number >= 0]] = np.flatnonzero(number >= 0)
    again = 0
    for q, (own, counts) in enumerate(queries):
        lists = list_of[own]
        here = list(zip(lists[lists >= 0].tolist(), counts[lists >= 0].tolist(), strict=True))
        if not here:
            continue
        upper, slack = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for k, c in here:
            at = places[start[k] : end[k]]
            upper[at] += levels[start[k] : end[k]] * (c * steps[k])
            slack[at] += c * (steps[k] - 1)
        least = best.least(q)
        if len(docs) >= best.k:
            least = max(least, int(np.partition(upper - slack, -best.k)[-best.k]))
        chosen = np.flatnonzero(upper >= least)
        if not len(chosen):
            continue
        again += len(chosen)
        exact, index = np.zeros(len(chosen), np.int64), np.full(len(docs), -1)
        index[chosen] = np.arange(len(chosen))
        for k, c in here:
            part = slice(start[k], end[k])
            mine = index[places[part]] >= 0
            at = places[part][mine]
            exact[index[at]] += c * _impacts(tf[part][mine], lengths[at], n_docs, n_terms)
        some = exact > 0
        best.add(q, exact[some].tolist(), [None if unnamed[d] else int(docs[d]) for d in chosen[some]])
    return again


_FOUND = "query bigint, doc_id bigint, score bigint"


def _search_block(index: Index, block: list[tuple[int, Counter]], k: int) -> DataFrame:
    """query, doc_id, score: at most k rows of each query from each task, all of the first k among them."""
    df = _frequencies(index, sorted({w.decode() for _, words in block for w in words}))
    number = {w: n for n, w in enumerate(df)}
    queries = []
    for _, words in block:
        own = [(number[w], times * weight(index.n_docs, df[w])) for w, times in ((w.decode(), times) for w, times in words.items()) if w in df]
        queries.append((np.array([t for t, _ in own], np.int64), np.array([c for _, c in own], np.int64)))
    sent = index.segments.sparkSession.sparkContext.broadcast((list(df), queries, [q for q, _ in block]))
    n_docs, n_terms = index.n_docs, index.n_terms

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, queries, names = sent.value
        vocabulary, best = pa.array(words, pa.string()), _Best(len(queries), k)
        for batch in batches:
            for row in range(batch.num_rows):
                _search_segment(batch, row, vocabulary, queries, n_docs, n_terms, best)
        rows = [(names[q], doc, score) for q, found in enumerate(best.rows) for score, doc in found]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*rows, strict=True)], names=["query", "doc_id", "score"])

    return index.segments.drop("n_docs", "n_terms").mapInArrow(search, _FOUND)


def first(found: DataFrame, k: int, *keys: str) -> DataFrame:
    """The k best rows of each key with their rank; equal scores by id, nulls last. Chosen in parts of a key first."""
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    dealt = found.withColumn("_part", F.pmod(F.xxhash64("doc_id", "score"), F.lit(PARTS)))
    some = dealt.withColumn("_rank", F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order))).filter(F.col("_rank") <= k).drop("_rank", "_part")
    return some.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("rank") <= k)


def search(index: Index, queries: DataFrame, key: str, k: int = RESULTS, block_terms: int = BLOCK_TERMS) -> DataFrame:
    """key, rank, doc_id, score: for each row of queries (key, text) its k best documents with a score above 0."""
    spark = queries.sparkSession
    rows = common.stored(queries.select(F.monotonically_increasing_id().alias("query"), F.col(key).alias("key"), "text"), "search-queries")
    found, path = spark.createDataFrame([], f"{_FOUND}, rank int"), common.shared_path(spark, "search-results")
    found.write.parquet(path)
    for block in _blocks(rows, block_terms) if index.n_docs else ():
        with common.batches_of(spark, SEGMENT_BATCH):
            first(_search_block(index, block, k), k, "query").write.mode("append").parquet(path)
    found = spark.read.schema(found.schema).parquet(path)
    return found.join(rows.select("query", F.col("key").alias(key)), "query").select(key, "rank", "doc_id", "score")
