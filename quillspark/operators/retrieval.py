"""Search over chunks: keyword, identifier and vector arms, rank fusion and their measures."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text
from . import keyword
from .keyword import ARM, STOP_WORDS, top  # noqa: F401  (stop words: for users of this module)

#: Rows that fusion keeps.
FUSED = 18
RRF_CONSTANT = 60
#: Query vectors that are broadcast at a time.
QUERY_BLOCK = 4096
#: Scores that a task holds at a time, about.
CELLS = 1_000_000


def identifier_index(chunks: DataFrame, key: str = "chunk_id", body: str = "text") -> DataFrame:
    """key, identifier: one row for each distinct identifier of a chunk."""
    return chunks.select(key, F.explode(text.identifiers(F.col(body))).alias("identifier"))


def by_identifier(index: DataFrame, queries: DataFrame, k: int = ARM) -> DataFrame:
    """query_id, chunk_id, hits, rank: chunks by the number of the query's identifiers they carry."""
    asked = queries.select("query_id", F.explode(text.identifiers(F.upper("question"))).alias("stem"), F.lit(1).alias("size"))
    held = index.select("chunk_id", F.col("identifier").alias("stem"), F.lit(1).alias("times"))
    return keyword.best(held, asked, F.count("*"), k).withColumnRenamed("score", "hits")


def by_keyword(chunks: DataFrame, queries: DataFrame, k: int = ARM) -> DataFrame:
    """query_id, chunk_id, score, rank of chunks that aren't indexed yet."""
    return keyword.search(keyword.index(chunks), queries, k)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows at length 1; zero rows stay."""
    norm = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norm == 0, 1, norm)


def best_scores(batches: Iterator[pd.DataFrame], names: np.ndarray, q: np.ndarray, k: int) -> Iterator[pd.DataFrame]:
    """query_id, chunk_id, score: the k best of a task's points for each query; about CELLS scores are in memory at a time."""
    step = max(1, CELLS // max(1, len(names)))
    least = np.full(len(names), -np.inf)  # of each query the k-th best score so far
    kept = waiting = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def merged(*found: tuple) -> tuple:
        at, ids, scores = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((ids, -scores, at))
        at, ids, scores = at[order], ids[order], scores[order]
        place = np.arange(len(at)) - np.searchsorted(at, at)
        least[at[place == k - 1]] = scores[place == k - 1]
        return tuple(x[place < k] for x in (at, ids, scores))

    for pdf in batches:
        for start in range(0, len(pdf) if len(names) else 0, step):
            part = pdf.iloc[start : start + step]
            found = np.round(q @ unit(np.array(part["vector"].tolist(), np.float64)).T, 6)
            at, column = np.nonzero(~(found < least[:, None]))
            waiting = tuple(np.concatenate(x) for x in zip(waiting, (at, part["chunk_id"].to_numpy()[column], found[at, column]), strict=True))
            if len(waiting[0]) > CELLS // 4:
                kept, waiting = merged(kept, waiting), tuple(x[:0] for x in waiting)
    at, ids, scores = merged(kept, waiting)
    if len(at):
        yield pd.DataFrame({"query_id": names[at], "chunk_id": ids, "score": scores})


def by_vector(points: DataFrame, queries: DataFrame, k: int = ARM, block: int = QUERY_BLOCK) -> DataFrame:
    """query_id, chunk_id, score, rank: exact cosine neighbours.

    The stated queries are taken in blocks of about `block`: each is broadcast and meets every point in one scan, as a
    matrix product per batch, of which a task keeps a query's best k. Vectors have one length; nulls are left out.
    """
    spark = points.sparkSession
    queries = queries.select("query_id", "vector").filter("query_id is not null and vector is not null")
    points = points.select("chunk_id", "vector").filter("chunk_id is not null and vector is not null")
    blocks = max(1, -(-queries.count() // block))
    out = None
    for b in range(blocks):
        rows = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toPandas()
        asked = spark.sparkContext.broadcast((rows["query_id"].to_numpy(), unit(np.array(rows["vector"].tolist(), np.float64).reshape(len(rows), -1))))

        def best(batches: Iterator[pd.DataFrame], asked=asked) -> Iterator[pd.DataFrame]:
            return best_scores(batches, *asked.value, k)

        part = points.mapInPandas(best, "query_id bigint, chunk_id bigint, score double")
        out = part if out is None else out.unionByName(part)
    return top(out, "query_id", "score", "chunk_id", k)


def fuse(arms: list[tuple[DataFrame, float]], k: int = FUSED) -> DataFrame:
    """Reciprocal rank fusion: the sum of weight / (60 + rank) over the arms that hold a chunk."""
    lists = [a.select("query_id", "chunk_id", (F.lit(w) / (RRF_CONSTANT + F.col("rank"))).alias("part")) for a, w in arms]
    union = lists[0]
    for x in lists[1:]:
        union = union.unionByName(x)
    return top(union.groupBy("query_id", "chunk_id").agg(F.round(F.sum("part"), 9).alias("score")), "query_id", "score", "chunk_id", k)


def measures(ranked: DataFrame, truth: DataFrame, k: int = FUSED) -> DataFrame:
    """Per tag and over all: cases, recall@k and mean reciprocal rank of the first true hit."""
    first = ranked.filter(F.col("rank") <= k).join(truth, ["query_id", "chunk_id"]).groupBy("query_id").agg(F.min("rank").alias("rank"))
    cases = truth.select("query_id", "tag").distinct().join(first, "query_id", "left")
    grouped = cases.groupingSets([[], [F.col("tag")]], "tag")
    found = F.col("rank").isNotNull().cast("double")
    return grouped.agg(F.count("*").alias("cases"), F.round(F.avg(found), 6).alias("recall"), F.round(F.avg(F.coalesce(1 / F.col("rank"), F.lit(0.0))), 6).alias("mrr"))


def cached_or_missing(texts: DataFrame, cache: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Distinct texts by hash with their cached vectors, and those that have none yet."""
    distinct = texts.select(text.text_hash(F.col("text")).alias("text_hash"), "text").dropDuplicates(["text_hash"])
    return distinct.join(cache, "text_hash"), distinct.join(cache, "text_hash", "left_anti")


def reused(new: DataFrame, previous: DataFrame) -> DataFrame:
    """New chunks with the previous revision's chunk of equal text; of several the smallest id."""
    old = previous.groupBy("text_hash").agg(F.min("chunk_id").alias("previous_id"))
    return new.join(old, "text_hash", "left")
