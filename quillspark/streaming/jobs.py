"""Queue semantics on Structured Streaming: duplicate deliveries, rate limits and liveness."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def once(jobs: DataFrame, key: str, time: str, delay: str) -> DataFrame:
    """Each job once, though it is delivered again within the delay."""
    return jobs.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def per_window(events: DataFrame, time: str, length: str, delay: str, *keys: str) -> DataFrame:
    """Counts and sums per event-time window and keys; late rows beyond the delay are left out."""
    window = F.window(time, length)
    return events.withWatermark(time, delay).groupBy(window, *keys).agg(F.count("*").alias("n"), F.sum("value").alias("total"))


def _limit(times: list[pd.Timestamp], started: float | None, count: int, seconds: int, most: int) -> tuple[list[bool], float | None, int]:
    allowed = []
    for t in times:
        at = t.timestamp()
        if started is None or at >= started + seconds:
            started, count = at, 0
        count += 1
        allowed.append(most == 0 or count <= most)
    return allowed, started, count


def limited_batch(hits: DataFrame, key: str, time: str, seconds: int, most: int, *ties: str) -> DataFrame:
    """hits with allowed: a fixed window per key that starts at its first hit; a limit of 0 allows all.

    Hits of one time are counted in the order of the columns `ties`.

    Runs along sorted partitions batch by batch and keeps one window's start and count.
    """

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, started, count = None, None, 0
        for pdf in batches:
            allowed: list[bool] = []
            for name, rows in pdf.groupby(key, sort=False):
                if name != current:
                    current, started, count = name, None, 0
                got, started, count = _limit(list(rows[time]), started, count, seconds, most)
                allowed += got
            yield pdf.assign(allowed=allowed)

    return hits.repartition(key).sortWithinPartitions(key, time, *ties).mapInPandas(work, hits.withColumn("allowed", F.lit(True)).schema)


def limited_stream(hits: DataFrame, key: str, time: str, seconds: int, most: int, *ties: str) -> DataFrame:
    """As limited_batch over a stream; the state of a key is its window's start and count."""

    def work(name: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        started, count = state.get if state.exists else (None, 0)
        pdf = pd.concat(list(batches)).sort_values([time, *ties], kind="stable")
        allowed, started, count = _limit(list(pdf[time]), started, count, seconds, most)
        state.update((started, count))
        yield pdf.assign(allowed=allowed)

    schema = hits.withColumn("allowed", F.lit(True)).schema
    return hits.groupBy(key).applyInPandasWithState(work, schema, "started double, count int", "append", GroupStateTimeout.NoTimeout)


def alive(runs: DataFrame, now: str, seconds: int) -> DataFrame:
    """runs with alive: an active status and a heartbeat no older than `seconds` before now."""
    age = F.lit(now).cast("timestamp").cast("double") - F.col("heartbeat").cast("timestamp").cast("double")
    return runs.withColumn("alive", F.col("status").isin("queued", "running") & (F.coalesce(age, F.lit(float("inf"))) <= seconds))
