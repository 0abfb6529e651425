"""Registered queries of timed state: tables as streams that are read to their end, with a checkpoint in the shared folder."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.tables import shared_path, table
from ..streaming import timers
from .queries import query


def _stream(spark: SparkSession, d: str, name: str) -> DataFrame:
    """A table as a stream of its files."""
    # a pattern, so that a table may be a file as well as a folder
    return spark.readStream.schema(table(spark, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def _to_end(stream: DataFrame, name: str) -> DataFrame:
    """What a stream gives once it has read all that is there. The state store that timers need is set while it runs."""
    spark, path = stream.sparkSession, shared_path(stream.sparkSession, name)
    before = spark.conf.get(timers.STORE[0], None)
    spark.conf.set(*timers.STORE)
    run = stream.writeStream.format("parquet").option("path", f"{path}/rows").option("checkpointLocation", f"{path}/checkpoint").outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    spark.conf.set(timers.STORE[0], before) if before else spark.conf.unset(timers.STORE[0])
    return spark.read.schema(stream.schema).parquet(f"{path}/rows")


@query("""with recursive h as (select event_id, user_id, epoch_us(ts) // 1000 as t, row_number() over (partition by user_id order by ts, event_id) as k from events),
  f as (select event_id, user_id, k, t as started, 1 as n from h where k = 1
    union all select h.event_id, h.user_id, h.k, case when h.t >= f.started + 900000 then h.t else f.started end, case when h.t >= f.started + 900000 then 1 else f.n + 1 end from f join h on h.user_id = f.user_id and h.k = f.k + 1)
  select event_id, n > 3 as throttled from f""")
def throttled_requests(spark, d):
    """Events as reset requests of their users: more than three in a quarter of an hour."""
    requests = _stream(spark, d, "events").select("event_id", F.concat(F.lit("User"), F.col("user_id").cast("string")).alias("email"), "ts")
    return _to_end(timers.throttled(requests.withColumn("ts", F.col("ts").cast("timestamp")), "email", "ts", "event_id", "1 minute").select("event_id", "throttled"), "throttled")


@query("""with recursive h as (select event_id, user_id, event_type as stage, epoch_us(ts) // 1000 as t, row_number() over (partition by user_id order by ts) as k from events),
  f as (select event_id, user_id, k, stage, t as last, true as write from h where k = 1
    union all select h.event_id, h.user_id, h.k, case when w then h.stage else f.stage end, case when w then h.t else f.last end, w from f join h on h.user_id = f.user_id and h.k = f.k + 1, lateral (select h.stage <> f.stage or h.t - f.last >= 3600000 as w))
  select event_id from f where write""")
def written_progress(spark, d):
    """Events as steps of their users' runs: those of a new stage, or an hour after the last write."""
    steps = _stream(spark, d, "events").select("event_id", F.col("user_id").alias("scan_id"), F.col("event_type").alias("stage"), F.lit(False).alias("force"), F.col("ts").cast("timestamp").alias("ts"))
    return _to_end(timers.progress_writes(steps, "ts", "1 minute", 3600.0).select("event_id"), "progress")


@query("""with e as (select o_custkey as scan, o_orderkey, case when o_orderstatus = 'F' then 'planned' when o_orderstatus = 'O' then 'scan_started' else 'scan_completed' end as kind, o_totalprice as price, epoch_us(o_orderdate) as t from orders),
  u as (select *, row_number() over (partition by scan order by t, o_orderkey) as k from e),
  p as (select *, min(case when kind = 'planned' then k end) over (partition by scan) as first_plan,
    last_value(case when kind <> 'planned' then kind end ignore nulls) over (partition by scan order by k rows unbounded preceding) as state from u),
  d as (select scan, first_plan, min(k) as k from p where k >= first_plan and coalesce(state, '') <> 'scan_started' group by 1, 2)
  select 'c' || d.scan as scan_id, case when u.price <= 300000 then 'started' else 'over_limit' end as decision from d join u on u.scan = d.scan and u.k = d.first_plan""")
def plan_starts(spark, d):
    """Orders as events of their customers' plans; ties of time are ordered by key, as a second of its own would."""
    spark.conf.set(*timers.STORE)
    kind = F.when(F.col("o_orderstatus") == "F", "planned").when(F.col("o_orderstatus") == "O", "scan_started").otherwise("scan_completed")
    events = _stream(spark, d, "orders").select(F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("scan_id"), kind.alias("kind"), F.col("o_totalprice").alias("price"), F.lit(300000.0).alias("budget"), F.col("o_orderdate").cast("timestamp").alias("ts"), "o_orderkey")
    return _to_end(timers.starts(events, "ts", "1 day", "o_orderkey").select("scan_id", "decision"), "starts")
