"""Keyed merges of a stored table with new rows: full outer joins, written to a new path by the sink."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def upsert(stored: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """New rows replace stored ones of equal keys; the rest stays."""
    names = [c for c in stored.columns if c not in keys]
    n = new.select(*keys, F.struct(*names).alias("n"))
    s = stored.select(*keys, F.struct(*names).alias("s"))
    return s.join(n, keys, "full_outer").select(*keys, F.coalesce("n", "s").alias("r")).select(*keys, "r.*")


def upsert_keeping(stored: DataFrame, new: DataFrame, keys: list[str], identity: str, delete_missing: bool = True) -> DataFrame:
    """As upsert, but stored rows keep their identity column, and rows that vanished may go."""
    names = [c for c in stored.columns if c not in (*keys, identity)]
    s = stored.select(*keys, F.col(identity).alias("old_id"), F.struct(*names).alias("s"))
    n = new.select(*keys, F.col(identity).alias("new_id"), F.struct(*names).alias("n"))
    joined = s.join(n, keys, "right" if delete_missing else "full_outer")
    return joined.select(*keys, F.coalesce("old_id", "new_id").alias(identity), F.coalesce("n", "s").alias("r")).select(*keys, identity, "r.*")


def filled_gaps(stored: DataFrame, new: DataFrame, key: str, columns: list[str], replace: bool = False) -> DataFrame:
    """Columns of new fill stored nulls only (or, with replace, take over wherever they aren't null)."""
    n = new.select(key, *[F.col(c).alias(f"new_{c}") for c in columns])
    pick = lambda c: F.coalesce(f"new_{c}", c) if replace else F.coalesce(c, f"new_{c}")
    return stored.join(n, key, "left").select(*[pick(c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def merge_candidates(stored: DataFrame, found: DataFrame) -> DataFrame:
    """fingerprint, status, confidence, wording, corroborated: only pending rows are updated.

    A corroborated row stays high; wording changes only where the new one is given.
    """
    s = stored.select("fingerprint", *[F.col(c).alias(f"s_{c}") for c in ("status", "confidence", "wording", "corroborated")])
    n = found.select("fingerprint", *[F.col(c).alias(f"n_{c}") for c in ("confidence", "wording")])
    j = s.join(n, "fingerprint", "full_outer")
    new, pending = F.col("s_status").isNull(), (F.col("s_status") == "pending") & F.col("n_confidence").isNotNull()
    confidence = F.when(new, F.col("n_confidence")).when(pending & ~F.col("s_corroborated"), F.col("n_confidence")).otherwise(F.col("s_confidence"))
    wording = F.when(new, F.col("n_wording")).when(pending, F.coalesce("n_wording", "s_wording")).otherwise(F.col("s_wording"))
    return j.select("fingerprint", F.coalesce("s_status", F.lit("pending")).alias("status"), confidence.alias("confidence"), wording.alias("wording"), F.coalesce("s_corroborated", F.lit(False)).alias("corroborated"))


def unresolved(stored: DataFrame, found: DataFrame, ran: DataFrame) -> DataFrame:
    """stored without pending rows of checks that ran and no longer give them."""
    gone = stored.filter("status = 'pending'").join(ran.select("check_type").distinct(), "check_type", "left_semi").join(found.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return stored.join(gone.select("fingerprint"), "fingerprint", "left_anti")


def actions(found: DataFrame, stored: DataFrame) -> DataFrame:
    """found with what to do: new, reopen (resolved before) or keep."""
    status = stored.select("fingerprint", "status").dropDuplicates(["fingerprint"])
    action = F.when(F.col("status").isNull(), "new").when(F.col("status") == "resolved", "reopen").otherwise("keep")
    return found.join(status, "fingerprint", "left").withColumn("action", action).drop("status")


def numbered(accepted: DataFrame, counters: DataFrame, project: str, order: list[str]) -> DataFrame:
    """Accepted rows numbered on from their project's counter without gaps."""
    from pyspark.sql import Window

    at = F.row_number().over(Window.partitionBy(project).orderBy(*order))
    return accepted.withColumn("at", at).join(counters, project, "left").withColumn("number", F.coalesce("counter", F.lit(0)) + F.col("at")).drop("at", "counter")


def superseded(documents: DataFrame, ids: DataFrame, now: str) -> DataFrame:
    """Soft delete, idempotent: the first time stays."""
    marked = ids.select("document_id").distinct().withColumn("hit", F.lit(True))
    when = F.when(F.col("hit"), F.coalesce("superseded_at", F.lit(now).cast("timestamp"))).otherwise(F.col("superseded_at"))
    return documents.join(marked, "document_id", "left").withColumn("superseded_at", when).drop("hit")
