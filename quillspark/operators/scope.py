"""Choosing and ranking what a review reads: scopes, evidence, access and sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_scope(pages: DataFrame, review: str, most: int) -> DataFrame:
    """pages (review, page_id, must, score) with place and kept: must-keep pages first, then score, then id."""
    w = Window.partitionBy(review).orderBy(F.desc("must"), F.desc("score"), "page_id")
    return pages.withColumn("place", F.row_number().over(w)).withColumn("kept", F.col("place") <= most)


def picked_evidence(evidence: DataFrame, finding: str, most: int = 5) -> DataFrame:
    """Round robin over a finding's sides: every sheet once before any sheet again, sides by turns, at most `most`."""
    per_sheet = Window.partitionBy(finding, "side", "sheet").orderBy("evidence_id")
    per_side = Window.partitionBy(finding, "side").orderBy("again", "evidence_id")
    turns = Window.partitionBy(finding).orderBy("turn", "side", "evidence_id")
    ranked = evidence.withColumn("again", F.row_number().over(per_sheet)).withColumn("turn", F.row_number().over(per_side))
    return ranked.withColumn("place", F.row_number().over(turns)).filter(F.col("place") <= most).drop("again", "turn")


def resolved_sheets(asked: DataFrame, pages: DataFrame) -> DataFrame:
    """asked (ask_id, sheet) with the pages of the best tier: as printed, then normalised; ties are all given."""
    key = lambda c: F.regexp_replace(F.upper(c), "[^A-Z0-9]", "")
    printed = asked.join(pages, "sheet").select("ask_id", "page_id", F.lit(1).alias("tier"))
    normal = asked.withColumn("key", key("sheet")).drop("sheet").join(pages.withColumn("key", key("sheet")).drop("sheet"), "key").select("ask_id", "page_id", F.lit(2).alias("tier"))
    hits = printed.unionByName(normal)
    best = hits.groupBy("ask_id").agg(F.min("tier").alias("tier"))
    return hits.join(best, ["ask_id", "tier"]).select("ask_id", "page_id", "tier").distinct()


def accessible(projects: DataFrame, members: DataFrame, users: DataFrame) -> DataFrame:
    """(project, user_id, role): owners, members, and everyone where a project has no owner (legacy)."""
    owners = projects.filter("owner is not null").select("project", F.col("owner").alias("user_id"), F.lit("owner").alias("role"))
    joined = members.join(owners, ["project", "user_id"], "left_anti").select("project", "user_id", F.lit("member").alias("role"))
    return owners.unionByName(joined).join(users, "user_id", "left_semi").distinct()


def recent_sessions(sessions: DataFrame, messages: DataFrame, project: str, since: Column, scanned: int = 300, shown: int = 50) -> DataFrame:
    """Of a project's newest sessions, those with a last message after since, latest first."""
    newest = Window.partitionBy(project).orderBy(F.desc("created_at"), F.desc("session_id"))
    cut = sessions.withColumn("at", F.row_number().over(newest)).filter(F.col("at") <= scanned).drop("at")
    last = messages.groupBy("session_id").agg(F.max("sent_at").alias("last_at"))
    latest = Window.partitionBy(project).orderBy(F.desc("last_at"), F.desc("session_id"))
    return cut.join(last, "session_id").filter(F.col("last_at") >= since).withColumn("place", F.row_number().over(latest)).filter(F.col("place") <= shown)


def question_results(answers: DataFrame) -> DataFrame:
    """Per question: how many tiles agree, raise issues, don't show it or are unclear."""
    names = ("agree", "issues", "not_shown", "unclear")
    return answers.groupBy("question").agg(*[F.count_if(F.col("answer") == n).alias(n) for n in names])


def set_fingerprint(cases: DataFrame, key: str) -> DataFrame:
    """Per evaluation set: the first 16 hex digits over its sorted lines. A set is a bounded list of cases."""
    line = F.concat_ws("|", "tag", "question", "expected")
    return cases.groupBy(key).agg(F.substring(F.sha2(F.array_join(F.sort_array(F.collect_list(line)), "\n"), 256), 1, 16).alias("fingerprint"))


def run_differences(runs: DataFrame, key: str) -> DataFrame:
    """Cost of each run against the one before of its key; null where either is unknown."""
    w = Window.partitionBy(key).orderBy("run_id")
    before = F.lag("cost").over(w)
    return runs.withColumn("difference", F.round(F.col("cost") - before, 6)).withColumn("percent", F.round(F.try_divide(100 * (F.col("cost") - before), before), 6))
