"""Measures of answers and findings against labelled cases."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def answer_outcomes(answers: DataFrame) -> DataFrame:
    """answers (answer, expected, distractor) with one of correct, hedged, wrong, off_target, abstained."""
    has = lambda c: F.contains(F.upper("answer"), F.upper(c))
    blank = F.trim(F.coalesce("answer", F.lit(""))) == ""
    outcome = F.when(blank, "abstained").when(has("expected") & has("distractor"), "hedged").when(has("expected"), "correct").when(has("distractor"), "wrong").otherwise("off_target")
    return answers.withColumn("outcome", outcome)


def majority_baseline(cases: DataFrame) -> DataFrame:
    """Per tag: cases, and the hits that always answering its most frequent label would score."""
    counts = cases.groupBy("tag", "label").agg(F.count("*").alias("n"))
    return counts.groupBy("tag").agg(F.sum("n").alias("cases"), F.max("n").alias("majority"), F.round(F.max("n") / F.sum("n"), 6).alias("share"))


def concentration(cases: DataFrame) -> DataFrame:
    """Per tag: the largest share of one answer against the largest share of one true label, and the gap."""
    def share(column: str, name: str) -> DataFrame:
        counts = cases.groupBy("tag", column).agg(F.count("*").alias("n"))
        return counts.groupBy("tag").agg(F.round(F.max("n") / F.sum("n"), 6).alias(name))

    both = share("answer", "answer_share").join(share("label", "label_share"), "tag")
    return both.withColumn("gap", F.round(F.col("answer_share") - F.col("label_share"), 6))


def finding_scores(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Per case: expected findings hit and missed, and findings that weren't expected."""
    e, f = expected.select("case_id", "key").distinct(), found.select("case_id", "key").distinct()
    both = e.withColumn("e", F.lit(1)).join(f.withColumn("f", F.lit(1)), ["case_id", "key"], "full_outer").fillna(0, ["e", "f"])
    return both.groupBy("case_id").agg(F.sum(F.col("e") * F.col("f")).alias("hit"), F.sum(F.col("e") * (1 - F.col("f"))).alias("missed"), F.sum((1 - F.col("e")) * F.col("f")).alias("extra"))


def corpora(runs: DataFrame) -> DataFrame:
    """corpus, n_runs, described and the last run (run_id, ran_at, pct, project, label) of each corpus that was scored.

    runs: run_id, ran_at, pct, project, label, ids. A corpus is known by its ids, whatever their order; a run without
    any is a sample of its own, so that such runs never look like one corpus with many scores.
    """
    described = F.coalesce(F.size("ids"), F.lit(0)) > 0
    corpus = F.when(described, F.sha2(F.array_join(F.sort_array("ids"), ","), 256)).otherwise(F.concat(F.lit("none:"), F.col("ran_at").cast("string"), F.lit(":"), F.col("run_id").cast("string")))
    last = F.max_by(F.struct("run_id", "ran_at", "pct", F.coalesce("project", F.lit("unknown")).alias("project"), "label"), F.struct("ran_at", "run_id"))
    return runs.groupBy(corpus.alias("corpus"), described.alias("described")).agg(F.count("*").alias("n_runs"), last.alias("last")).select("corpus", "described", "n_runs", "last.*")


def rescored(runs: DataFrame) -> DataFrame:
    """corpus, project, low, high, n_scores: described corpora that scored differently from one run to another."""
    mine = runs.filter(F.size("ids") > 0).withColumn("corpus", F.sha2(F.array_join(F.sort_array("ids"), ","), 256))
    first = F.min_by(F.coalesce("project", F.lit("unknown")), F.struct("ran_at", "run_id"))
    found = mine.groupBy("corpus").agg(first.alias("project"), F.min("pct").alias("low"), F.max("pct").alias("high"), F.countDistinct("pct").alias("n_scores"))
    return found.filter("n_scores > 1")


def repeats(runs: DataFrame, tags: DataFrame) -> DataFrame:
    """label, n, low, high, spread, worst_tag, worst_spread: corpora of one label are one experiment repeated.

    tags: run_id, tag, pct of the runs. The worst tag is the one whose scores lie furthest apart, of those that two
    corpora have; of equal ones the first by name.
    """
    labelled = corpora(runs).filter("label is not null and label <> ''").select("label", "run_id", "pct")
    whole = labelled.groupBy("label").agg(F.count("*").alias("n"), F.min("pct").alias("low"), F.max("pct").alias("high")).filter("n > 1")
    per_tag = labelled.select("label", "run_id").join(tags, "run_id").groupBy("label", "tag").agg(F.count("pct").alias("n"), (F.max("pct") - F.min("pct")).alias("apart")).filter("n > 1")
    worst = per_tag.groupBy("label").agg(F.min_by(F.struct("tag", "apart"), F.struct((-F.col("apart")).alias("a"), "tag")).alias("w"))
    return whole.join(worst, "label", "left").select("label", "n", "low", "high", (F.col("high") - F.col("low")).alias("spread"), F.col("w.tag").alias("worst_tag"), F.col("w.apart").alias("worst_spread"))
