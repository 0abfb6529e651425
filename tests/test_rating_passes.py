"""Ratings are read from each text once and meet in one shuffle; no text is split by a pattern."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.functions import contexts
from quillspark.operators import checks, text_checks


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_texts_are_read_once(spark):
    found = text_checks.tag_value_conflicts(spark.createDataFrame([(1, "EF-1 5 CFM")], "page_id int, text string"))
    plan = plan_of(found)
    assert plan.count("Generate explode") == 1 and "Join" not in plan and "split(" not in plan


def test_conflicts_are_those_of_the_ratings(spark):
    """Without qualifiers they are what the check of ratings finds: sheets without a name, and values that repeat on one."""
    rng = random.Random(3)
    rows = [(rng.choice([None, 1, 2, 3]), " ".join(f"EF-{rng.randint(1, 30)} {rng.choice(['5', '6.5', '7'])} {rng.choice(['CFM', 'HP'])}" for _ in range(rng.randint(0, 3)))) for _ in range(150)]
    chunks = spark.createDataFrame([*rows, (4, None)], "page_id int, text string")
    ratings = chunks.select(F.col("page_id").alias("sheet"), F.explode(contexts.rated_tags(F.col("text"))).alias("r")).select("sheet", "r.*")
    want = sorted(tuple(r) for r in checks.tag_value_conflicts(ratings).collect())
    assert sorted(tuple(r) for r in text_checks.tag_value_conflicts(chunks).collect()) == want and len({r[3] for r in want}) > 1 and len({r[6] for r in want}) > 1


def test_every_value_must_name_one_quantity(spark):
    rows = [(1, "EF-1 SUPPLY 5 CFM"), (2, "EF-1 EXHAUST 6 CFM"), (1, "EF-2 SUPPLY 5 CFM"), (2, "EF-2 SUPPLY 6 CFM"), (1, "EF-3 SUPPLY 5 CFM"), (2, "EF-3 EXHAUST 5 CFM"), (3, "EF-3 RETURN 6 CFM"), (1, "EF-4 SUPPLY MIN 5 CFM"), (2, "EF-4 SUPPLY MAX 6 CFM")]
    found = text_checks.tag_value_conflicts(spark.createDataFrame(rows, "page_id int, text string")).collect()
    assert sorted(r["tag"] for r in found) == ["EF-2", "EF-3"]


def test_places_of_touching_matches(spark):
    upper = "xA-1B-22\n" + "y" * 3000 + "A-3"
    got = spark.createDataFrame([(upper,)], "t string").select(contexts.occurrences(F.col("t"), "[A-Z]-[0-9]", False).alias("o")).first()["o"]
    assert [(o["token"], o["start"], o["end"]) for o in got] == [("A-1", 1, 4), ("B-2", 4, 7), ("A-3", 3009, 3012)]
