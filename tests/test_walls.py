"""Wall lines of many windows meet in one pass: one join, windows cut by no batch, odd lines counted."""

from __future__ import annotations

import random

import pytest

from quillspark.operators import boxes

WINDOW = "window string, a_sheet string, b_sheet string, " + ", ".join(f"{s}{e} double" for s in "ab" for e in boxes.EDGES) + ", scale double, tx double, ty double, feet double"
WALL = "sheet string, wall_id string, horizontal boolean, pos double, lo double, hi double"
PAGE = (0.0, 0.0, 1000.0, 1000.0)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def rows(spark):
    rng = random.Random(8)
    windows = [(f"w{k}", f"a{k % 5}", f"b{k}", *PAGE, *PAGE, 1.0, 0.0, 0.0, rng.choice([9.0, 9.0, 20.0, None])) for k in range(12)]
    walls = [(s, f"{s}-{j}", rng.random() < 0.5, round(rng.uniform(0, 300), 1), 100.0, 200.0) for s in [f"a{k}" for k in range(5)] + [f"b{k}" for k in range(11)] for j in range(rng.randint(1, 40))]
    return spark.createDataFrame(windows, WINDOW), spark.createDataFrame(walls, WALL)


def test_lines_meet_in_one_join(spark, rows):
    for found in boxes.compared_lines(*rows):
        plan = plan_of(found)
        assert plan.count("SortMergeJoin") == 1 and plan.count("Join") == 1 and plan.count("MapInArrow") == 1 and "Broadcast" not in plan


def test_windows_are_whole_whatever_the_batches(spark, rows, monkeypatch):
    """Batches of three lines, and of all, give the same; so do pairs taken a few at a time."""
    both = lambda: [sorted(tuple(r) for r in x.collect()) for x in boxes.compared_lines(*rows)]
    want = both()
    assert len(want[0]) == 12 and len(want[1]) > 20 and any(r[3] for r in want[0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    monkeypatch.setattr(boxes, "BATCH_PAIRS", 5)
    try:
        assert both() == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_odd_lines(spark):
    """A window without lines has zeros; a line of unknown direction counts and meets none; one without a place doesn't count."""
    windows = spark.createDataFrame([("x", "a", "b", *PAGE, *PAGE, 1.0, 0.0, 0.0, 9.0), ("y", "none", None, *PAGE, *PAGE, 1.0, 0.0, 0.0, 9.0)], WINDOW)
    walls = spark.createDataFrame([("a", "1", None, 50.0, 0.0, 100.0), ("b", "1", None, 50.0, 0.0, 100.0), ("a", "2", True, 80.0, 0.0, 100.0), ("b", "7", True, 90.0, 0.0, 100.0), ("b", "6", True, 70.0, 0.0, 100.0), ("a", "3", True, None, 0.0, 100.0)], WALL)
    sums, near = boxes.compared_lines(windows, walls)
    assert sorted(tuple(r) for r in sums.collect()) == [("x", 2, 3, 0, 0), ("y", 0, 0, 0, 0)]
    assert [tuple(r) for r in near.collect()] == [("x", "2", "6", True, -10.0)]
