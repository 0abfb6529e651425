"""Nearest things meet place by place: many at one place cost no pairs."""

from __future__ import annotations

import random

from quillspark.operators import geometry, review


def pairs_joined(df):
    """Rows that the joins of a finished plan gave, the most of one."""
    df.collect()
    plan, found = df._jdf.queryExecution().executedPlan(), []

    def walk(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return walk(node.executedPlan())
        if name.endswith("QueryStage"):
            return walk(node.plan())
        if "Join" in name:
            found.append(node.metrics().apply("numOutputRows").value())
        for k in range(node.children().size()):
            walk(node.children().apply(k))

    walk(plan)
    return max(found)


def test_nearest_by_places(spark):
    points = spark.createDataFrame([(1, k, float(k % 3), 0.0) for k in range(300)], "page int, point_id int, x double, y double")
    targets = spark.createDataFrame([(1, k, 0.0, float(k % 2)) for k in range(300)], "page int, target_id int, x double, y double")
    got = geometry.nearest(points, targets, "page", 2.5)
    assert pairs_joined(got) <= 300
    assert {(r["point_id"] % 3, r["target_id"], r["distance"]) for r in got.collect()} == {(0, 0, 0.0), (1, 0, 1.0), (2, 0, 2.0)}


def test_nearest_below_by_places(spark):
    rng = random.Random(6)
    marks = [(1, k, x, x + 20.0, float(rng.randint(0, 5) * 20)) for k in range(200) for x in [float(rng.randint(0, 3) * 15)]]
    sizes = [(1, 1000 + k, x, x + 10.0, float(rng.randint(0, 9) * 15)) for k in range(200) for x in [float(rng.randint(0, 6) * 12)]]
    got = review.nearest_below(spark.createDataFrame(marks, "page int, mark_id int, x0 double, x1 double, y1 double"), spark.createDataFrame(sizes, "page int, size_id int, x0 double, x1 double, y0 double"), 40.0)
    want = {}
    for _, m, x0, x1, y1 in marks:
        below = sorted((y0, s) for _, s, a, b, y0 in sizes if 0 <= y0 - y1 <= 40 and a < x1 and x0 < b)
        if below:
            want[m] = below[0][1]
    assert {r["mark_id"]: r["size_id"] for r in got.collect()} == want
    assert pairs_joined(got) <= 2000


def test_hot_band_is_dealt(spark):
    """All headings and chunks in one band: every pair once, whatever the parts."""
    headings = spark.createDataFrame([(1, k, 0.0, 9.0, 1.0) for k in range(30)], "page int, heading_id int, x0 double, x1 double, y1 double")
    chunks = spark.createDataFrame([(1, k, 5.0, 6.0, 2.0 + k % 3) for k in range(50)], "page int, chunk_id int, x0 double, x1 double, y0 double")
    got = review.under_headings(headings, chunks, 60.0, pairs=100)
    assert sorted((r["heading_id"], r["chunk_id"]) for r in got.collect()) == [(h, c) for h in range(30) for c in range(50)]
