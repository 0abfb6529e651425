"""Runs over time: what counts as one corpus, what is a repeat, what only moved in the harness."""

from __future__ import annotations

from quillspark.operators import evaluation

RUNS = "run_id int, ran_at string, pct int, project string, label string, ids array<string>"


def test_history(spark):
    runs = spark.createDataFrame([
        (1, "a", 25, "p", "x", ["k", "m"]), (2, "b", 30, "q", "x", ["m", "k"]), (3, "c", 68, None, "x", ["n"]), (4, "d", 10, "p", None, []), (5, "d", 90, "p", "", None), (6, "e", 50, "p", "y", ["o"]), (7, "f", 50, "p", "y", ["o"]),
    ], RUNS)
    got = {r["run_id"]: (r["n_runs"], r["described"], r["pct"], r["project"]) for r in evaluation.corpora(runs).collect()}
    assert got == {2: (2, True, 30, "q"), 3: (1, True, 68, "unknown"), 4: (1, False, 10, "p"), 5: (1, False, 90, "p"), 7: (2, True, 50, "p")}
    assert [(r["project"], r["low"], r["high"]) for r in evaluation.rescored(runs).collect()] == [("p", 25, 30)]
    tags = spark.createDataFrame([(1, "foot", 0), (2, "foot", 26), (3, "foot", 95), (2, "col", 50), (3, "col", 40), (3, "only", 1)], "run_id int, tag string, pct int")
    assert [tuple(r) for r in evaluation.repeats(runs, tags).collect()] == [("x", 2, 30, 68, 38, "foot", 69)]
    assert evaluation.repeats(runs, tags.filter("tag = 'only'")).first()["worst_tag"] is None
    assert evaluation.corpora(runs.limit(0)).count() == 0
