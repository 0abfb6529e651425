"""What keeps work and memory in proportion to the input: one shuffle, rows worked out once, tasks by their number."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from quillspark.functions import headings
from quillspark.operators import boxes, drawings, geometry
from quillspark.plans import queries
from quillspark.plans import drawing_queries, text_queries  # noqa: F401  (these register their queries)


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_votes_never_leave_their_pair(spark):
    lines = spark.createDataFrame([("p", x) for x in (0.0, 110.0, 230.0, 370.0)] + [("q", 5.0), ("r", None)], "pair string, position double")
    got = geometry.vote_shift(lines, lines.selectExpr("pair", "position + 7 as position"), "pair", 2.0)
    assert "Generate" not in plan_of(got) and plan_of(got).count("Exchange hashpartitioning") == 2
    assert [tuple(r) for r in got.collect()] == [("p", 7.0, 4, 1)]


def test_schedule_rows_take_one_shuffle(spark):
    marks = spark.createDataFrame([("s", "PC", 0, i, 10.0 * i + (900 if i > 3 else 0), f"t{i % 3 if i < 4 else 0}") for i in range(8)], "page string, family string, left int, mark_id int, y double, text string")
    got = drawings.schedule_rows(marks, 300.0)
    assert plan_of(got).count("Exchange hashpartitioning") == 1
    assert sorted(r["mark_id"] for r in got.collect()) == [0, 1, 2, 3]


def test_schedule_rows_are_dealt_by_their_number(spark, small):
    assert "REPARTITION_BY_NUM" in plan_of(queries.QUERIES["schedule_rows"](spark, small))


def test_titles_are_worked_out_once_and_on_all_cores(spark, small):
    title = headings.sheet_title(F.col("c"), F.col("s"))
    rows = spark.createDataFrame([("A sheet title ROOF S-1 PLAN © x", "S-1"), ("bare", "")], "c string, s string")
    assert plan_of(rows.select(title.alias("t"))).count("SHEET TITLE") == 1
    assert [r["t"] for r in rows.select(title.alias("t")).collect()] == ["ROOF PLAN", "bare"]
    assert "REPARTITION_BY_NUM" in plan_of(queries.QUERIES["sheet_titles"](spark, small))


def test_covered_blocks_are_dealt_by_their_number(spark, small):
    assert plan_of(queries.QUERIES["covered_blocks"](spark, small)).count("REPARTITION_BY_NUM") == 2


def test_pages_of_a_batch_are_merged_as_each_alone(monkeypatch):
    """Numpy takes the boxes of many pages in one go; large pages and small runs of pairs give the same."""
    monkeypatch.setattr(boxes, "_per_page", lambda rows, page, key, work, counted: work)
    r = np.random.default_rng(4)
    sizes = [1, 2, 3, 5, 8, 40, 3, 3, 60]
    at = np.repeat(np.arange(len(sizes)), sizes)
    low = r.integers(-150, 150, (len(at), 2)).astype(float)
    rows = np.hstack([low, low + r.integers(0, 40, (len(at), 2))])
    for work in (boxes.merged(None, "p", "k", 5.0), boxes.merged(None, "p", "k", 5.0, 2000.0), boxes.symbols(None, "p")):
        alone = [(k, *map(float, b), int(n)) for k in range(len(sizes)) for b, n in zip(*work(rows[at == k].copy(), at[at == k])[:2], strict=True)]
        for pairs in (30, 1_000_000):
            monkeypatch.setattr(boxes, "BATCH_PAIRS", pairs)
            found, counts, pages = work(rows.copy(), at)
            assert sorted((int(k), *map(float, b), int(n)) for b, n, k in zip(found, counts, pages, strict=True)) == sorted(alone)
            assert counts.sum() == len(at)


def test_starts_take_rows_of_any_order_without_a_frame():
    """One question to the store for a key, rows of a key sorted by time and ties, a null tie last."""
    from pyspark.sql import Row
    from quillspark.streaming import timers

    class Store:
        asked = 0

        def get(self):
            self.asked += 1

        def update(self, values):
            self.values = values

    class Handle:
        def registerTimer(self, ends):  # noqa: N802
            self.ends = ends

    start = timers._Start("_at", ("tie",))
    start.handle, start.value = Handle(), Store()
    event = lambda at, kind, tie, price=1.0: Row(_at=at, kind=kind, price=price, budget=5.0, tie=tie)
    out = list(start.handleInputRows(("a",), iter([event(9, "scan_completed", None), event(9, "planned", 2, float("nan")), event(3, "scan_started", 1)]), None))
    assert [tuple(r) for r in out] == [("a", "no_price", 9)]
    assert start.value.asked == 1 and start.value.values[-1] == start.handle.ends == 9 + timers.SILENT * 1000


def test_replies_are_searched_once(spark):
    from quillspark.functions import reply_objects as ro

    found = ro.objects(spark.createDataFrame([('so: {"decision": keep, "subject": "4\'-0" slab"} ok',), ('{"decision": "keep"}',), ("none",)], "raw string"), "raw", "reply")
    assert found._jdf.queryExecution().optimizedPlan().toString().count("(?s)") == 1
    rows = found.select(ro.verdict(F.col("reply")).alias("r")).collect()
    assert [r["r"] and (r["r"]["decision"], r["r"]["subject"]) for r in rows] == [("keep", "4'-0\" slab"), ("keep", ""), None]
