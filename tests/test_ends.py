"""Blanks where a bounded text is cut: what follows them decides whether they stay."""

from __future__ import annotations

from quillspark.operators import portions, tiers


def test_merged_summaries_keep_the_blank_before_what_starts_behind_the_bound(spark):
    rows = [(1, 1, "a" * 999), (1, 2, "b" * 499), (1, 3, ""), (1, 4, "c"), (2, 1, "a" * 1499), (2, 2, "c"), (3, 1, "a" * 1499), (4, 1, "a" * 1499), (4, 2, None)]
    lower = spark.createDataFrame(rows, "portion int, at int, overview string").selectExpr("*", "array(cast(at as string)) as items")
    got = {r["portion"]: r["overview"] for r in portions.merged_summaries(lower, ["portion"]).collect()}
    told = lambda p: " ".join(o for q, _, o in rows if q == p and o is not None)[:1500]
    assert got == {p: told(p) for p in (1, 2, 3, 4)} and got[1].endswith("b ") and got[2].endswith("a ")


def test_tiers_keep_blanks_at_the_cut_and_drop_those_at_the_end(spark, tmp_path):
    rows = [(1, "A", k, "x" * 99) for k in range(40)] + [(1, "B", k, "tail ") for k in range(12)]
    rows += [(2, "A", k, "x" * 149) for k in range(10)] + [(3, "A", k, "x" * 149) for k in range(11)] + [(4, "A", 1, "y" * 1499 + " z"), (5, "A", 1, "y" * 1498 + "   z"), (5, "B", 1, "end")]
    pages = spark.createDataFrame(rows, "project int, portion string, page long, overview string").selectExpr("*", f"cast(array() as {tiers.ITEM}) as items")
    got, whole = tiers.rolled_up(pages, f"file://{tmp_path}/t")
    join = lambda xs: " ".join(xs).strip()[:1500]
    want = {}
    for project, portion, _, overview in rows:
        want.setdefault((project, portion), []).append(overview.strip())
    want = {k: join(xs) for k, xs in want.items()}
    assert {(r["project"], r["portion"]): r["overview"] for r in got.collect()} == want and want[(3, "A")].endswith("x ")
    assert {r["project"]: r["overview"] for r in whole.collect()} == {p: join([want[k] for k in sorted(want) if k[0] == p]) for p, _ in want}
