"""Tiers against one flat merge, with a project of a third of all rows; bounded nodes; runs that go on."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from quillspark.operators import tiers

SCHEMA = f"project int, portion string, page long, overview string, items {tiers.ITEM}"


@pytest.fixture(scope="module")
def pages():
    rng = random.Random(4)
    out = []
    for k in range(1500):
        project = 1 if k % 3 == 0 else rng.randint(2, 40)
        items = [(f"t{k}-{j}", [f"c{k}-{j}"], k) for j in range(rng.choice([0, 0, 0, 1, 2]))]
        out.append((project, rng.choice(["S", "A", None]) if project != 1 else "S", k, rng.choice(["", None, f"page {k} says this.", "x" * rng.randint(1, 300)]), items))
    return out + [(99, "E", 1, None, []), (99, "E", 2, "", [])]


def flat(rows):
    told = " ".join(o for *_, o, _ in rows if o).strip()[:1500]
    items = [i for *_, its in rows for i in its][:8]
    return (told, [i[0] for i in items]) if told or items else None


def test_matches_a_flat_merge(spark, pages, tmp_path):
    portions, projects = tiers.rolled_up(spark.createDataFrame(pages, SCHEMA), f"file://{tmp_path}/t")
    got = {(r["project"], r["portion"]): (r["overview"], [i["text"] for i in r["items"]]) for r in portions.collect()}
    groups = {}
    for r in sorted(pages, key=lambda r: r[2]):
        groups.setdefault((r[0], r[1]), []).append(r)
    want = {k: x for k, rows in groups.items() if (x := flat(rows))}
    assert got == want and (99, "E") not in got
    whole = {r["project"]: r["overview"] for r in projects.collect()}
    for p in {p for p, _ in want}:
        assert whole[p] == " ".join(want[k][0] for k in sorted((k for k in want if k[0] == p), key=lambda k: k[1] or "") if want[k][0]).strip()[:1500]


def test_nodes_are_bounded_and_runs_go_on(spark, pages, tmp_path):
    root = f"{tmp_path}/t"
    tiers.rolled_up(spark.createDataFrame(pages, SCHEMA), f"file://{root}")
    for k in range(3):
        nodes = spark.read.parquet(f"file://{root}/portion-{k}").withColumn("above", F.floor(F.col("at") / tiers.FAN))
        assert nodes.groupBy("project", "portion", "above").count().agg(F.max("count")).first()[0] <= tiers.FAN
    # a tier that is there is read, not made again: its change shows above
    first = spark.read.parquet(f"file://{root}/portion-1").withColumn("overview", F.lit("kept"))
    first.write.parquet(f"file://{tmp_path}/u/portion-1")
    (tmp_path / "u" / "portion-0").symlink_to(f"{root}/portion-0")
    portions, _ = tiers.rolled_up(spark.createDataFrame([], SCHEMA), f"file://{tmp_path}/u")
    row = portions.filter("project = 1").first()
    assert row["overview"].startswith("kept kept kept") and row["end_page"] >= 1490


def test_resolved(spark):
    rows = [(1, [("a", ["c1", "zz", "c2"], None), ("b", ["zz"], None), ("c", ["zz"], 7), ("d", [], None)]), (2, []), (3, None)]
    got = {r["k"]: [(i["text"], i["chunk_ids"], i["page"]) for i in r["items"]] for r in tiers.resolved(spark.createDataFrame(rows, f"k int, items {tiers.ITEM}"), spark.createDataFrame([("c1", 5), ("c2", 3)], "chunk_id string, page int"), "k").collect()}
    assert got == {1: [("a", ["c1", "c2"], 3), ("c", [], 7)], 2: [], 3: []}
