"""The page chunker against a plain one that follows the rules page by page."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.operators import chunking, pages

BLOCKS = "page string, block_id long, x0 double, y0 double, x1 double, y1 double, width double, height double, text string"
TABLES = "page string, table_id long, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"


def tokens(text):
    n = len(text.split())
    return max(1, round(n * 1.3)) if n else 0


def box(blocks):
    return min(b[1] for b in blocks), min(b[2] for b in blocks), max(b[3] for b in blocks), max(b[4] for b in blocks)


def plain_clusters(blocks, reach):
    """Grows each cluster from its first block until nothing near is left."""
    left, out = list(blocks), []
    while left:
        grown = [left.pop(0)]
        for b in grown:
            near = [c for c in left if max(b[1] - c[3], c[1] - b[3], b[2] - c[4], c[2] - b[4]) <= reach]
            left = [c for c in left if c not in near]
            grown += near
        out.append(sorted(grown, key=lambda b: (b[2], b[1], b[0])))
    return sorted(out, key=lambda g: (g[0][2] // 36, g[0][1], min(b[0] for b in g)))


def plain_chunks(blocks, width, height):
    blocks = [b for b in blocks if b[5].split()]
    groups = []
    for cluster in plain_clusters(blocks, max(18, 0.02 * min(width, height))):
        if groups and sum(tokens(b[5]) for b in groups[-1]) < 400:
            x0, y0, x1, y1 = box(groups[-1] + cluster)
            if (x1 - x0) * (y1 - y0) <= width * height / 4:
                groups[-1] += cluster
                continue
        groups.append(cluster)
    out = []
    for group in groups:
        held = []
        for b in [*group, None]:
            n = tokens(b[5]) if b else 0
            now = sum(tokens(x[5]) for x in held)
            if held and (b is None or n > 800 or (now >= 400 and now + n > 800)):
                out.append(("\n".join(x[5].strip() for x in held), box(held)))
                # the longest end of at most 100 tokens, or the last block alone where it is larger
                ends = [held[k:] for k in range(1, len(held)) if sum(tokens(x[5]) for x in held[k:]) <= 100 or k == len(held) - 1]
                whole = sum(tokens(x[5]) for x in held) <= 100
                held = [] if whole or not ends else ends[0]
            if b and n > 800:
                words, held, at = b[5].split(), [], 0
                while True:
                    out.append((" ".join(words[at : at + 615]), box([b])))
                    if at + 615 >= len(words):
                        break
                    at += 615 - 76
            elif b:
                held.append(b)
    return out


def random_blocks(seed, n):
    r = random.Random(seed)
    lengths = [1, 3, 20, 60, 90, 200, 500, 616, 1500]
    place = lambda: (r.uniform(0, 900), r.uniform(0, 700))
    out = []
    for i in range(n):
        x, y = place()
        text = " ".join(f"w{r.randrange(50)}" for _ in range(r.choice(lengths))) if r.random() > 0.05 else r.choice(["", " \n"])
        out.append((i, x, y, x + r.uniform(5, 80), y + r.uniform(5, 30), text))
    return out


def test_page_chunks_follow_the_rules(spark):
    made = {f"p{s}": random_blocks(s, 5 + 12 * s) for s in range(6)}
    rows = [(p, b[0], *b[1:5], 1000.0, 800.0, b[5]) for p, bs in made.items() for b in bs]
    got = pages.page_chunks(spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], TABLES)).collect()
    want = [(p, text, tokens(text), *(round(v, 6) for v in (x0, y0, x1 - x0, y1 - y0))) for p, bs in made.items() for text, (x0, y0, x1, y1) in plain_chunks(bs, 1000, 800)]
    assert sorted((r["page"], r["text"], r["tokens"], *(round(r[c], 6) for c in "xywh")) for r in got) == sorted(want)


def test_tables_take_their_blocks(spark):
    table = [["MARK", "SIZE"], ["A|1", None], ["", " "], *[[f"B{i}", "w " * 140] for i in range(6)]]
    tables = spark.createDataFrame([("p", 1, 0.0, 0.0, 100.0, 100.0, table), ("p", 2, 500.0, 500.0, 600.0, 600.0, [["one"]])], TABLES)
    sizes = (1000.0, 800.0)
    blocks = [("p", 1, 10.0, 10.0, 20.0, 20.0, *sizes, "cell"), ("p", 2, 90.0, 90.0, 150.0, 150.0, *sizes, "caption"), ("p", 3, 510.0, 510.0, 520.0, 520.0, *sizes, "not a table"), ("p", 4, 5.0, 5.0, 5.0, 9.0, *sizes, "flat")]
    got = pages.page_chunks(spark.createDataFrame(blocks, BLOCKS), tables).orderBy("kind", "band", "x").collect()
    assert [r["kind"] for r in got].count("table") == len({r["text"] for r in got if r["kind"] == "table"})
    assert all(r["text"].startswith("| MARK | SIZE |\n| --- | --- |\n") for r in got if r["kind"] == "table")
    assert "| A\\|1 |  |" in "\n".join(r["text"] for r in got)
    assert "\n".join(r["text"] for r in got if r["kind"] == "text").split("\n") == ["caption", "not a table"]


def test_a_crowded_page_is_one_cluster(spark, monkeypatch):
    monkeypatch.setattr(chunking, "PAGE_BOXES", 5)
    rows = spark.range(10).select(F.when(F.col("id") < 6, F.lit("full")).otherwise(F.lit("few")).alias("page"), F.col("id").alias("box_id"), *[(F.col("id") * 100 + k).cast("double").alias(c) for k, c in ((0, "x0"), (0, "y0"), (9, "x1"), (9, "y1"))], F.lit(1000.0).alias("width"), F.lit(None).cast("double").alias("height"))
    got = {(r["page"], r["box_id"]): r["cluster"] for r in chunking.clusters(rows, "page").collect()}
    assert {c for (p, _), c in got.items() if p == "full"} == {0}
    assert len({c for (p, _), c in got.items() if p == "few"}) == 4


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_tables_are_cut_in_their_own_row(spark):
    """One of many rows too: no shuffle, no row of Python for each line; the sizes that begin a piece are as before."""
    lines = [[f"B{i}", "w " * (140 if i % 7 else 700)] for i in range(60)]
    tables = spark.createDataFrame([("p", 1, 0.0, 0.0, 9.0, 9.0, [["MARK", "SIZE"], *lines])], TABLES)
    made = pages.table_chunks(tables.withColumn("rows", F.transform("rows", lambda r: F.transform(r, lambda x: F.left(x, F.lit(290))))))
    assert "Exchange" not in plan_of(made) and "InPandas" not in plan_of(made)
    rows, pieces, size = [[c[:290] for c in r] for r in lines], [], 10_000
    for r in rows:
        n = tokens(" ".join(c.strip() for c in r))
        if size + n > 800:
            pieces, size = [*pieces, []], tokens("| MARK | SIZE |\n| --- | --- |")
        pieces[-1].append(r)
        size += n
    got = {r["piece"]: r["text"].split("\n")[2:] for r in made.collect()}
    assert got == {k: [f"| {a} | {b.strip()} |" for a, b in p] for k, p in enumerate(pieces)} and len(got) > 5


def test_a_page_is_shuffled_twice(spark):
    """Once for its clusters, once for its groups and chunks."""
    blocks = spark.createDataFrame([("p", 1, 0.0, 0.0, 1.0, 1.0, 9.0, 9.0, "a")], BLOCKS)
    assert plan_of(pages.block_chunks(pages.merged_clusters(blocks))).count("Exchange hashpartitioning") == 2


def test_pages_cross_batches(spark, monkeypatch):
    """A page whose rows lie in several batches is clustered as one."""
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    rows = spark.range(200).selectExpr("id % 9 as page", "id as box_id", "cast(id div 9 * 20 + if(id div 9 > 10, 100, 0) as double) as x0", "0D as y0", "cast(id div 9 * 20 + if(id div 9 > 10, 100, 0) + 9 as double) as x1", "9D as y1", "0D as width", "0D as height")
    got = {r["box_id"]: r["cluster"] for r in chunking.clusters(rows, "page").collect()}
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert got == {i: i % 9 + (0 if i // 9 <= 10 else 99) for i in range(200)}


def test_crowded_pages_are_grouped_too(spark, monkeypatch):
    """Chunks don't depend on how many boxes count as many, nor on the batches that a page's rows come in."""
    made = {f"p{s}": random_blocks(s + 20, 8 + 15 * s) for s in range(5)}
    rows = [(p, b[0], *b[1:5], 1000.0, 800.0, b[5]) for p, bs in made.items() for b in bs]
    blocks, none = spark.createDataFrame(rows, BLOCKS), spark.createDataFrame([], TABLES)
    want = sorted((p, text, tokens(text)) for p, bs in made.items() for text, _ in plain_chunks(bs, 1000, 800))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    for most, batch in ((4000, "10000"), (20, "10000"), (20, "7"), (1, "7")):
        monkeypatch.setattr(chunking, "PAGE_BOXES", most)
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
        got = pages.page_chunks(blocks, none).collect()
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
        assert sorted((r["page"], r["text"], r["tokens"]) for r in got) == want, (most, batch)


def test_stretches_lose_no_neighbour():
    """The sweep against all pairs: boxes of all shapes, equal places, sides out of order or unknown."""
    r, nan = random.Random(11), float("nan")
    for trial in range(400):
        side = lambda: float(r.randrange(60)) if r.random() > 0.03 else nan  # noqa: B023, E731
        boxes = [(x, y, x + r.choice([0, 1, 3, 9, 40, -2]), y + r.choice([0, 1, 3, 9, 40, *([-2, nan] if trial % 2 else [])])) for x, y in ((side(), side() if trial % 2 else float(r.randrange(60))) for _ in range(r.randrange(2, 60)))]
        boxes.sort(key=lambda b: (b[0] != b[0], b[0]))
        found = chunking.Near(reach := r.choice([0.0, 1.0, 2.5]))
        for i, b in enumerate(boxes):
            found.add(*b, i)
        label = list(range(len(boxes)))
        for i, b in enumerate(boxes):
            for j, c in enumerate(boxes[:i]):
                if c[2] + reach >= b[0] and max(0.0, c[1] - b[3], b[1] - c[3]) <= reach:
                    old, new = sorted((label[i], label[j]), reverse=True)
                    label = [new if x == old else x for x in label]
        assert found.found() == label, (trial, boxes)
