"""Operators whose results SQL can't give, and their edge cases, on small rows."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillspark.functions import domain, text
from quillspark.operators import chunking, geometry, merge, numbering, portions, retrieval
from quillspark.plans import domain_queries, queries  # noqa: F401  (domain_queries registers its queries)
from quillspark.sources import tables
from quillspark.streaming import jobs


def test_superseded_documents_take_no_numbers(spark):
    docs = spark.createDataFrame([("p", "a", 1, 2, None), ("p", "b", 2, 3, "2024-01-01"), ("p", "c", 3, 1, None)], "project string, id string, created_at int, pages int, superseded_at string")
    rows = numbering.manifest(docs, "project", "id", F.col("created_at"), ["created_at", "id"]).orderBy("combined_page").collect()
    assert [(r["id"], r["page_number"], r["combined_page"]) for r in rows] == [("a", 1, 1), ("a", 2, 2), ("c", 1, 3)]


def test_fill_goes_forward_then_back(spark):
    rows = spark.createDataFrame([("p", 1, None), ("p", 2, "S"), ("p", 3, None), ("q", 1, None)], "project string, page int, discipline string")
    got = numbering.filled(rows, "project", F.col("page"), ["page"], "discipline").orderBy("project", "page").collect()
    assert [r["filled"] for r in got] == ["S", "S", "S", "unclassified"]


@pytest.mark.parametrize(("printed", "inches"), [('8"', 8.0), ("1'-4 1/2\"", 16.5), ("EL. 104'-6\"", 1254.0), ("-2'", -24.0), ("about 3", None), ("", None)])
def test_printed_lengths(spark, printed, inches):
    got = spark.createDataFrame([(printed,)], "c string").select(text.feet_inches(F.col("c"))).first()[0]
    assert got == inches


@pytest.mark.parametrize(("body", "found"), [("SEE S-501 AND A2.81.01", ["A28101", "S501"]), ("W12x26 on s-100", ["W12X26"]), (None, [])])
def test_identifiers(spark, body, found):
    assert spark.createDataFrame([(body,)], "c string").select(text.identifiers(F.col("c"))).first()[0] == found


def test_blank_texts_have_no_tokens(spark):
    got = spark.createDataFrame([("",), (" \n",), ("one",), ("a b c d e",)], "c string").select(text.estimated_tokens(F.col("c"))).collect()
    assert [r[0] for r in got] == [0, 0, 1, 6]


def test_packing_closes_between_target_and_most(spark):
    blocks = spark.createDataFrame([("p", i, t) for i, t in enumerate([300, 200, 400, 900, 10])], "page string, at int, tokens int")
    got = chunking.packed(blocks, "page", "at").orderBy("at").collect()
    assert [r["chunk"] for r in got] == [0, 0, 1, 2, 3]


def test_clusters_join_by_gap(spark):
    boxes = spark.createDataFrame([("p", 1, 0.0, 0.0, 10.0, 10.0), ("p", 2, 25.0, 0.0, 30.0, 10.0), ("p", 3, 100.0, 0.0, 110.0, 10.0), ("p", 4, 100.0, 20.0, 110.0, 30.0)], "page string, box_id long, x0 double, y0 double, x1 double, y1 double")
    boxes = boxes.withColumn("width", F.lit(600.0)).withColumn("height", F.lit(400.0))
    assert {r["box_id"]: r["cluster"] for r in chunking.clusters(boxes, "page").collect()} == {1: 1, 2: 1, 3: 3, 4: 3}


def test_fusion_breaks_ties_by_id(spark):
    a = spark.createDataFrame([(1, 10, 1), (1, 11, 2)], "query_id int, chunk_id int, rank int")
    b = spark.createDataFrame([(1, 11, 1), (1, 10, 2)], "query_id int, chunk_id int, rank int")
    assert [r["chunk_id"] for r in retrieval.fuse([(a, 1.0), (b, 1.0)]).orderBy("rank").collect()] == [10, 11]


def test_only_stop_words_find_nothing(spark):
    chunks = spark.createDataFrame([(1, "the steel beam")], "chunk_id int, text string")
    asked = spark.createDataFrame([(1, "what is the"), (2, "steel")], "query_id int, question string")
    assert [r["query_id"] for r in retrieval.by_keyword(chunks, asked).collect()] == [2]


def test_ambiguous_shift_is_refused(spark):
    lines = spark.createDataFrame([("p", float(x)) for x in range(0, 100, 10)], "pair string, position double")
    assert geometry.vote_shift(lines, lines.filter("position < 50"), "pair", 1.0, least=3, margin=2).count() == 0


def test_corroborated_stays_high(spark):
    stored = spark.createDataFrame([("a", "pending", "high", "w", True), ("b", "accepted", "low", "w", False)], "fingerprint string, status string, confidence string, wording string, corroborated boolean")
    found = spark.createDataFrame([("a", "low", None), ("b", "high", "n"), ("c", "low", "n")], "fingerprint string, confidence string, wording string")
    got = {r["fingerprint"]: (r["status"], r["confidence"], r["wording"]) for r in merge.merge_candidates(stored, found).collect()}
    assert got == {"a": ("pending", "high", "w"), "b": ("accepted", "low", "w"), "c": ("pending", "low", "n")}


def test_upsert_keeps_identities(spark):
    stored = spark.createDataFrame([("x", 1, 5), ("y", 2, 6)], "k string, id int, v int")
    new = spark.createDataFrame([("x", 9, 7), ("z", 3, 8)], "k string, id int, v int")
    assert sorted(map(tuple, merge.upsert_keeping(stored, new, ["k"], "id").collect())) == [("x", 1, 7), ("z", 3, 8)]


def test_gap_filling_and_actions(spark):
    stored = spark.createDataFrame([(1, None, "t"), (2, "l", None)], "id int, level string, title string")
    new = spark.createDataFrame([(1, "n", "n"), (2, "n", "n")], "id int, level string, title string")
    assert sorted(map(tuple, merge.filled_gaps(stored, new, "id", ["level", "title"]).collect())) == [(1, "n", "t"), (2, "l", "n")]
    seen = spark.createDataFrame([("a", "resolved"), ("b", "pending")], "fingerprint string, status string")
    found = spark.createDataFrame([("a",), ("b",), ("c",)], "fingerprint string")
    assert sorted(map(tuple, merge.actions(found, seen).collect())) == [("a", "reopen"), ("b", "keep"), ("c", "new")]


def test_missing_references_stay(spark):
    pages = spark.createDataFrame([("p", 1, "S-1", ["S-2", "S 9"]), ("p", 2, "S-2", [])], "project string, page_id int, sheet string, refs array<string>")
    got = {r["key"]: r["missing"] for r in portions.sheet_map(pages).collect()}
    assert got == {"S2": False, "S9": True}


def test_cache_split(spark):
    texts = spark.createDataFrame([("a",), ("a",), ("b",)], "text string")
    cache = texts.filter("text = 'a'").select(F.sha2("text", 256).alias("text_hash"), F.array(F.lit(1.0)).alias("vector")).distinct()
    have, need = retrieval.cached_or_missing(texts, cache)
    assert have.count() == 1 and [r["text"] for r in need.collect()] == ["b"]


def test_readers_and_partition_sink(spark, tmp_path):
    (tmp_path / "a.csv").write_text("n,topic,question\n2,x,second\n1,x,first\n")
    got = tables.library(spark, f"file://{tmp_path}/a.csv", "n int, topic string, question string", "topic").first()
    assert [q["question"] for q in got["questions"]] == ["first", "second"]
    (tmp_path / "b.json").write_text('{"k": 1}\nnot json\n')
    assert tables.json_lines(spark, f"file://{tmp_path}/b.json", "k int, _corrupt_record string").filter("k = 1").count() == 1
    assert tables.files(spark, f"file://{tmp_path}", "*.csv").count() == 1
    out = f"file://{tmp_path}/out"
    rows = spark.createDataFrame([(1, "a"), (2, "b")], "v int, page string")
    tables.replace_partitions(rows, out, "page")
    tables.replace_partitions(spark.createDataFrame([(3, "a")], "v int, page string"), out, "page")
    assert sorted(map(tuple, spark.read.parquet(out).select("v", "page").collect())) == [(2, "b"), (3, "a")]


T = dt.datetime(2024, 1, 1)


def test_rate_limit_starts_at_first_hit(spark):
    hits = spark.createDataFrame([("u", T + dt.timedelta(seconds=s)) for s in (50, 55, 70, 105, 111)], "user string, ts timestamp")
    assert [r["allowed"] for r in jobs.limited_batch(hits, "user", "ts", 60, 2).orderBy("ts").collect()] == [True, True, False, False, True]
    assert jobs.limited_batch(hits, "user", "ts", 60, 0).filter("allowed").count() == 5


def test_streams(spark, tmp_path):
    rows = spark.createDataFrame([("u", "j1", T, 1.0), ("u", "j1", T, 1.0), ("u", "j2", T + dt.timedelta(seconds=5), 2.0)], "user string, job string, ts timestamp, value double")
    rows.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in")

    def run(df, name, mode):
        q = df.writeStream.outputMode(mode).format("memory").queryName(name).option("checkpointLocation", f"{tmp_path}/{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        return spark.table(name)

    assert run(jobs.once(stream, "job", "ts", "1 minute"), "once", "append").count() == 2
    assert run(jobs.per_window(stream, "ts", "1 minute", "0 seconds", "user"), "windows", "complete").first()["n"] == 3
    assert run(jobs.limited_stream(stream, "user", "ts", 60, 2), "limits", "append").filter("allowed").count() == 2


@pytest.mark.parametrize(
    ("body", "discipline"),
    [("LICENSE NO. F-1105\nSEE A-101 HERE\n S-201 ", "structural"), ("JOB NO G-1000\ntype A-101 here", "architectural"), ("TYPE E2\nM1", "mechanical"), ("License F-1105", "fire_protection"), ("nothing", None), (None, None)],
)
def test_discipline_tiers(spark, body, discipline):
    assert spark.createDataFrame([(body,)], "c string").select(domain.discipline_by_rules(F.col("c"))).first()[0] == discipline


def test_levels(spark):
    got = spark.createDataFrame([(["LEVEL 7-9", "LEVEL 8", "ROOF"],)], "c array<string>").select(domain.expanded_levels(F.col("c"))).first()[0]
    assert got == ["LEVEL 7", "LEVEL 8", "LEVEL 9", "ROOF"]
    names = ["ROOF", "LEVEL 10", "LEVEL 2", "GROUND", "LEVEL B1", "LEVEL B2", "ATTIC"]
    rows = spark.createDataFrame([(n,) for n in names], "c string").orderBy(domain.level_rank(F.col("c"))).collect()
    assert [r[0] for r in rows] == ["LEVEL B2", "LEVEL B1", "GROUND", "LEVEL 2", "LEVEL 10", "ROOF", "ATTIC"]
    title = spark.createDataFrame([("Forming Plans -  level 7-13",), ("LEVEL 3",)], "c string").select(domain.plan_title(F.col("c")).alias("t")).collect()
    assert tuple(title[0]["t"]) == ("FORMING PLAN", 7, 13) and title[1]["t"] is None


def test_grounded_wording(spark):
    rows = [("Beam B12 is 1,200 long", "b12: 1200 mm"), ("Beam B13", "b12"), ("3 beams", "two beams")]
    got = spark.createDataFrame(rows, "w string, e string").select(domain.grounded(F.col("w"), F.col("e"))).collect()
    assert [r[0] for r in got] == [True, False, False]


def test_merged_whole_summaries_keep_long_turns(spark, tmp_path):
    turns = [(1, k, "u", f"{k}:" + "x" * 60) for k in range(5)] + [(2, 0, "u", "y" * 2000), (2, 1, "u", "z")]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r["portion"]: (r["overview"], r["items"]) for r in queries.QUERIES["merged_whole_summaries"](spark, str(tmp_path)).collect()}
    assert got == {1: (" ".join(t for c, _, _, t in turns if c == 1), "0,1,2,3,4"), 2: ("y" * 1500, "0,1")}


def test_merged_summaries_bound_a_large_portion(spark):
    """Equal to joining everything; and few of a large portion's rows are collected."""
    rows = [(7, k // 3, None if k % 11 == 0 else "ab" * (k % 4) + str(k), [] if k % 5 else [f"i{k}", "j"]) for k in range(4000)]
    rows += [(8, None, "n", None), (8, 1, None, []), (None, 1, "k", ["a"]), (9, 1, None, None)]
    lower = spark.createDataFrame(rows, "portion long, at long, overview string, items array<string>").repartition(5)
    got = {r["portion"]: (r["overview"], r["items"]) for r in portions.merged_summaries(lower, ["portion"]).collect()}
    mine = sorted((r for r in rows if r[0] == 7), key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3]))
    whole = " ".join(r[2] for r in mine if r[2] is not None)[:1500], [x for r in mine for x in r[3]][:20]
    assert got == {7: whole, 8: ("n", []), None: ("k", ["a"]), 9: ("", [])}
    seen = []
    collect = F.collect_list
    try:
        portions.F.collect_list = lambda c: (seen.append(1), F.slice(collect(c), 1, 1600))[1]
        assert {r["portion"]: (r["overview"], r["items"]) for r in portions.merged_summaries(lower, ["portion"]).collect()} == got and seen
    finally:
        portions.F.collect_list = collect


def test_request_forms_read_the_documents(spark, tmp_path):
    """A form in a document's own text is found, wherever it stands; a planted one is found beside any text."""
    rows = [(1, "memo\nRFI No. 12\nQuestion: a\nAnswer: b"), (2, "Request for\tinformation. " + "x " * 5000 + "Author: c\nSuggestion: d"), (3, "plain"), (4, "RFI: the response alone, response"), (5, "an answer, a reply"), (6, None), (7, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["by_text"] for r in queries.QUERIES["request_forms"](spark, str(tmp_path)).collect()}
    assert got == {1: True, 2: True, 3: True, 4: False, 5: False, 6: True, 7: False}
