"""Search meets sets of equal questions and equal chunks once; the same ranks as row by row."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from quillspark.operators import keyword, retrieval

from .test_keyword import plain


def test_copies_are_met_once(spark, monkeypatch):
    """40,000 pairs of equal questions and chunks are one pair of sets."""
    joined = []
    met = keyword.met
    monkeypatch.setattr(keyword, "met", lambda *a: joined.append(met(*a).count()) or met(*a))
    chunks, questions = [(k, f"slab {k}") for k in range(400)], [(k, "slabs") for k in range(100)]
    index = keyword.index(spark.createDataFrame(chunks, "chunk_id int, text string"))
    got = keyword.search(index, spark.createDataFrame(questions, "query_id int, question string"), 5)
    assert sorted(tuple(r) for r in got.collect()) == plain(chunks, questions, 5)
    assert joined == [1]


def test_identifiers_in_sets(spark):
    rng = random.Random(5)
    names = ["S-1", "S-2", "A-10", "M1.5"]
    chunks = [(k, " ".join(rng.choice(names) for _ in range(rng.randint(0, 3)))) for k in range(300)]
    questions = [(k, "see " + " ".join(rng.choice(names) for _ in range(rng.randint(0, 3)))) for k in range(40)]
    df = spark.createDataFrame(chunks, "chunk_id int, text string")
    got = retrieval.by_identifier(retrieval.identifier_index(df), spark.createDataFrame(questions, "query_id int, question string"), 7)
    want = []
    for q, t in questions:
        hits = sorted((-len(set(t.split()[1:]) & set(c.split())), i) for i, c in chunks)
        want += [(q, i, -n, r + 1) for r, (n, i) in enumerate(hits[:7]) if n]
    assert sorted(tuple(r) for r in got.select("query_id", "chunk_id", "hits", F.col("rank")).collect()) == want
