"""Ranked search against plain scoring of every document."""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from quillspark.llm import common, ranked_search

SCHEMA = "doc_id long, text string, term string, score string, rank int"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, queries, k=10):
    held = [(i, Counter(words_of(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n_docs, n_terms = len(held), sum(sum(c.values()) for _, c in held)
    df = Counter(w for _, c in held for w in c)
    out = []
    for item, text in queries:
        scores = []
        for i, c in held:
            m = 100 - 75 + (75 * sum(c.values()) * n_docs) // n_terms
            score = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * ((10**9 * c[w]) // (1000 * c[w] + 8 * m)) for w in words_of(text) if w in c)
            if score > 0:
                scores.append((-score, i is None, i or 0, i))
        out += [(item, r + 1, i, -s) for r, (s, _, _, i) in enumerate(sorted(scores, key=lambda x: x[:3])[:k])]
    return sorted(out, key=str)


def frame(spark, docs):
    return spark.createDataFrame([(i, t, "x", "y", 1) for i, t in docs], SCHEMA)


def items(spark, queries):
    return spark.createDataFrame([(i, t, 5) for i, t in queries], "item_id long, text string, doc_id int")


def got(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


@pytest.fixture(scope="module")
def corpus():
    rng, vocabulary = np.random.default_rng(5), [f"w{k}" for k in range(60)] + ["é", "ÀB", "naïve", "7"]
    weights = 1 / np.arange(1, len(vocabulary) + 1)
    draw = lambda size: " ".join(rng.choice(vocabulary, size, p=weights / weights.sum()))
    docs = [(k, draw(int(rng.integers(1, 80)))) for k in range(300)]
    docs += [(1000 + k, "w1 W2 common-passage w9") for k in range(40)]  # copies: ties
    docs += [(400, None), (401, ""), (402, "... !"), (403, "w3 " * 30_000 + "é"), (None, "w5 w5 é"), (None, "w5 w5 é"), (7, draw(20)), (7, "w5 w5 é")]
    queries = [(k, draw(int(rng.integers(1, 30)))) for k in range(25)] + [(90, None), (91, ""), (92, "unknown words only"), (93, "w1 w2 w9 w1 common"), (93, "w5 é"), (None, "w5 É w5"), (94, "w0 " * 500)]
    return docs, queries


def test_matches_plain(spark, corpus):
    docs, queries = corpus
    index = ranked_search.build(frame(spark, docs))
    assert got(ranked_search.search(index, items(spark, queries), "item_id")) == plain(docs, queries)


def test_small_segments_and_blocks(spark, corpus):
    """Many segments a task, and a block for nearly every query."""
    docs, queries = corpus
    index = ranked_search.build(frame(spark, docs).repartition(3), segment_docs=7, segment_postings=40)
    assert index.segments.count() > 40
    for k in (1, 10, 1000):
        assert got(ranked_search.search(index, items(spark, queries[:12] + queries[-7:]), "item_id", k, block_terms=20)) == plain(docs, queries[:12] + queries[-7:], k)


def test_bounds_hold_and_spare_work(spark):
    """A byte times its step is at least the impact and less than a step above; few documents are scored again."""
    rng = np.random.default_rng(1)
    docs = [(k, " ".join(f"w{x}" for x in rng.zipf(1.3, int(rng.integers(20, 300))) if x < 2000)) for k in range(2000)]
    index = ranked_search.build(frame(spark, docs).coalesce(1))
    table = index.segments.toArrow().combine_chunks()
    batch = table.to_batches()[0]
    df = ranked_search._listed(batch, 0, "df")
    levels, tf = ranked_search._packed(batch, 0, "levels", np.uint8).astype(np.int64), ranked_search._packed(batch, 0, "tf", np.uint32)
    lengths = ranked_search._packed(batch, 0, "lengths", np.int32)[ranked_search._packed(batch, 0, "places", np.uint32)]
    exact, step = ranked_search._impacts(tf, lengths, index.n_docs, index.n_terms), np.repeat(ranked_search._listed(batch, 0, "steps").astype(np.int64), df)
    assert batch.num_rows == 1 and (levels * step >= exact).all() and (levels * step - step < exact).all() and levels.max() <= 255
    vocabulary = ["w40", "w7", "w300"]
    total = dict(zip(batch.column("terms")[0].as_py(), df.tolist(), strict=True))
    own = [(np.arange(3), np.array([ranked_search.weight(index.n_docs, total[w]) for w in vocabulary]))]
    again = ranked_search._search_segment(batch, 0, pa.array(vocabulary), own, index.n_docs, index.n_terms, ranked_search._Best(1, 10))
    assert 10 <= again <= 60


def test_empty_tables(spark, corpus):
    docs, queries = corpus
    none, words = frame(spark, []), frame(spark, docs[:20])
    assert got(ranked_search.search(ranked_search.build(none), items(spark, queries), "item_id")) == []
    assert got(ranked_search.search(ranked_search.build(words), items(spark, []), "item_id")) == []


def test_session_keeps_its_batches(spark, corpus):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    got(ranked_search.search(ranked_search.build(frame(spark, corpus[0][:50])), items(spark, corpus[1][:3]), "item_id"))
    assert spark.conf.get(name) == before
    with pytest.raises(ValueError), common.batches_of(spark, 3):
        raise ValueError
    assert spark.conf.get(name) == before
