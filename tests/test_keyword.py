"""Stems against a plain stemmer, keyword search against a plain rank."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions import stemming
from quillspark.operators import keyword, retrieval

from .plain_stemmer import stem

# A few published pairs of the algorithm's sample vocabulary.
KNOWN = dict(consistency="consist", knightly="knight", consigned="consign", consolidating="consolid", conspicuously="conspicu", generate="generat", generously="generous", knots="knot", skies="sky", hoping="hope", hopping="hop", falling="fall", relational="relat", operator="oper", beauty="beauti", playing="play", by="by", yes="yes", cries="cri", ties="tie", gas="gas", gaps="gap", proceeds="proceed", communication="communic", s102a="s102a")


def words():
    rng = random.Random(4)
    ends = ["", *"s ies ied sses us ss eed eedly ed edly ing ingly y ational tional enci anci abli entli izer ization alism aliti alli fulness ousli ousness iveness iviti biliti bli ogi logi fulli lessli li icate iciti ical ful ness ative al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize ion tion sion e l ll".split()]
    starts = ["".join(rng.choice("aeiouybcdfghklmnprstwxz") for _ in range(rng.randint(1, 6))) for _ in range(60)] + ["gener", "commun", "arsen", "hop", "fall", "y", "yy", "ayyy", "bl", "at", "iz", "luxuriat"]
    return sorted({a + b for a, b in itertools.product(starts, ends) if a + b} | set(KNOWN) | {"inning", "outings", "earring", "dying", "news", "andes", "a1", "12", "abc4"})


def test_stems(spark):
    df = spark.createDataFrame([(w,) for w in words()], "w string")
    got = {r["w"]: r["s"] for r in df.select("w", stemming.stem(F.col("w")).alias("s")).collect()}
    assert {w: got[w] for w in KNOWN} == KNOWN
    assert {w: (s, stem(w)) for w, s in got.items() if s != stem(w)} == {}


def plain(chunks, questions, k):
    lex = lambda t: [stem(w) for w in re.findall("[a-z0-9]+", (t or "").lower()) if w not in retrieval.STOP_WORDS]
    held = [(i, Counter(lex(t))) for i, t in chunks]
    out = []
    for q, t in questions:
        asked = set(lex(t))
        scores = []
        for i, c in held:
            found = [sum(1 / j**2 for j in range(1, c[s] + 1)) for s in asked if c[s]]
            if found:
                scores.append((-round(sum(0.1 * x / 1.64493406685 for x in found) / len(asked), 9), i))
        out += [(q, i, -s, r + 1) for r, (s, i) in enumerate(sorted(scores)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(9)
    vocabulary = "beam beams column columns framing framed frames slab slabs detail details the of is running runs ran w12x26 s102a".split()
    chunks = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 25)))) for k in range(150)] + [(900, None), (901, ""), (902, "the of is"), (903, "Beams; BEAM-beamed!"), (904, "slab " * 3000)]
    questions = [(k, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(0, 5)))) for k in range(30)] + [(99, None), (98, "what is the"), (97, "beam"), (96, "zzz")]
    return chunks, questions


def test_matches_plain_rank(spark, corpus):
    chunks, questions = corpus
    index = keyword.index(spark.createDataFrame(chunks, "chunk_id int, text string"))
    got = keyword.search(index, spark.createDataFrame(questions, "query_id int, question string"), 7)
    assert sorted(tuple(r) for r in got.select("query_id", "chunk_id", "score", "rank").collect()) == plain(chunks, questions, 7)


def test_hot_stem_is_dealt(spark, corpus):
    """A stem that all chunks hold and all questions ask for goes to many tasks, with the same result."""
    chunks, questions = [(k, "beam") for k in range(200)], [(k, "beams" if k % 2 else "beam") for k in range(100)]
    index = keyword.index(spark.createDataFrame(chunks, "chunk_id int, text string"))
    asked = keyword.stems_asked(spark.createDataFrame(questions, "query_id int, question string"))
    assert [(r["stem"], r["df"], r["parts"]) for r in keyword.parts(index, asked, pairs=1000).collect()] == [("beam", 200, 20)]
    joined = keyword.met(index, asked, pairs=1000)
    assert joined.count() == 20_000
    assert sorted(tuple(r) for r in keyword.search(index, spark.createDataFrame(questions, "query_id int, question string"), 3, pairs=1000).select("query_id", "chunk_id", "score", "rank").collect()) == plain(chunks, questions, 3)


def test_index_is_stored_by_stem(spark, corpus):
    index = keyword.index(spark.createDataFrame(corpus[0], "chunk_id int, text string"))
    files = index.select("stem", F.input_file_name().alias("f")).distinct().groupBy("stem").count()
    assert index.inputFiles() and files.filter("count > 1").count() <= 3 and index.filter("stem = 'frame'").count() > 0
