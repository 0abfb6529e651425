"""Source divergence against plain Python over all terms of all pairs."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np

from quillspark.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, n int, value string"


def plain(rows, least=10, most=10):
    """(lang, source, part, item, value, rank) from (text, lang, source) rows, term by term."""
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")), la or "", s or "") for t, la, s in rows]
    df, total, counts = defaultdict(Counter), defaultdict(Counter), {}
    for words, lang, source in docs:
        df[lang].update(set(words))
        total[lang].update(words)
        counts.setdefault((lang, source), Counter()).update(words)
    out = []
    for (lang, source), n in counts.items():
        kept = [w for w in df[lang] if df[lang][w] >= least]
        share = lambda c, kept=kept: {w: 1 + 10**9 * (c[w] + 2) // (sum(c[x] for x in kept) + 2 * len(kept)) for w in kept}
        p, q = share(n), share(total[lang])
        pairs = []
        for (other_lang, item), m in counts.items():
            if other_lang == lang and item != source:
                r = share(m)
                pairs.append((item, sum((p[w] - r[w]) ** 2 // (p[w] + r[w]) for w in kept)))
        found = [(w, (p[w] - q[w]) ** 2 // (p[w] + q[w])) for w in kept if n[w] > 0 and p[w] > q[w]]
        for part, items, ranks in (("pair", pairs, None), ("term", found, most)):
            order = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:ranks]
            out += [(lang, source, part, item, value, k + 1) for k, (item, value) in enumerate(order)]
    return sorted(out)


def frame(spark, rows):
    return spark.createDataFrame([(1, t, la, s, "x", 7, "y") for t, la, s in rows], SCHEMA)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def test_matches_plain(spark):
    rng, words = np.random.default_rng(3), [f"w{k}" for k in "abcdefghijklmnop"] + ["ÀÉ", "naïve", "A-Z", "x1y"]
    rows = []
    for k in range(120):
        some = rng.choice(words, int(rng.integers(0, 40))).tolist()
        rows.append((" ".join(some), ("en", "de", None)[k % 3], ("a", "b", "é", None, "")[int(rng.integers(0, 5))]))
    rows += [(None, "en", "empty"), ("", "en", "empty"), ("rare words only", "xx", "one"), ("rare words", "xx", "two"), (None, None, None)] + rows[:7]
    assert got(divergence.audit(frame(spark, rows))) == plain(rows)
    assert got(divergence.audit(frame(spark, rows), least_docs=3, most_terms=2)) == plain(rows, 3, 2)


def test_hot_source_and_ties(spark):
    """A source with most rows, equal sources (value 0 and ties), a very long text."""
    text = "one two three four five"
    rows = [(text, "en", "hot")] * 300 + [(text, "en", s) for s in ("b", "c", "B") for _ in range(12)] + [("two " * 40_000 + "one", "en", "long")]
    assert got(divergence.audit(frame(spark, rows))) == plain(rows)


def test_large_counts_are_exact(spark):
    """Shares of counts whose products leave 64 bits."""
    rows = [(n, d) for n in (0, 1, 9_223_372_037, 10**15, 2**62) for d in (7, 10**16, 2**62 + 5) if n + 2 <= d]
    df = spark.createDataFrame(rows, "n long, d long")
    for r in df.select("n", "d", divergence.share(df.n, df.d).alias("p")).collect():
        assert r["p"] == 1 + 10**9 * (r["n"] + 2) // r["d"]
    ends = spark.createDataFrame([(1, 10**9 + 1), (10**9 + 1, 1), (5, 5), (3, 4)], "p long, q long")
    assert [r[0] for r in ends.select(divergence.apart(ends.p, ends.q)).collect()] == [(p - q) ** 2 // (p + q) for p, q in ((1, 10**9 + 1), (10**9 + 1, 1), (5, 5), (3, 4))]


def test_empty(spark):
    assert got(divergence.audit(frame(spark, []))) == []


def test_sums_pass_on_in_parts(spark, monkeypatch):
    """Few held terms: sums leave the task in many parts and still add up."""
    rows = [(f"a b c{'vwxyz'[k % 5]} d", "en", f"s{k % 3}") for k in range(60)]
    monkeypatch.setattr(divergence, "PART_CHARS", 20)
    batch = frame(spark, rows).select("lang", "source", "text").toArrow().combine_chunks().to_batches()[0]
    monkeypatch.setattr(divergence, "HELD_TERMS", 3)
    parts = [r for b in divergence._count(iter([batch])) for r in b.to_pylist()]
    whole = Counter()
    for r in parts:
        whole[r["source"], r["term"]] += r["docs"]
    assert len(parts) > 100 and whole["s0", "a"] == 20 and whole["s1", "cw"] == 4
