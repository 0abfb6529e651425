"""Corpus operators against brute force: on the smallest documents, and on rows with every odd case."""

from __future__ import annotations

import functools
import hashlib
import html as html_lib
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillspark.llm import decontamination, html_text, jaccard, language_id, licenses, packing, pii, quality, queries, token_files, tokens, toxicity

LONG = " ".join(f"w{i % 997}x{i % 13}" for i in range(30_000))
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one two three four"), (6, "The MIT License, mit license"), (7, "a@b.co, c@d.e_f@g.hi 1.2.3.4.5.6.7.8 x 4111 1111 1111 1111 +1 (974) 555-3436"),
    (8, LONG), (9, LONG), (9, LONG), (10, LONG + " more"), (11, "ÀÉ ñ ß x y 12 \x1c z"), (12, "7" * 5000 + "a" * 5000), (13, "x\ny\nx\n\nx"), (14, "<|endoftext|> a  b \x1e c "), (15, "İK ſ"),
]


@pytest.fixture(scope="module")
def odd(spark):
    """The odd rows, with further columns whose names clash with the operators' own."""
    rows = [(i, t, None, "s", "x", 1, "y") for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, words string, n_words int, score string")


@pytest.fixture(scope="module")
def documents(spark, small):
    return spark.read.parquet(f"{small}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return [(r["doc_id"], r["text"]) for r in documents.select("doc_id", "text").collect()]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def space(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def both(df, odd, f):
    """f over the smallest documents and over the odd rows, each with its (doc_id, text) pairs."""
    return [f(df), f(odd)]


# 1 -------------------------------------------------------------------------------------------------------------------


def licence_rows(pairs):
    out = []
    for i, t in pairs:
        w, found = alnum(t), []
        for phrase, label in (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")):
            p = phrase.split()
            found += [(k, label) for k in range(len(w)) if w[k : k + len(p)] == p]
        at = [k for k, _ in found]
        out.append((i, len(w), len(at), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in found}))))
    return sorted(out, key=str)


def test_licenses(documents, odd, texts):
    for df, pairs in ((documents, texts), (odd, ODD)):
        got = licenses.scan(df).collect()
        assert sorted([(r["doc_id"], r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) for r in got], key=str) == licence_rows(pairs)
        assert all(set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1 for r in got)


def test_license_labels(spark):
    body = [(1, "Licensed under the Apache License, Version 2.0."), (2, "under CC BY-NC 4.0"), (3, "the mit of the license"), (4, "GNU Lesser General Public License")]
    got = {r["doc_id"]: r["labels"] for r in licenses.scan(spark.createDataFrame(body, "doc_id long, text string")).collect()}
    assert got == {1: "apache", 2: "cc-by-nc", 3: "", 4: "gpl,lgpl"}


def test_license_index_follows_idf(spark):
    """The rarest word of a key phrase is looked up; anchors change the work, not what is found."""
    text = "license license mit license license apache license mit mit mit"
    common_mit = [(k, "mit " * 3 + "alone") for k in range(1, 40)] + [(100, text)]
    common_license = [(k, "license " * 3 + "alone") for k in range(1, 40)] + [(100, text)]
    one = tuple(t for t in licenses.TEMPLATES if t.name == "mit")
    starts = {}
    for name, rows in (("mit", common_mit), ("license", common_license)):
        docs = spark.createDataFrame(rows, "doc_id long, text string")
        got = [{r["doc_id"]: r for r in licenses.scan(docs, one, anchors).collect()}[100] for anchors in (1, 2)]
        assert {(r["n_base"], r["first_word"], r["last_word"], r["labels"]) for r in got} == {(1, 2, 2, "mit")}
        starts[name] = got[0]["n_starts"]
        assert got[0]["n_aligned"] == starts[name] and got[1]["n_aligned"] == 1
    assert starts == {"mit": 5, "license": 4}
    idf = {"mit": 2.0, "license": 1.0}
    assert licenses.rarest_words(idf, one[0]) == [("mit", 0), ("license", 1)] and licenses.rarest_words({"mit": 1.0, "license": 2.0}, one[0], 1) == [("license", 1)]


def test_license_templates_by_brute_force(spark):
    """Labels and scores of all templates, at the ends of documents too, against plain Python."""
    rng, words = np.random.default_rng(7), sorted({w for t in licenses.TEMPLATES for w in t.words.split()})
    rows = []
    for i in range(200):
        t = licenses.TEMPLATES[i % len(licenses.TEMPLATES)]
        w = t.words.split()
        cut = w[int(rng.integers(0, len(w))) :] if i % 3 == 0 else w[: int(rng.integers(1, len(w) + 1))] if i % 3 == 1 else w
        noise = rng.choice(words, int(rng.integers(0, 12))).tolist()
        rows.append((i, " ".join([*noise, *cut, *noise[::-1]] if i % 2 else cut)))
    got = {r["doc_id"]: r for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, text in rows:
        w, labels, best = alnum(text), set(), 0.0
        for t in licenses.TEMPLATES:
            tw, key = t.words.split(), t.key.split()
            first = next(k for k in range(len(tw)) if tw[k : k + len(key)] == key)
            for s in range(-len(tw), len(w)):
                if s + first >= 0 and w[s + first : s + first + len(key)] == key:
                    labels.add(t.label)
                    best = max(best, sum(0 <= s + k < len(w) and w[s + k] == x for k, x in enumerate(tw)) / len(tw))
        assert got[i]["labels"] == ",".join(sorted(labels)) and got[i]["score"] == pytest.approx(best)


# 2 -------------------------------------------------------------------------------------------------------------------


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 if v > 9 else v
    return total % 10 == 0


def spans(text):
    out = []
    for kind, p in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(p, text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            good = {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 13 <= len(digits) <= 19 and luhn(digits), "phone": lambda: 9 <= len(digits) <= 15}[kind]()
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def test_personal_data(documents, odd, texts):
    for df, pairs in ((documents, texts), (odd, ODD)):
        got = sorted((r["doc_id"], r["n_email"], r["n_ip"], r["n_card"], r["n_phone"], r["base_sha256"]) for r in pii.digest(pii.find(df)).collect())
        want = []
        for i, t in pairs:
            found = spans(t) if i != 12 else []  # digits alone: a run of 5,000 is no card
            n = Counter(k for k, _, _ in found)
            want.append((i, n["email"], n["ip"], n["card"], n["phone"], hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest()))
        assert got == sorted(want)


def test_redaction(odd):
    got = {r["doc_id"]: r for r in pii.redact(odd.withColumn("n_chars", F.length("text"))).collect()}
    assert got[1]["text"] is None and got[4]["text"] == "one"
    assert got[7]["text"] == "[EMAIL], [EMAIL][EMAIL] [IP].[IP] x [CARD] [PHONE]" and got[7]["n_chars"] == len(got[7]["text"])


def test_dense_texts_take_linear_time(spark):
    """100,000 addresses in one text, found and replaced within seconds; the same by brute force."""
    text = " ".join(f"u{k}@h{k % 97}.org é" if k % 3 else f"10.0.{k % 256}.{k % 250}," for k in range(100_000))
    frame = spark.createDataFrame([(1, text), (2, "a@b.co"), (3, None)], "doc_id long, text string")
    began = time.perf_counter()
    got = {r["doc_id"]: r for r in pii.digest(pii.find(frame)).collect()}
    cut = {r["doc_id"]: r["text"] for r in pii.redact(frame).collect()}
    assert time.perf_counter() - began < 60
    found = spans(text)
    assert got[1]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in found).encode()).hexdigest() and len(found) == 100_000
    assert cut[1] == re.sub(r"u[0-9]+@h[0-9]+\.org", "[EMAIL]", re.sub(r"10\.0\.[0-9]+\.[0-9]+", "[IP]", text)) and cut[2] == "[EMAIL]" and cut[3] is None


@pytest.mark.parametrize("block", [1, 5, 4096])
def test_redaction_by_brute_force(spark, monkeypatch, block):
    rng = np.random.default_rng(block)
    rows = [(i, "".join(rng.choice(list("ab é🙂.\n"), int(rng.integers(0, 40)))), sorted((int(a), int(a + n)) for a, n in zip(rng.integers(0, 20, 6), rng.integers(1, 9, 6), strict=True))[: int(rng.integers(0, 7))]) for i in range(150)]
    rows = [(i, t, [("ip" if k % 2 else "card", a, min(b, len(t))) for k, (a, b) in enumerate(xs) if a < len(t)]) for i, t, xs in rows]
    frame = spark.createDataFrame(rows, "doc_id long, text string, spans array<struct<kind:string,s:int,e:int>>")
    sql = pii._REDACTED.replace("4096", str(block))
    got = {r["doc_id"]: r["x"] for r in frame.selectExpr("doc_id", f"if(size(spans) = 0, text, {sql}) as x").collect()}
    for i, text, found in rows:
        out, at = [], 0
        for kind, a, b in sorted(found, key=lambda x: (x[1], -x[2])):
            if a >= at:
                out += [text[at:a], f"[{kind.upper()}]"]
            at = max(at, b)
        if found:
            out.append(text[at:])
        assert got[i] == ("".join(out) if found else text)


def test_added_spans_by_brute_force(spark):
    """Each weak candidate is a span where its pattern matches, and only if the classifier takes its votes."""
    rows = [(1, "key deadbeef00112233445566778899aabb end"), (2, "call (555) 123-4567 now"), (3, "number 4111 1111 1111 1112 x 4111 1111 1111 1111"), (4, "deadbeef00112233445566778899aabbccddeeff00112233 (555) 123-45678")]
    found = pii.candidates(spark.createDataFrame(rows, "doc_id long, text string"))
    got = {(r["doc_id"], c["kind"], c["s"], c["e"]) for r in found.collect() for c in r["cands"] if not c["base"]}
    want = set()
    for i, t in rows:
        want |= {(i, "secret", *m.span()) for m in re.finditer(r"(?<![A-Za-z0-9])[A-Za-z0-9]{32,}", t)}
        want |= {(i, "phone_local", *m.span()) for m in re.finditer(r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])", t)}
        digits = [(m.span(), m[0].replace(" ", "")) for m in re.finditer(r"[0-9](?: ?[0-9]){12,}", t)]
        want |= {(i, "number", *span) for span, d in digits if len(d) <= 19 and not luhn(d)}
    assert got == want
    accepted = pii.accepted(found)
    kept = {r["doc_id"]: {(c["kind"], c["s"]) for c in r["spans"]} for r in pii.with_spans(found, accepted).collect()}
    for r in found.collect():
        assert kept[r["doc_id"]] == {(c["kind"], c["s"]) for c in r["cands"] if c["base"] or f"{c['kind']}:{','.join(map(str, c['votes']))}:{c['long']}" in accepted}


def test_filters_keep_clashing_columns(spark):
    text = "the cat sat on the mat and ran to the house of the man " * 3
    names = ("lang_pred", "score", "n_hit", "items", "t", "spans", "cands", "contaminated")
    rows = [(i, f"{text} {i}", "en", *[f"{n}{i}" for n in names]) for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, " + ", ".join(f"{n} string" for n in names))
    bench = spark.createDataFrame([(1, "never seen words here")], "item_id long, text string")
    for out in (language_id.known(docs), decontamination.clean(docs, bench), pii.redact(docs)):
        assert sorted(map(tuple, out.collect())) == rows


def test_reliabilities_prefer_agreement():
    soft = pii.estimate([("secret", (0, 1, 1, 1), 50), ("secret", (0, 0, -1, 0), 50), ("email", (1, 1, 1, 1), 100)])
    assert soft["secret", (0, 1, 1, 1)] > 0.9 > 0.5 > soft["secret", (0, 0, -1, 0)]


# 3 -------------------------------------------------------------------------------------------------------------------


def components(pairs):
    sets = {}
    for k, (_, t) in enumerate(pairs):
        w = space(lower(t))
        sets[k] = {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set()
    inverted = defaultdict(list)
    for k, s in sets.items():
        for g in s:
            inverted[g].append(k)
    root = dict(zip(sets, sets, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, s in sets.items():
        shared = Counter(j for g in s for j in inverted[g] if j < k)
        for j, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[j]) - n):
                root[find(k)] = find(j)
    least = {}
    for k in sets:
        least[find(k)] = min(least.get(find(k), pairs[k][0]), pairs[k][0])
    return sorted((pairs[k][0], len(sets[k]), least[find(k)]) for k in sets)


def check_components(df, pairs):
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.components(df).collect())
    assert got == components(pairs)


def test_jaccard(documents, odd, texts):
    check_components(documents, texts)
    check_components(odd, ODD)


def test_jaccard_chains_and_groups(spark):
    """A chain whose ends don't link, a group of near copies, and unrelated texts that share a passage."""
    rng, pairs = np.random.default_rng(5), []
    base = [f"c{i}" for i in range(100)]
    for k in range(12):
        pairs.append((len(pairs), " ".join(base)))
        base = base[:]
        base[(7 * k) % 95 : (7 * k) % 95 + 2] = [f"n{k}a", f"n{k}b"]
    core = [f"g{i}" for i in range(80)]
    for k in range(60):
        words = core[:]
        words[int(rng.integers(80))] = f"r{k}"
        pairs.append((len(pairs), " ".join(words)))
    passage = [f"p{i}" for i in range(60)]
    for k in range(40):
        pairs.append((len(pairs), " ".join(passage + [f"u{k}q{i}" for i in range(int(rng.integers(5, 40)))])))
    check_components(spark.createDataFrame(pairs, "doc_id long, text string"), pairs)


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_hot_groups(spark, monkeypatch, small):
    """Large groups, common passages and templates that don't link, with every bound so small that all hot keys are split."""
    if small:
        for name, value in {"FRAGMENT_GRAMS": 100, "FRAGMENTS": 4, "COMMON_LEAST": 2, "HOT_ROWS": 5}.items():
            monkeypatch.setattr(jaccard, name, value)
    rng, pairs = np.random.default_rng(11), []

    def add(words):
        pairs.append((1000 - len(pairs), " ".join(words)))

    for group in range(4):
        core = [f"k{group}g{i}" for i in range(60)]
        for k in range(25):  # near copies, of which some lie beyond the bound
            words = core[:]
            for at in rng.integers(0, 60, int(rng.integers(0, 4))):
                words[int(at)] = f"r{group}x{k}"
            add(words[: int(rng.integers(45, 61))])
    template = [f"t{i}" for i in range(80)]
    for k in range(60):  # a template of about 80 per cent of each text
        add([*template, *(f"own{k}x{i}" for i in range(int(rng.integers(10, 30))))])
    for k in range(40):  # exact copies
        add([f"c{i}" for i in range(30)] if k % 2 else [f"d{i}" for i in range(3)])
    for k in range(30):  # lengths in steps
        add([f"s{i}" for i in range(20 + 3 * k)])
    check_components(spark.createDataFrame(pairs, "doc_id long, text string").repartition(5), pairs)


def test_first_of_each_keeps_columns(documents):
    kept = jaccard.first_of_each(documents)
    assert kept.columns == documents.columns
    assert {r["doc_id"] for r in kept.collect()} == {c for _, _, c in components([(r["doc_id"], r["text"]) for r in documents.collect()])}


def test_null_and_repeated_ids(spark, tmp_path):
    """Of each group one row stays, whatever its doc_id; ids that are null stay null."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(60)) for c in "abc")
    rows = [(None, one), (4, one), (3, one + " end"), (4, two), (5, two), (5, two), (None, three), (None, three), (2, "alone here"), (2, "other text"), (None, ""), (-1, three + " end")]
    frame = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, _row_key int").repartition(3)
    kept = jaccard.first_of_each(frame)
    assert kept.columns == frame.columns
    assert sorted((r["doc_id"], r["text"]) for r in kept.collect() if r["doc_id"] is not None) == sorted([(3, one + " end"), (4, two), (2, "alone here"), (2, "other text"), (-1, three + " end")])
    assert [r["text"] for r in kept.filter("doc_id is null").collect()] == [""]
    assert jaccard.first_of_each(spark.createDataFrame([(None, one), (None, one), (None, two)], "doc_id long, text string")).count() == 2
    found = Counter((r["doc_id"], r["component_id"]) for r in jaccard.components(frame).collect())
    assert found == Counter([(None, 3), (4, 3), (3, 3), (4, 4), (5, 4), (5, 4), (None, -1), (None, -1), (-1, -1), (2, 2), (2, 2), (None, None)])
    path = f"file://{tmp_path}/ids"
    token_files.write(frame, path, tokens.default_path("word_bpe_49k.json"))
    digests = sorted(token_files.digests(spark, path).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in digests] == sorted((i for i, _ in rows), key=lambda i: -2 if i is None else i)


# 4 -------------------------------------------------------------------------------------------------------------------


def test_html(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    for r in html_text.main_text(pages).collect():
        article = re.search(r"<article>(.*)</article>", r["html"], re.S)[1].replace("<br>", " ")
        blocks = [" ".join(html_lib.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"] == "\n\n".join(b for b in blocks if b) and r["n_chars"] == len(r["text"])


PAGE = """<html><head><title>t</title></head><body><header>Site</header><nav><a href=x>Home</a></nav><div class="cookie-notice">We use cookies</div>
<div id=content><h1>Title</h1><p>One &amp; two.<p>Three<br>four<ul><li>a b<li>c</ul><form><input name=q><label>Search</label></form><script>if (a < b) "</p>"</script></div>
<div class="comments"><p>Nice post</p></div><aside>Side</aside><footer>f</footer></body></html>"""


@pytest.mark.parametrize(("page", "text"), [(PAGE, "Title\n\nOne & two.\n\nThree four\n\na b\n\nc"), (None, ""), ("", ""), ("<p>", ""), ("plain  words", "plain words"), ("<p>a<!-- b", "a"), ('<p title="x>y">a</p', "a"), ("1 < 2 &lt; 3", "1 < 2 < 3")])
def test_html_cases(page, text):
    assert html_text.extract(page, html_text.weigh({"p": (9, 1), "div": (1, 9), "li": (1, 1)})) == text


BODY = "<article><h1>Title</h1><p>One two three four five six seven eight</p></article>"


@pytest.mark.parametrize("wrapper", ["<form action=x>", "<div class='content has-sidebar'>", "<div class='post comments-open'>", "<div class='layout no-banner'>", "<form><div id=page class='no-banner'>"])
def test_html_article_in_a_wrapper(wrapper):
    weights, text = html_text.weigh({"p": (9, 1), "div": (1, 9)}), "Title\n\nOne two three four five six seven eight"
    assert html_text.extract(f"<body><nav>Home</nav>{wrapper}<label>Search</label>{BODY}<p>away</p>", weights) == text
    assert html_text.extract(f"<body>{wrapper}<main>{BODY}<div class=related><article>More</article></div></main>", weights) == text
    assert html_text.extract(f"<body><article>Teaser</article>{wrapper}{BODY}", weights).endswith(text)


def test_html_boilerplate_in_articles_stays():
    weights, text = html_text.weigh({"p": (9, 1), "div": (1, 9)}), "Title\n\nOne two three four five six seven eight"
    for after in ("<div class=related><article>More</article></div>", f"<aside>{BODY}</aside>", f"<div hidden>{BODY}</div>", "<div class=comments><article class=comment>Nice post of one two three four</article></div>"):
        assert html_text.extract(f"<body>{BODY}{after}", weights) == text
    assert html_text.extract("<p>plain words of a page without marks</p><div class=related><article>More</article></div>", weights) == "plain words of a page without marks"


def words(n, start=0):
    return " ".join(f"w{k}" for k in range(start, start + n))


def test_html_loses_nothing_of_an_article():
    weights = html_text.weigh({"p": (9, 1), "div": (1, 9), "li": (1, 50), "a": (1, 90)})
    parts = [words(20), words(30, 200)]
    for between in (f"<aside>{words(100, 500)}</aside>", f"<div class='ad-slot-2'>{words(100, 500)}</div>", f"<form>{words(9, 500)}</form>", f"<nav>{'<a>x</a>' * 60}</nav>"):
        assert html_text.extract(f"<article><h1>Title</h1><p>{parts[0]}</p>{between}<p>{parts[1]}</p></article>", weights) == "\n\n".join(["Title", *parts])
        assert html_text.extract(f"<div><p>{parts[0]}</p>{between}<p>{parts[1]}</p></div>", html_text.weigh({"p": (9, 1)})) == "\n\n".join(parts)
    assert html_text.extract(f"<article><p>{parts[0]}</article><p>{words(60, 500)}</p><article><p>{parts[1]}</article>", weights) == "\n\n".join(parts)
    links = "".join(f"<li><a>l{k}</a></li>" for k in range(50))
    assert html_text.extract(f"<article><h1>Title</h1><ul>{links}</ul><p>end</p></article>", weights) == "\n\n".join(["Title", *(f"l{k}" for k in range(50)), "end"])


@pytest.mark.parametrize(("name", "dropped"), [("share-buttons-explained", False), ("search-results", False), ("has-sidebar", False), ("comments-open", False), ("adverse", False), ("share-buttons", True), ("site-footer", True), ("ad-slot-2", True), ("sideBar", True), ("adContainer", True), ("x comments", True), ("cookie_notice", True)])
def test_html_names_count_whole(name, dropped):
    text = html_text.extract(f"<article><p>before</p><section class='{name}'>inside</section><p>after</p></article>", {})
    assert text == ("before\n\nafter" if dropped else "before\n\ninside\n\nafter")


def test_html_weights_decide_without_marks():
    """Without an article, what stands between costly tags is left out; a page's own words aren't."""
    weights = html_text.weigh({"p": (90, 1), "li": (1, 60), "a": (1, 90)})
    page = f"<ul>{'<li><a>x</a></li>' * 10}</ul><p>{words(40)}</p><p>{words(30, 100)}</p><ul>{'<li><a>y</a></li>' * 10}</ul>"
    assert html_text.extract(page, weights) == f"{words(40)}\n\n{words(30, 100)}"


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4), max_size=30))
def test_best_run_is_the_best(scores):
    a, b = html_text.best_run([float(x) for x in scores])
    assert sum(scores[a:b]) == max([0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])


@pytest.mark.parametrize("page", ["<b>" * 20_000 + "x" + "</i>" * 20_000, "<i>" + "<b>" * 20_000 + "</i></b>" * 20_000, "<p>" * 50_000 + "x", "<a \"'>" * 20_000 + "x", "<script>" * 20_000, "<div class='a'" * 20_000])
def test_html_hostile_pages_are_fast(page):
    began = time.perf_counter()
    html_text.extract(page, {})
    assert time.perf_counter() - began < 2


def test_html_keeps_further_columns(spark):
    rows = [(1, "u", "<p>one", "old text", 7, "x"), (1, "u", "<p>one", "old text", 7, "x"), (2, None, None, None, None, None)]
    out = html_text.main_text(spark.createDataFrame(rows, "page_id long, url string, html string, text string, n_chars int, word string"), {})
    assert sorted((r["page_id"], r["text"], r["n_chars"], r["word"]) for r in out.collect()) == [(1, "one", 3, "x"), (1, "one", 3, "x"), (2, "", 0, None)]


# 5 -------------------------------------------------------------------------------------------------------------------


def test_language(spark, odd):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).filter("held_out").select("lang", "lang_pred").collect()
    assert len(got) > 100 and sum(r["lang"] == r["lang_pred"] for r in got) >= 0.98 * len(got)
    langs, table = language_id.train(docs)
    found = {r["doc_id"]: r for r in language_id.predict(odd, langs, table).collect()}
    assert [found[i]["lang_pred"] for i in (1, 2, 3)] == ["und"] * 3 and found[4]["lang_pred"] in langs
    assert all(0 <= r["score"] <= 1 for r in found.values())
    assert {r["lang_pred"] for r in language_id.identify(odd).collect()} == {"und"}  # no labels at all


def test_language_by_brute_force(spark):
    """Counts, probabilities and choices of the naive Bayes against a plain one over the same buckets; ties go to the first language."""
    rng = np.random.default_rng(2)
    rows = [(i, "".join(rng.choice(list("abc dé.漢 "), int(rng.integers(0, 60)))), ["xx", "yy", "zz", None][i % 4]) for i in range(80)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    langs, table = language_id.train(docs)

    def grams(text):
        clean = " " + "".join(c if ord(c) >= 128 or "a" <= c <= "z" else " " for c in text.lower()) + "  "
        out = Counter()
        for k in range(len(clean) - 2):
            code = np.array([ord(c) for c in clean[k : k + 3]], np.uint32)
            out.update(int(b[0]) for b in language_id.ngram_buckets(code))
        return out

    counts, n = {x: Counter() for x in ("xx", "yy", "zz")}, Counter()
    for _, text, lang in rows:
        if lang:
            counts[lang].update(grams(text))
            n[lang] += 1
    assert langs == ["xx", "yy", "zz"]
    log = {x: {b: np.log((counts[x][b] + 0.5) / (sum(counts[x].values()) + 0.5 * language_id.BUCKETS)) for _, t, _ in rows for b in grams(t)} for x in langs}
    got = {r["doc_id"]: r for r in language_id.predict(docs, langs, table).collect()}
    for i, text, _ in rows:
        if not any(c.isalpha() for c in text):
            assert (got[i]["lang_pred"], got[i]["score"]) == ("und", 0)
            continue
        total = [np.log(n[x] / sum(n.values())) + sum(k * log[x][b] for b, k in grams(text).items()) for x in langs]
        post = np.exp(np.array(total) - max(total))
        best = int(np.argmax(total))
        assert got[i]["score"] == pytest.approx(post[best] / post.sum(), abs=1e-3)
        if sorted(total)[-1] - sorted(total)[-2] > 1e-3:
            assert got[i]["lang_pred"] == langs[best]
    tied = spark.createDataFrame([(1, "abc", "yy"), (2, "abc", "xx")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language_id.predict(tied, *language_id.train(tied)).collect()} == {"xx"}


def test_language_chunks_lose_nothing(monkeypatch):
    text = "ab cd ef gh " * 50
    whole = [x for _, at, c in language_id._chunks([text]) for x in language_id._pieces(at, c).ravel() if x >= 0]
    monkeypatch.setattr(language_id, "CHUNK_CHARS", 40)
    cut = [x for _, at, c in language_id._chunks([text]) for x in language_id._pieces(at, c).ravel() if x >= 0]
    assert Counter(whole) == Counter(cut)


# 6 -------------------------------------------------------------------------------------------------------------------


def test_toxicity_learns_and_locates(spark, odd):
    rng = np.random.default_rng(1)
    clean = [" ".join(rng.choice(["the", "cat", "sat", "on", "mat", "and", "ran"], 8)) + "." for _ in range(400)]
    bad = [i % 4 == 0 for i in range(400)]
    rows = [(i, c + (" You are a grobnik." if b else " You are a friend.")) for i, (c, b) in enumerate(zip(clean, bad, strict=True))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bad)], "doc_id long, toxic int")
    model = toxicity.train(docs.filter("doc_id < 300"), labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model).collect()}
    assert all(got[i] == bad[i] for i in range(400))
    found = toxicity.locate(docs, model).collect()
    assert {r["doc_id"] for r in found} == {i for i in range(400) if bad[i]} and all("grobnik" in r["sentence"] for r in found)
    scores = {r["doc_id"]: r["score"] for r in toxicity.score(odd, model).collect()}
    assert scores[1] == scores[2] == scores[3] == 0 and all(0 <= s <= 1 for s in scores.values())
    empty = toxicity.train(docs, labels.filter("toxic = 0"))
    assert toxicity.score(docs, empty).filter("score > 1e-9").count() == 0


def test_noisy_or_by_brute_force(spark):
    """Likelihood, slopes and scores against plain Python; of equally bad sentences the first is the worst."""
    texts = ["You grob. the cat! The dog\nsat grob grob", "", "a. b. c", None, "grobnik", "12 34", "the cat sat"]
    y, weight = np.array([1, 0, 0, 0, 1, 0, 0], bool), np.array([0.3, 0.1, 0.2, 0.1, 0.1, 0.1, 0.1])
    bags = toxicity.Bags(texts, 2)
    docs_of = Counter(f for t in texts for f in {f for s in toxicity.sentences(t or "") for w in s for f in toxicity.features(w)})
    assert set(bags.names) == {f for f, n in docs_of.items() if n >= 2}
    rng = np.random.default_rng(4)
    w, b = rng.uniform(0, 1, len(bags.names)), -0.7

    def plain(w, b):
        by_name, loss, scores = dict(zip(bags.names, w, strict=True)), 0.0, []
        for d, t in enumerate(texts):
            none = 1.0
            for s in toxicity.sentences(t or ""):
                none *= 1 - 1 / (1 + np.exp(-(b + sum(by_name.get(f, 0) for x in s for f in toxicity.features(x)))))
            scores.append(1 - none)
            loss -= weight[d] * np.log(max(1 - none, 1e-6) if y[d] else min(none, np.exp(-1e-6)))
        return loss, scores

    loss, slope, slope_b = bags.likelihood(w, b, y, weight)
    want, scores = plain(w, b)
    assert loss == pytest.approx(want, rel=1e-5)
    for k in range(len(w)):
        step = np.zeros(len(w))
        step[k] = 1e-5
        assert slope[k] == pytest.approx((plain(w + step, b)[0] - plain(w - step, b)[0]) / 2e-5, abs=1e-6)
    assert slope_b == pytest.approx((plain(w, b + 1e-5)[0] - plain(w, b - 1e-5)[0]) / 2e-5, abs=1e-6)
    model = toxicity.Model(dict(zip(bags.names, w, strict=True)), b)
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r for r in toxicity.score(rows, model).collect()}
    assert [got[d]["score"] for d in range(len(texts))] == pytest.approx(scores)
    assert got[2]["worst_sentence"] == 0 and got[3]["worst_sentence"] == -1 and got[2]["n_sentences"] == 3


def test_toxicity_held_out(spark):
    """Recall and precision on the labelled rows that training never saw."""
    got = queries.op6_toxicity(spark, "/root/testdata/sf0.1").filter("held_out").select("doc_id", "predicted")
    labels = spark.read.parquet("/root/testdata/sf0.1/labels.parquet").select("doc_id", "toxic")
    n = Counter((r["toxic"], r["predicted"]) for r in got.join(labels, "doc_id").collect())
    assert n[1, 1] >= 0.9 * (n[1, 1] + n[1, 0]) and n[1, 1] >= 0.9 * (n[1, 1] + n[0, 1]), n


# 7 and 10 ------------------------------------------------------------------------------------------------------------


@functools.cache
def library(name):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokens.default_path(name))


def plain_ids(name, text, end):
    t = library(name)
    return np.array([*t.encode(text or "", add_special_tokens=False).ids, end], "<u4")


MARKS = ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "<|", "|>", " ", "  ", "\n", "\t", "\u00a0", "\u2028", "a", "É", "ß", "ÿx", "×", "e\u0301", "'s", "don't", "12", "½", "漢", "🙂", ".", ",", "_", "ªº", "İ", "ſ", "\x1e", "Word", "naïve", "WORD!"]
_ENCODERS = {name: (tokens.Encoder(tokens.default_path(name), keep), keep) for name, keep in (("word_bpe_49k.json", False), ("byte_bpe_50k.json", True))}


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(MARKS) | st.characters(codec="utf-8"), max_size=14).map("".join), min_size=1, max_size=6), st.sampled_from(sorted(_ENCODERS)))
def test_ids_are_the_librarys(texts, name):
    for text, ids in zip(texts, _ENCODERS[name][0].encode(texts), strict=True):
        assert [*ids.tolist(), 0] == plain_ids(name, text, 0).tolist()


@pytest.mark.parametrize("text", ["<|endoftext|>", "<|endoftext|><|endoftext|>", "a<|endoftext|>b c<|endoftext|> d", "hello <|endoftext|> world", "<|startoftext|> x", "x <|endoftext"])
def test_special_marks_are_one_id_as_in_the_library(text):
    for name, (enc, _) in _ENCODERS.items():
        assert [*enc.encode([text, "plain " + text])[0].tolist(), 0] == plain_ids(name, text, 0).tolist()


def test_token_files(spark, odd, tmp_path):
    path = f"file://{tmp_path}/ids"
    token_files.write(odd, path, tokens.default_path("word_bpe_49k.json"))
    got = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in token_files.digests(spark, path).collect())
    start, want = 0, []
    for i, t in sorted(ODD, key=lambda r: r[0]):
        ids = plain_ids("word_bpe_49k.json", t, 1)
        want.append((start, i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), min_size=1, max_size=400), min_size=1, max_size=5))
def test_segments_round_trip(rows):
    ids = np.concatenate([np.array(r, np.uint32) for r in rows])
    lengths = np.array([len(r) for r in rows], np.uint32)
    part = token_files.Segment(token_files.encode_segment(np.arange(len(rows)), lengths, ids))
    assert part.ids().tolist() == ids.tolist()
    assert all(part.document(k).tolist() == r for k, r in enumerate(rows))


def test_packing(odd):
    got = packing.pack(odd.coalesce(1), tokens.default_path("byte_bpe_50k.json"), block_tokens=20_000).collect()
    by_sequence, by_start = defaultdict(list), defaultdict(list)
    for r in got:
        by_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
        by_start[r["doc_id"]].append(r)
    padding = 0
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.WINDOW
        padding += packing.WINDOW - at if at & (at - 1) else 0
    assert padding == 0
    for i, t in ODD:
        if i == 9:  # twice
            continue
        ids, at = plain_ids("byte_bpe_50k.json", t, 0), 0
        for r in sorted(by_start[i], key=lambda r: r["start"]):
            assert r["start"] == at and r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[at : at + r["length"]].tobytes())
            at += r["length"]
        assert at == len(ids)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 3000), min_size=1, max_size=300))
def test_every_token_is_packed_once(sizes):
    doc, start, length, seq, off = packing.pack_lengths(np.array(sizes), 256, packing.strategies(256))
    seen = sorted((d, s, n) for d, s, n in zip(doc.tolist(), start.tolist(), length.tolist(), strict=True))
    assert all(n > 0 for *_, n in seen)
    for d, size in enumerate(sizes):
        at = 0
        for _, s, n in [x for x in seen if x[0] == d]:
            assert s == at
            at += n
        assert at == size
    used = Counter()
    for s, n in zip(seq.tolist(), length.tolist(), strict=True):
        used[s] += n
    assert all(n <= 256 and (n == 256 or n & (n - 1) == 0) for n in used.values())


def test_counts_are_rounded_to_the_nearest():
    plans = packing.strategies(8, step=1)
    row = {tuple(p): k for k, p in enumerate(plans.tolist())}
    x = np.zeros(len(plans))
    x[row[5, 3, 0]], x[row[4, 4, 0]], x[row[6, 2, 0]] = 2.6, 1.4, 0.4
    histogram = np.array([0, 0, 9, 9, 9, 9, 9, 0, 0])
    assert [(lengths.tolist(), n) for lengths, n in packing.apply_counts(plans, x, histogram)] == [([5, 3], 3), ([4, 4], 1)]
    assert [n for _, n in packing.apply_counts(plans, x, np.minimum(histogram, 2))] == [2, 1]


def test_strategies_fit_and_pack_most_rests():
    """The counts come near the histogram, never beyond what pieces there are, and fewer documents are cut than by the greedy part alone."""
    rng = np.random.default_rng(3)
    sizes = np.maximum(1, rng.lognormal(6.5, 1.2, 3000).astype(np.int64))
    plans, window = packing.strategies(packing.WINDOW), packing.WINDOW
    rest = sizes % window
    histogram = np.bincount(rest[rest > 0], minlength=window + 1)
    x = packing.solve(plans, histogram)
    weight = np.arange(window + 1) / window

    def error(counts):
        return float((weight * (np.bincount(plans.ravel(), weights=np.repeat(counts, 3), minlength=window + 1) - histogram) ** 2)[1:].sum())

    assert (x >= 0).all() and error(x) < 0.5 * error(np.zeros(len(plans)))
    for k in rng.integers(0, len(plans), 50):  # no single count can be moved for the better by much
        for by in (0.5, -0.5):
            moved = x.copy()
            moved[k] = max(0.0, moved[k] + by)
            assert error(moved) > error(x) - 0.1
    used = sum(n * window for _, n in packing.apply_counts(plans, x, histogram))
    assert used >= 0.5 * (histogram * np.arange(window + 1)).sum()
    pieces = len(packing.pack_lengths(sizes, window, plans)[0])
    greedy = len(packing.pack_lengths(sizes, window, plans[:1])[0])
    assert pieces < greedy


# 8 -------------------------------------------------------------------------------------------------------------------


def leaks(pairs, items, window=10):
    windows = defaultdict(set)
    for name, t in items:
        w = alnum(t)
        for k in range(max(1, len(w) - window + 1) if w else 0):
            windows[tuple(w[k : k + window])].add(str(name))
    out = []
    for i, t in pairs:
        w, hit, found = alnum(t), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if names := windows.get(tuple(w[k : k + n])):
                    hit.update(range(k, k + n))
                    found |= names
        out.append((i, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.mark.parametrize("block", [decontamination.BLOCK_WORDS, 60])
def test_decontamination(spark, small, documents, odd, texts, block):
    table = spark.read.parquet(f"{small}/benchmark.parquet")
    items = [(r["item_id"], r["text"]) for r in table.collect()]
    short = [(100, "one two three"), (101, "mit"), (102, None), (103, ""), (103, "w1x1 w2x2 w3x3 w4x4 w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12"), (104, "w5x5 w6x6 w7x7 w8x8 w9x9 w10x10 w11x11 w12x12 w13x0 w14x1 w15x2")]
    for df, pairs, bench, frame in ((documents, texts, items, table), (odd, ODD, short, spark.createDataFrame(short, "item_id long, text string"))):
        got = decontamination.find(df, frame, block_words=block).collect()
        assert sorted((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) for r in got) == leaks(pairs, bench)
    assert decontamination.clean(documents, table).columns == documents.columns


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("abc"), max_size=60), st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=9), min_size=1, max_size=4), st.integers(1, 5))
def test_suffix_search(words, items, window):
    named = [(str(k), [w.encode() for w in item]) for k, item in enumerate(items)]
    text = " ".join(words)
    (n,), (hit,), (found,), (longest,) = decontamination.judge([text], decontamination.TestSuffixes(named, window))
    (_, want_n, want_hit, want_items, _, _), = leaks([(0, text)], [(k, " ".join(item)) for k, item in enumerate(items)], window)
    assert (n, len(hit), len(found)) == (want_n, want_hit, want_items) and (longest > 0) == bool(len(hit))


# 9 -------------------------------------------------------------------------------------------------------------------


def test_quality(documents, odd, texts):
    for df, pairs in ((documents, texts), (odd, ODD)):
        want = []
        for i, t in pairs:
            w, t = space(t), t or ""
            lines = [x for x in t.split("\n") if space(x)]
            times = Counter(tuple(w[k : k + 5]) for k in range(len(w) - 4))
            covered = {j for k in range(len(w) - 4) if times[tuple(w[k : k + 5])] > 1 for j in range(k, k + 5)}
            want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered), len(w) < 10 or 100 * len(covered) > 20 * len(w)))
        got = quality.judge(quality.ledger(df)).collect()
        assert sorted((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == sorted(want)
        assert not any(r["base_failed"] and r["kept"] for r in got)


def test_ablation(documents):
    rows = quality.ledger(documents)
    failed = [r["failed"] for r in rows.collect()]
    for r in quality.ablation(rows).collect():
        mask, bit = quality.POLICIES[r["version"]], 1 << [x.name for x in quality.RULES].index(r["rule"])
        assert (r["n_docs"], r["n_kept"], r["n_kept_without"]) == (len(failed), sum(f & mask == 0 for f in failed), sum(f & mask & ~bit == 0 for f in failed))


# all -----------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", [*sorted(queries.QUERIES), "pipeline"])
def test_empty_tables(spark, tmp_path, name):
    import corpus_pipeline

    kinds = {"embeddings": "vec_id long, embedding array<float>, label int", "documents": "doc_id long, text string, lang string, source string, n_chars long", "pages": "page_id long, url string, html string", "benchmark": "item_id long, text string", "labels": "doc_id long, quality int, toxic int"}
    for t, schema in kinds.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{t}.parquet")
    assert (queries.QUERIES | {"pipeline": corpus_pipeline.run})[name](spark, str(tmp_path)).count() == 0


def test_pipeline_odd_rows(spark, tmp_path):
    """Nulls, repeated rows and ids, clashing columns and no benchmark: one of each group stays, with its own ids."""
    import corpus_pipeline

    one, two = "the cat sat on the mat and ran to the house of the man " * 3, "a dog is in the garden with the children and plays there all day long"
    rows = [(1, one, "en"), (1, one, "en"), (None, one, None), (5, two, "en"), (5, two + " too", "en"), (6, None, "en"), (7, "", None), (8, "12 34", "en")]
    rows += [(100 + k, f"{k} words of another text number {k} that stands alone {k * 7} here {k * 3}", "en") for k in range(8)]
    docs = spark.createDataFrame([(i, t, x, "s", len(t or ""), "own", 1.5) for i, t, x in rows], "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    texts = [(r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0]
    assert sorted(i for i, _ in texts) == sorted([1, 5, *range(100, 108)])


def test_pipeline(spark, small, documents):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, small).collect()
    docs = documents.collect()
    known = {r["doc_id"]: r["text"] for r in docs if any(c.isalpha() for c in r["text"] or "")}
    kept = {c for _, n, c in components(list(known.items())) if n}
    leaked = {r[0] for r in leaks([(i, known[i]) for i in kept], [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{small}/benchmark.parquet").collect()]) if r[5]}
    assert {r["doc_id"] for r in got} == kept - leaked
    text = {r["doc_id"]: r["text"] for r in pii.redact(documents.filter(F.col("doc_id").isin(sorted(kept - leaked)))).collect()}
    for r in got:
        ids = plain_ids("byte_bpe_50k.json", text[r["doc_id"]], 0)
        assert r["doc_tokens"] == len(ids) and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        assert not any(f"{a}" in text[r["doc_id"]] for a in [known[r["doc_id"]][s:e] for _, s, e in spans(known[r["doc_id"]])])
