"""The HTML operator's text comes through its learned weights and its scan: without either, pages are lost."""

from __future__ import annotations

import html
import re

import pytest

from quillspark.llm import html_text


@pytest.fixture(scope="module")
def pages(spark):
    """(html, text) of the table's pages, with their marks and with the marks renamed, and the weights learned from them."""
    table = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    weights = html_text.train(table)
    marked = [r["html"] for r in table.select("html").collect()]
    texts = []
    for page in marked:
        article = re.search(r"<article>(.*)</article>", page, re.S)[1].replace("<br>", " ")
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        texts.append("\n\n".join(b for b in blocks if b))
    bare = [re.sub(r"<(/?)article>", r"<\1div>", page) for page in marked]
    return weights, texts, marked, bare


def right(pages, texts, weights):
    return sum(html_text.extract(p, weights) == t for p, t in zip(pages, texts, strict=True))


def test_learned_weights_are_exact(pages):
    weights, texts, marked, bare = pages
    assert right(marked, texts, weights) == right(bare, texts, weights) == len(texts)
    assert weights["@marked"] > 0 > max(weights["@nav"], weights["@.ad"], weights["@footer"])


def test_other_weights_lose_pages(pages):
    """Regions' weights dealt to one another, with and without marks."""
    weights, texts, marked, bare = pages
    regions = [k for k in weights if k.startswith(html_text.REGION)]
    values = sorted((weights[k] for k in regions), reverse=True)
    for at in ("@nav", "@footer"):
        order = [at, *(k for k in regions if k != at)]
        other = weights | dict(zip(order, values, strict=True))
        assert right(marked, texts, other) < 0.1 * len(texts) and right(bare, texts, other) < 0.1 * len(texts)


def test_without_the_scan_pages_are_lost(pages, monkeypatch):
    weights, texts, marked, bare = pages
    monkeypatch.setattr(html_text, "best_run", lambda scores: (0, len(scores)))
    assert right(marked, texts, weights) < 0.1 * len(texts) and right(bare, texts, weights) < 0.1 * len(texts)


def test_learned_regions_overrule_names():
    """A name that labelled pages show in their text isn't boilerplate there; one they show outside is."""
    page = "<p>before it</p><div class='share'><p>more of it</p></div><p>after it</p>"
    assert html_text.extract(page, {}) == "before it\n\nafter it"
    assert html_text.extract(page, html_text.weigh_regions({".share": (90, 1)})) == "before it\n\nmore of it\n\nafter it"
    assert html_text.extract("<nav>a b</nav><p>c d e</p>", html_text.weigh_regions({"plain": (1, 90), "nav": (90, 1)})) == "a b"
