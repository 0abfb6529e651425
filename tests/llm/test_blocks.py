"""Benchmarks in many blocks, items longer than a block, and items without an id."""

from __future__ import annotations

import hashlib

import numpy as np
import pytest

from quillspark.llm import decontamination


def plain(docs, items, window=10):
    out = []
    for i, text in docs:
        words = (text or "").split()
        hit, found = set(), set()
        for name, item in items:
            w = (item or "").split()
            size = min(len(w), window)
            for k in range(len(w) - size + 1) if w else ():
                for at in range(len(words) - size + 1):
                    if words[at : at + size] == w[k : k + size]:
                        hit.update(range(at, at + size))
                        found |= {name} if name is not None else set()
        out.append((i, len(words), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out)


@pytest.fixture(scope="module")
def tables():
    rng = np.random.default_rng(3)
    draw = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 30, n))
    long = draw(400)
    items = [("a", draw(14)), ("b", draw(4)), (None, draw(25)), (None, "only here"), ("long", long), ("a", draw(12)), ("e", ""), ("f", None)]
    cut = lambda text, a, b: " ".join(text.split()[a:b])
    docs = [(1, f"{draw(30)} {cut(long, 95, 125)} {draw(20)}"), (2, cut(long, 0, 400)), (3, f"x {items[2][1]} y"), (4, "only here"), (5, f"{items[0][1]} {items[1][1]} z {items[5][1]}"), (6, None), (7, ""), (8, draw(60)), (9, cut(long, 391, 400))]
    return docs, items


@pytest.mark.parametrize("block", [2_000_000, 40, 11])
def test_blocks(spark, tables, block):
    docs, items = tables
    found = decontamination.find(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string"), block_words=block)
    assert sorted(tuple(r) for r in found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated").collect()) == plain(docs, items)


def test_blocks_are_bounded(spark, tables):
    """Each block is made when it is asked for and holds at most its words."""
    blocks = decontamination._blocks(spark.createDataFrame(tables[1], "item_id string, text string"), 10, 40)
    sizes = [int((b.text > 0).sum()) for b in blocks]
    assert max(sizes) <= 40 and len(sizes) > 10
    assert len(list(decontamination._blocks(spark.createDataFrame([], "item_id string, text string"), 10, 40))) == 1
