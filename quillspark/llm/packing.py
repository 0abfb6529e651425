"""Packing documents into fixed windows by non-negative least squares.

Each task takes its documents in blocks of about BLOCK_TOKENS tokens. In a
block, documents longer than the window are cut into full windows, which are
sequences already, and a rest. The rests' lengths give a histogram over
1..window. Strategies are all combinations of one to three lengths that fill
the window: the repeat counts x >= 0 that minimise |A x - histogram|^2 weighted
by length are found by multiplicative updates (A and the histogram aren't
negative, so x stays so and the error never grows), rounded to the nearest, and
applied, largest count first, as far as the pieces last. What is left is packed greedily: pieces in falling
length fill a window, and the piece that crosses its end is cut there. The last
sequence of a block is cut into powers of two, which need no padding.

Blocks need nothing of each other: no shuffle, no state that grows with the
corpus, and a lost task repeats its own blocks alone.

Cases: a null or empty text is its end id alone. Rows that repeat are packed
each on its own, in the order in which they are read; a null doc_id stays null.
A text longer than a block makes a larger block of its own. Of strategies with
equal counts the one listed first (fewer pieces) goes first, of pieces of equal
length the document read first. Columns besides doc_id and text aren't read. An
empty table gives no pieces.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from . import common, tokens

WINDOW = 1024
BLOCK_TOKENS = 4_000_000
END_ID = 0
PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def strategies(window: int, step: int = 16) -> np.ndarray:
    """Combinations (a >= b >= c >= 0) with a + b + c == window.

    All singles and pairs; of triples those whose two smaller lengths are
    multiples of step, so that their number stays in the tens of thousands.
    """
    single = [(window, 0, 0)]
    pairs = [(window - b, b, 0) for b in range(1, window // 2 + 1)]
    triples = [(window - b - c, b, c) for c in range(step, window // 3 + 1, step) for b in range(c, (window - c) // 2 + 1, step) if window - b - c >= b]
    return np.array(single + pairs + triples, np.int64)


def solve(plans: np.ndarray, histogram: np.ndarray, rounds: int = 60) -> np.ndarray:
    """Non-negative x that brings A x near the histogram (index = length), by multiplicative updates."""
    weight = np.arange(len(histogram), dtype=np.float64)
    weight /= len(histogram)
    weight[0] = 0
    x = np.full(len(plans), max(1.0, histogram.sum()) / len(plans) / 2)
    target = (weight * histogram)[plans].sum(axis=1)
    for _ in range(rounds):
        made = np.bincount(plans.ravel(), weights=np.repeat(x, 3), minlength=len(histogram))
        have = (weight * made)[plans].sum(axis=1)
        x *= target / np.maximum(have, 1e-12)
    return x


def apply_counts(plans: np.ndarray, x: np.ndarray, histogram: np.ndarray) -> list[tuple[np.ndarray, int]]:
    """Rounded strategies with their repeats, never more than the histogram holds."""
    left, out = histogram.copy(), []
    counts = np.rint(x).astype(np.int64)
    for k in np.argsort(-counts, kind="stable")[: np.count_nonzero(counts)]:
        lengths = plans[k][plans[k] > 0]
        kinds, each = np.unique(lengths, return_counts=True)
        n = int(min(counts[k], (left[kinds] // each).min()))
        if n > 0:
            left[kinds] -= each * n
            out.append((lengths, n))
    return out


def pack_lengths(sizes: np.ndarray, window: int, plans: np.ndarray) -> tuple[np.ndarray, ...]:
    """Pieces of documents with these sizes: document, start, length, sequence, offset. Sequences from 0."""
    doc, start, length, seq, off = [], [], [], [], []
    full = sizes // window
    cut_docs = np.repeat(np.arange(len(sizes)), full)
    nth = np.arange(len(cut_docs)) - np.repeat(np.cumsum(full) - full, full)
    doc.append(cut_docs)
    start.append(nth * window)
    length.append(np.full(len(cut_docs), window))
    seq.append(np.arange(len(cut_docs)))
    off.append(np.zeros(len(cut_docs), np.int64))
    used = len(cut_docs)

    rest = sizes - full * window
    open_docs = np.flatnonzero(rest)
    order = open_docs[np.argsort(rest[open_docs], kind="stable")]
    histogram = np.bincount(rest[order], minlength=window + 1)
    first = np.concatenate([[0], np.cumsum(histogram)])  # of each length's run in order
    taken = np.zeros(window + 1, np.int64)
    if len(order):
        for lengths, n in apply_counts(plans, solve(plans, histogram), histogram):
            at = 0
            for size in lengths:
                mine = order[first[size] + taken[size] : first[size] + taken[size] + n]
                taken[size] += n
                doc.append(mine)
                start.append(full[mine] * window)
                length.append(np.full(n, size))
                seq.append(used + np.arange(n))
                off.append(np.full(n, at))
                at += size
            used += n
    # the residuals: longest first, laid end to end and cut at each window's end
    left = np.concatenate([order[first[s] + taken[s] : first[s + 1]] for s in range(window, 0, -1)]) if len(order) else order
    if len(left):
        ends = np.cumsum(rest[left])
        total = int(ends[-1])
        edges = np.arange(window, total + 1, window)
        tail = total - (total // window) * window
        for bit in range(window.bit_length() - 1, -1, -1):
            if tail >> bit & 1:
                edges = np.append(edges, (edges[-1] if len(edges) else 0) + (1 << bit))
        cuts = np.unique(np.concatenate([[0], ends, edges]))
        begin, size = cuts[:-1], np.diff(cuts)
        owner = np.searchsorted(ends, begin, side="right")
        bin_ = np.searchsorted(edges, begin, side="right")
        low = np.concatenate([[0], edges])[bin_]
        mine = left[owner]
        doc.append(mine)
        start.append(full[mine] * window + begin - (ends[owner] - rest[mine]))
        length.append(size)
        seq.append(used + bin_)
        off.append(begin - low)
    return tuple(np.concatenate(x).astype(np.int64) for x in (doc, start, length, seq, off))


def pack(docs: DataFrame, vocabulary: str, keep_space: bool = True, window: int = WINDOW, end_id: int = END_ID, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece. sequence_id is the task's number times 2^40 plus the sequence's number in the task."""
    common.small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc, end, plans = tokens.encoder(vocabulary, keep_space), np.array([end_id], np.uint16), strategies(window)
        base, held, names, size = TaskContext.get().partitionId() << 40, [], [], 0

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal base, held, names, size
            sizes = np.array([len(a) for a in held], np.int64)
            doc, start, length, seq, off = pack_lengths(sizes, window, plans)
            crc = [zlib.crc32(held[d][s : s + n].astype("<u4").tobytes()) for d, s, n in zip(doc, start, length, strict=True)]
            ids = pa.array(names, pa.int64()).take(pa.array(doc))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x) for x in (start, length, np.array(crc, np.int64), sizes[doc], seq + base, off))], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])
            base, held, names, size = base + int(seq.max()) + 1, [], [], 0

        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            for a, b in common.parts([len(t) for t in texts], 2_000_000):
                for doc, got in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                    names.append(doc)
                    held.append(np.concatenate([got, end]))
                    size += len(got) + 1
                if size >= block_tokens:
                    yield from close()
        if held:
            yield from close()

    return common.only(docs, "doc_id", "text").mapInArrow(run, PIECES)
