"""The vector arm's task holds a bounded number of scores, however many queries and points it has."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pandas as pd

from quillspark.operators import retrieval


def test_scores_in_memory_are_bounded():
    rng = np.random.default_rng(3)
    vectors = rng.integers(-2, 3, (8000, 4)).astype(np.float64)  # many equal scores
    q = retrieval.unit(vectors[:1500])
    pdf = pd.DataFrame({"chunk_id": rng.permutation(8000), "vector": list(vectors)})
    tracemalloc.start()
    got = pd.concat(retrieval.best_scores(iter([pdf[:5000], pdf[5000:]]), np.arange(1500), q, 40))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6  # all scores and ids: 192 MB
    for n in range(0, 1500, 100):
        scores = np.round(q[n : n + 1] @ retrieval.unit(vectors).T, 6)[0]
        want = sorted(zip(-scores, pdf["chunk_id"], strict=True))[:40]
        mine = got[got.query_id == n]
        assert [(-s, c) for s, c in zip(mine.score, mine.chunk_id, strict=True)] == want
