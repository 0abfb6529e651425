"""Near vectors against brute force over all pairs; the graph against exact search."""

from __future__ import annotations

import math

import numpy as np
import pytest

from quillspark.llm import flat_graph, near_vectors

SCHEMA = "vec_id long, embedding array<float>, label int, node long, copies string, shards int"


def plain(rows, least=0.98):
    """(vec_id, n_links, component_id, kept) of each row, from all pairs."""
    usable = []
    for i, v, label in rows:
        ok = label is not None and v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, np.float32).astype(np.float64) if ok else None
        usable.append((i, label, x / np.linalg.norm(x) if ok else None))
    n = len(rows)
    near = [[b for b in range(n) if a != b and usable[a][2] is not None and usable[b][2] is not None and usable[a][1] == usable[b][1] and len(usable[a][2]) == len(usable[b][2]) and usable[a][2] @ usable[b][2] >= least] for a in range(n)]
    out, seen = [None] * n, set()
    for a in range(n):
        if a not in seen:
            group, stack = {a}, [a]
            while stack:
                for b in near[stack.pop()]:
                    if b not in group:
                        group.add(b)
                        stack.append(b)
            seen |= group
            ids = [rows[k][0] for k in group if rows[k][0] is not None]
            for k in group:
                component = min(ids, default=None)
                out[k] = (rows[k][0], len(near[k]), component, rows[k][0] == component)
    return sorted(out, key=str)


def frame(spark, rows):
    return spark.createDataFrame([(i, v, la, 1, "x", 2) for i, v, la in rows], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.select("vec_id", "n_links", "component_id", "kept").collect()), key=str)


def around(rng, centre, count, spread):
    x = centre + spread * rng.standard_normal((count, len(centre))) / np.sqrt(len(centre))
    return (x / np.linalg.norm(x, axis=1)[:, None]).tolist()


@pytest.fixture(scope="module")
def rows():
    """Noise, pairs, a dense group, chains, and every odd vector."""
    rng = np.random.default_rng(2)
    d = 24
    noise = rng.standard_normal((250, d))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    vectors = [v for v in noise.tolist()]
    for k in range(40):
        vectors += around(rng, noise[k], 1, 0.1)
    vectors += around(rng, noise[60], 120, 0.08)
    turn = [math.cos(0.15 * k) * noise[70] + math.sin(0.15 * k) * (noise[71] - (noise[71] @ noise[70]) * noise[70]) / np.linalg.norm(noise[71] - (noise[71] @ noise[70]) * noise[70]) for k in range(12)]
    vectors += [v.tolist() for v in turn]  # each links with the next alone
    out = [(1000 - k, v, int(rng.integers(0, 2))) for k, v in enumerate(vectors)]
    same = noise[80].tolist()
    out += [(2000 + k, same, 1) for k in range(30)] + [(1999, [-0.0 if x == 0 else x for x in same], 1), (1998, [7 * x for x in same], 1), (2100, same, 0), (2101, same, None)]
    zero = [0.0] * d
    out += [(3000, None, 1), (3001, [], 1), (3002, zero, 1), (3003, zero, 1), (3004, [*same[:-1], None], 1), (3005, [*same[:-1], float("nan")], 1), (3006, [*same[:-1], float("inf")], 1), (3007, same[:5], 1), (3008, same[:5], 1)]
    out += [(None, same, 1), (None, noise[90].tolist(), 0), (None, None, 1), (2003, same, 1), (5, noise[91].tolist(), 1), (5, noise[91].tolist(), 1), (6, [1.0] + zero[1:], 0), (7, [-0.0 + 1] + [-0.0] * (d - 1), 0)]
    return out


def test_matches_plain(spark, rows):
    assert got(near_vectors.components(frame(spark, rows))) == plain(rows)


def test_overlapping_shards_and_blocks(spark, rows, monkeypatch):
    """Many shards, and blocks far smaller than the dense group: no link is lost, none counted twice."""
    monkeypatch.setattr(near_vectors, "SHARD_NODES", 40)
    monkeypatch.setattr(near_vectors, "BLOCK_NODES", 30)
    df = frame(spark, rows)
    keyed = near_vectors.keyed(df)
    assert keyed.filter("h1 is null").count() == 9
    want, have = plain(rows), got(near_vectors.components(df))
    assert sum(r[1] for r in have) >= 0.97 * sum(r[1] for r in want)
    found = {}
    for r in have:
        found.setdefault(r[0], []).append(r[1])
    for i in {r[0] for r in want}:
        assert all(a <= b for a, b in zip(sorted(found[i]), sorted(r[1] for r in want if r[0] == i), strict=True))


def test_audit(spark, rows):
    some = list({r[0]: r for r in rows if r[0] is not None}.values())
    df = frame(spark, some)
    r = near_vectors.audit(df, near_vectors.components(df), queries=10_000).first()
    assert r["recall"] == 1.0 and r["true_links"] == sum(x[1] for x in plain(some)) > 1000


def test_empty(spark):
    assert got(near_vectors.components(frame(spark, []))) == []
    assert got(near_vectors.components(frame(spark, [(1, None, 1), (2, None, None)]))) == [(1, 0, 1, True), (2, 0, 2, True)]


def test_clashing_and_double_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], "a", 9), (2, [1.0, 0.001], "a", 9), (3, [1.0, 0.0], "b", 9)], "vec_id int, embedding array<double>, label string, n_links int")
    assert got(near_vectors.components(df)) == [(1, 1, 1, True), (2, 1, 1, False), (3, 0, 3, True)]


def test_centroids_leave_dense_groups_whole():
    rng = np.random.default_rng(0)
    noise = rng.standard_normal((300, 32))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    dense = np.array(around(rng, noise[0], 600, 0.1))
    centres = near_vectors.centroids(np.concatenate([noise, dense]), 20)
    cosines = centres @ centres.T - 2 * np.eye(len(centres))
    assert len(centres) > 3 and cosines.max() < near_vectors.APART and len(set((dense @ centres.T).argmax(axis=1).tolist())) == 1


def test_graph_finds_neighbours():
    """Pairs in noise and a dense group are found by beam and expansion; edges respect the degree and pruning."""
    rng = np.random.default_rng(4)
    noise = rng.standard_normal((1500, 48))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    x = np.concatenate([noise, around(rng, noise[3], 300, 0.1), *(around(rng, noise[k], 1, 0.1) for k in range(100, 200))])
    graph = flat_graph.build(x)
    assert (graph.near >= 0).sum(axis=1).min() > 0 and graph.near.shape[1] == flat_graph.DEGREE
    assert all(len(set(r[r >= 0].tolist())) == (r >= 0).sum() and k not in r for k, r in enumerate(graph.near))
    q, found = graph.within(x.astype(np.float32), 0.98, 0.95, flat_graph.BEAM)
    true = np.argwhere(x @ x.T >= 0.98)
    have = set(zip(q.tolist(), found.tolist(), strict=True))
    assert len(have) == len(q) and sum((a, b) in have for a, b in true.tolist()) >= 0.97 * len(true)


def test_pruning_by_definition():
    """A neighbour is kept when none kept before is nearer to it by the factor than the node is."""
    rng = np.random.default_rng(6)
    x = rng.standard_normal((80, 6)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    pool = np.stack([rng.choice(np.arange(80), 30, replace=False) for _ in range(5)]).astype(np.int32)
    pool[0, 5:] = -1
    rows = flat_graph.pruned(x, np.arange(5), pool, 6)
    for k in range(5):
        kept = []
        for c in sorted((c for c in pool[k].tolist() if c not in (-1, k)), key=lambda c: -float(x[k] @ x[c])):
            if len(kept) < 6 and all(flat_graph.ALPHA**2 * (1 - float(x[p] @ x[c])) > 1 - float(x[k] @ x[c]) for p in kept):
                kept.append(c)
        assert [c for c in rows[k].tolist() if c >= 0] == kept


def test_wider_beams_until_the_audit_holds(monkeypatch):
    """A graph whose search misses most is searched with wider beams, up to all nodes."""
    rng = np.random.default_rng(8)
    noise = rng.standard_normal((400, 32))
    noise /= np.linalg.norm(noise, axis=1)[:, None]
    x = np.concatenate([noise, *(around(rng, noise[k], 1, 0.1) for k in range(400))])
    near = np.stack([np.roll(np.arange(800), -k - 1) for k in range(2)], axis=1).astype(np.int32)  # a ring: far from navigable
    monkeypatch.setattr(flat_graph, "BEAM", 4)
    q, found = near_vectors._audited(flat_graph.Graph(x, near), x, x, np.arange(800), 0.98)
    true = (x @ x.T >= 0.98).sum()
    assert len(q) >= 0.9 * true
