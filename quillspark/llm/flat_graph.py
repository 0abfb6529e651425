"""A flat proximity graph over unit vectors, in numpy: robust-pruned build, beam search, range expansion.

It holds one shard in one task; `near_vectors` cuts the data into shards and joins what they find.
"""

from __future__ import annotations

import numpy as np

#: Neighbours of a node, places of a beam, nodes that a beam opens at a time, queries that are searched at a time.
DEGREE, BEAM, OPENED, QUERIES = 24, 48, 4, 512
#: How much nearer to a kept neighbour than to the node a candidate must be to be pruned.
ALPHA = 1.2
#: Candidates that a batch of new nodes finds among itself.
OWN_BATCH = 12
#: Nodes that searches start from, and how many a shard's far-apart ones are chosen from.
MEDOIDS, DRAWN = 16, 1_000


class _Seen:
    """Which (query, node) were met, and first meetings in a list of them."""

    def __init__(self, queries: int, nodes: int):
        self.nodes, self.met, self.mark = nodes, np.zeros(queries * nodes, bool), np.zeros(queries * nodes, np.int32)

    def first(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of the pairs that weren't met before, each once; they count as met from now on."""
        key = q * self.nodes + x
        new = np.flatnonzero(~self.met[key])
        key, order = key[new], np.arange(len(new), dtype=np.int32)
        self.mark[key] = order
        self.met[key] = True
        return new[self.mark[key] == order]


def _dots(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.einsum("ij,ij->i", a, b)


def medoids(x: np.ndarray, most: int = MEDOIDS, seed: int = 0) -> np.ndarray:
    """The node nearest the mean, and then of a draw the node farthest from those before, so that one dense group gets one."""
    if not len(x):
        return np.zeros(0, np.int32)
    chosen = [int(np.argmax(x @ x.mean(axis=0)))]
    drawn = np.random.default_rng(seed).permutation(len(x))[:DRAWN]
    nearest = x[drawn] @ x[chosen[0]]
    while len(chosen) < min(most, len(x)):
        k = int(np.argmin(nearest))
        if nearest[k] >= 1 - 1e-6:
            break
        chosen.append(int(drawn[k]))
        nearest = np.maximum(nearest, x[drawn] @ x[drawn[k]])
    return np.array(chosen, np.int32)


class Graph:
    """Rows of adjacency (-1: none) over unit vectors, and the medoids that searches start from."""

    def __init__(self, vectors: np.ndarray, near: np.ndarray | None = None, degree: int = DEGREE):
        self.x = np.ascontiguousarray(vectors, np.float32)
        self.near = near if near is not None else np.full((len(self.x), degree), -1, np.int32)
        self.medoids = medoids(self.x)
        self._close: dict[float, tuple[np.ndarray, np.ndarray]] = {}

    def close(self, least: float) -> tuple[np.ndarray, np.ndarray]:
        """Edges of a cosine of `least` or more, both ways: where each node's begin, and what they lead to."""
        if least in self._close:
            return self._close[least]
        a, place = np.nonzero(self.near >= 0)
        b = self.near[a, place]
        some = np.concatenate([_dots(self.x[a[k : k + 200_000]], self.x[b[k : k + 200_000]]) for k in range(0, len(a), 200_000)] or [np.zeros(0)]) >= least
        both = np.unique(np.concatenate([a[some] * len(self.x) + b[some], b[some] * len(self.x) + a[some]]))
        self._close[least] = np.searchsorted(both // max(1, len(self.x)), np.arange(len(self.x) + 1)), both % max(1, len(self.x))
        return self._close[least]

    def beam(self, queries: np.ndarray, width: int, seen: _Seen) -> tuple[np.ndarray, np.ndarray]:
        """The `width` nearest nodes that a greedy search from the medoids meets: ids (-1: none) and cosines, nearest first."""
        n, slots = len(queries), OPENED * self.near.shape[1]
        ids, sims, closed = np.full((n, width), -1, np.int32), np.full((n, width), -2, np.float32), np.ones((n, width), bool)
        starts = self.medoids[:width]
        seen.first(np.repeat(np.arange(n), len(starts)), np.tile(starts, n))
        first = queries @ self.x[starts].T
        order = np.argsort(-first, axis=1, kind="stable")
        ids[:, : len(starts)], sims[:, : len(starts)], closed[:, : len(starts)] = starts[order], np.take_along_axis(first, order, 1), False
        active = np.arange(n)
        while len(active):
            own = ~closed[active]
            rank = np.cumsum(own, axis=1)
            row, column = np.nonzero(own & (rank <= OPENED))
            who = active[row]
            closed[who, column] = True
            near = self.near[ids[who, column]]
            slot = ((rank[row, column] - 1) * near.shape[1])[:, None] + np.arange(near.shape[1])
            edge, _ = there = np.nonzero(near >= 0)
            new = seen.first(who[edge], near[there])
            edge, x = edge[new], near[there][new]
            found_ids, found = np.full((len(active), slots), -1, np.int32), np.full((len(active), slots), -2, np.float32)
            at = (row[edge], slot[there][new])
            found_ids[at], found[at] = x, _dots(queries[who[edge]], self.x[x])
            all_sims = np.concatenate([sims[active], found], axis=1)
            best = np.argpartition(-all_sims, width - 1, axis=1)[:, :width]
            best = np.take_along_axis(best, np.argsort(-np.take_along_axis(all_sims, best, 1), axis=1, kind="stable"), 1)
            sims[active] = np.take_along_axis(all_sims, best, 1)
            ids[active] = np.take_along_axis(np.concatenate([ids[active], found_ids], axis=1), best, 1)
            closed[active] = np.take_along_axis(np.concatenate([closed[active], found_ids < 0], axis=1), best, 1)
            active = active[~closed[active].all(axis=1)]
        return ids, sims

    def within(self, queries: np.ndarray, least: float, around: float, width: int, own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(query, node) with a cosine of `least` or more that a search meets, expanding every node of `around` or more.

        own: the node that each query itself is; what the search found is then expanded from there too.
        """
        ids, sims = self.beam(queries, width, _Seen(len(queries), len(self.x)))
        q, place = np.nonzero((ids >= 0) & (sims >= around))
        x = ids[q, place]
        if own is not None:
            q, x = np.concatenate([q, np.arange(len(queries))]), np.concatenate([x, own])
        seen, out = _Seen(len(queries), len(self.x)), []
        # two nodes that near to a query are that near to each other
        begin, to = self.close(2 * around**2 - 1)
        while len(q):
            new = seen.first(q, x)
            q, x = q[new], x[new]
            s = np.concatenate([_dots(queries[q[k : k + 200_000]], self.x[x[k : k + 200_000]]) for k in range(0, len(q), 200_000)] or [np.zeros(0)])
            out.append((q[s >= least], x[s >= least]))
            q, x = q[s >= around], x[s >= around]
            times = begin[x + 1] - begin[x]
            edge = np.repeat(np.arange(len(x)), times)
            at = np.arange(len(edge)) - np.repeat(np.cumsum(times) - times, times) + begin[x[edge]]
            q, x = q[edge], to[at]
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def pruned(x: np.ndarray, nodes: np.ndarray, pool: np.ndarray, degree: int) -> np.ndarray:
    """For each node up to `degree` of its pool (-1: none), nearest first, none much nearer to one kept before than to the node."""
    out = np.full((len(nodes), degree), -1, np.int32)
    sims = np.where(pool >= 0, np.einsum("npd,nd->np", x[pool], x[nodes]), -2)
    sims[pool == nodes[:, None]] = -2
    order = np.argsort(-sims, axis=1, kind="stable")
    pool, sims = np.take_along_axis(pool, order, 1), np.take_along_axis(sims, order, 1)
    # a node named twice counts once: equal ids needn't stand side by side among equal cosines
    alive = sims > -2
    vectors = x[pool]
    between = vectors @ vectors.transpose(0, 2, 1)
    rows = np.arange(len(nodes))
    for k in range(degree):
        next_ = alive.argmax(axis=1)
        some = alive[rows, next_]
        if not some.any():
            break
        out[some, k] = pool[rows, next_][some]
        alive &= ALPHA**2 * (1 - between[rows, next_]) > 1 - sims
        alive &= pool != pool[rows, next_][:, None]
    return out


def build(vectors: np.ndarray, degree: int = DEGREE, width: int = BEAM, seed: int = 0) -> Graph:
    """Inserts the vectors in batches that double: each searches the graph so far and its own batch, prunes, and is linked back."""
    graph = Graph(vectors, degree=degree)
    x, n = graph.x, len(vectors)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([graph.medoids, order[~np.isin(order, graph.medoids)]])
    done = len(graph.medoids)
    graph.near[graph.medoids] = pruned(x, graph.medoids, np.tile(graph.medoids, (done, 1)), degree)
    while done < n:
        batch = order[done : done + min(done, QUERIES)]
        pool, _ = graph.beam(x[batch], width, _Seen(len(batch), n))
        if len(batch) > 1:
            own = x[batch] @ x[batch].T
            np.fill_diagonal(own, -2)
            most = min(OWN_BATCH, len(batch) - 1)
            pool = np.concatenate([pool, batch[np.argpartition(-own, most - 1, axis=1)[:, :most]].astype(np.int32)], axis=1)
        graph.near[batch] = pruned(x, batch, pool, degree)
        _link_back(graph, batch)
        done += len(batch)
    return graph


def _link_back(graph: Graph, batch: np.ndarray) -> None:
    """Gives every neighbour of the batch's nodes an edge back, pruning rows that overflow."""
    degree = graph.near.shape[1]
    row, place = np.nonzero(graph.near[batch] >= 0)
    to, back = graph.near[batch[row], place], batch[row].astype(np.int32)
    order = np.argsort(to, kind="stable")
    to, back = to[order], back[order]
    while len(to):
        nodes, start = np.unique(to, return_index=True)
        rank = np.arange(len(to)) - np.repeat(start, np.diff(np.append(start, len(to))))
        now = rank < degree
        more = np.full((len(nodes), degree), -1, np.int32)
        more[np.searchsorted(nodes, to[now]), rank[now]] = back[now]
        more[(more[:, :, None] == graph.near[nodes][:, None, :]).any(axis=2)] = -1
        held, added = (graph.near[nodes] >= 0).sum(axis=1), (more >= 0).sum(axis=1)
        fits = held + added <= degree
        packed = np.concatenate([graph.near[nodes], more], axis=1)
        tight = np.take_along_axis(packed, np.argsort(packed < 0, axis=1, kind="stable"), 1)
        graph.near[nodes[fits]] = tight[fits, :degree]
        for k in range(0, (~fits).sum(), QUERIES):
            some = np.flatnonzero(~fits)[k : k + QUERIES]
            graph.near[nodes[some]] = pruned(graph.x, nodes[some], packed[some], degree)
        to, back = to[~now], back[~now]
