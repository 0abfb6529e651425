"""Near-duplicate vectors by a robust-pruned flat graph over overlapping cluster shards.

Vectors of equal, non-null labels (and equal dimension) link when their cosine, in
double precision, is at least LEAST.

1. Equal vectors of a label are one node with a number of copies, known by 128 bits
   of hash; copies are never compared with each other.
2. Centroids are fitted on a bounded sample and moved apart (none nearer to another
   than APART), so that no dense group is cut by them. A node belongs to the shards
   of its two nearest centroids, by label. A shard beyond BLOCK_NODES is dealt into
   blocks by a hash.
3. Each block builds its own flat graph (`flat_graph`): greedy search, robust pruning,
   edges back. A node's adjacency is the union of its lists of all shards.
4. Every node is searched for in the graphs of its shards, in each block of them: a
   beam from the medoids, then every node within range is expanded over close edges.
   A pair counts in the smallest shard that both are in, so each is counted once.
   What an adjacency list leads to outside the shard, and near enough to be within
   range, is verified by a join.
5. Each search audits its recall against brute force on AUDITED of its queries and
   widens its beam until that is at least RECALL; a beam as wide as the block is exact.
   All pairs are verified in double precision.

A search gives one row for each node, its number of links and the root of what it
linked within its block: pairs of a dense group stay in numpy. Roots and links are
joined to components by label spreading over stored tables.

Scale: shards and blocks are of bounded size whatever the data; a group of very many
near copies is one hot shard, and takes all pairs of its blocks, evenly dealt. Only
centroids (at most CLUSTERS) are broadcast. Joins by hash or root deal hot keys.

Cases: vectors that are null, empty, zero or hold null, NaN or infinite components,
and those without a label, link with nothing and are components of their own. Rows
count one by one, whatever vec_id they repeat; a null vec_id stays null (its
component's id is the smallest one that isn't null; alone, null). Scaled copies
are nodes of their own and link. -0.0 is 0.0. Columns besides vec_id, embedding and
label aren't read. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, flat_graph
from .jaccard import Dealt, connected

#: Cosine of links, and of nodes that a search expands.
LEAST, AROUND = 0.98, 0.95
#: Nodes that the centroids are fitted on at most, centroids at most, rounds of fitting, cosine from which two are one.
SAMPLE, CLUSTERS, FITTED, APART = 20_000, 1_024, 8, 0.825
#: Shards of a node, nodes that a shard aims at, nodes of a block at most.
SHARDS, SHARD_NODES, BLOCK_NODES = 2, 2_000, 4_000
#: Queries that a search checks against brute force, and the recall that it keeps on them.
AUDITED, RECALL = 32, 0.98
#: Slack of single precision.
SLACK = 1e-5


def unit(vectors: pa.Array) -> np.ndarray:
    """Lists of one length as unit vectors in double precision."""
    x = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(vectors), -1)
    x = x / np.abs(x).max(axis=1, keepdims=True)  # squares of what is left neither vanish nor overflow
    return x / np.sqrt(np.einsum("ij,ij->i", x, x))[:, None]


def _padded(vectors: list[list[float]], dim: int) -> np.ndarray:
    """Unit vectors cut or filled up to dim: for choosing shards alone."""
    out = np.zeros((len(vectors), dim))
    for k, v in enumerate(vectors):
        out[k, : len(v)] = v[:dim]
    out /= np.maximum(np.abs(out).max(axis=1, keepdims=True), 1e-300)
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-300)


def keyed(embeddings: DataFrame) -> DataFrame:
    """row, vec_id, label, embedding, h1, h2 (null where nothing can link), stored."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = F.col("label").isNotNull() & v.isNotNull() & finite & F.exists(v, lambda x: x != 0)
    plain = F.transform(v, lambda x: x + F.lit(0))  # no -0.0
    first, second = F.when(usable, F.xxhash64("label", plain)), F.when(usable, F.xxhash64(F.reverse(plain), "label"))
    rows = embeddings.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "embedding", first.alias("h1"), second.alias("h2"))
    return common.stored(rows, "vectors")


def centroids(sample: np.ndarray, clusters: int, rounds: int = FITTED) -> np.ndarray:
    """Spherical k-means over unit vectors; centres that are nearer than APART to a larger one are dropped."""
    if clusters < 2 or len(sample) < 2:
        return sample[:1] if len(sample) else np.zeros((1, 1))
    rng = np.random.default_rng(0)
    centres = sample[rng.choice(len(sample), min(clusters, len(sample)), replace=False)]
    for _ in range(rounds):
        own = (sample @ centres.T).argmax(axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        sizes = np.bincount(own, minlength=len(centres))
        some = np.linalg.norm(sums, axis=1) > 1e-12
        centres = sums[some] / np.linalg.norm(sums[some], axis=1, keepdims=True)
        sizes = sizes[some]
    kept: list[int] = []
    for k in np.argsort(-sizes, kind="stable").tolist():
        if not kept or (centres[kept] @ centres[k]).max() < APART:
            kept.append(k)
    return centres[kept]


def nodes_of(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """node, label, dim, embedding, copies, shards (its nearest centroids', ascending), stored."""
    spark = rows.sparkSession
    nodes = rows.join(groups.select(F.col("node").alias("row"), "copies"), "row").select(F.col("row").alias("node"), "label", F.size("embedding").alias("dim"), "embedding", "copies")
    largest = groups.groupBy("label").count().agg(F.max("count").alias("most"), F.sum("count").alias("total")).first()
    most, total = largest["most"] or 0, largest["total"] or 0
    clusters = 1 if most <= SHARD_NODES else min(CLUSTERS, -(-SHARDS * most // SHARD_NODES))
    drawn = [r["embedding"] for r in common.sample_below(nodes, "node", SAMPLE, total).select("embedding").collect()] if clusters > 1 else []
    dim = max(map(len, drawn), default=1)
    sent = spark.sparkContext.broadcast(centroids(_padded(drawn, dim), clusters))

    def place(batch: pa.RecordBatch) -> pa.RecordBatch:
        centres = sent.value
        most = min(SHARDS, len(centres))
        if len(centres) == 1:
            own = np.zeros((batch.num_rows, 1), np.int32)
        else:
            sims = _padded(batch.column("embedding").to_pylist(), centres.shape[1]) @ centres.T
            own = np.sort(np.argpartition(-sims, most - 1, axis=1)[:, :most], axis=1).astype(np.int32)
        shards = pa.ListArray.from_arrays(pa.array(np.arange(0, own.size + 1, most, dtype=np.int32)), pa.array(own.ravel()))
        return pa.RecordBatch.from_arrays([*batch.columns, shards], names=[*batch.schema.names, "shards"])

    out = nodes.mapInArrow(common.per_batch(place), f"{_ddl(nodes)}, shards array<int>")
    return common.stored(out, "vector-nodes")


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in df.schema)


SHARD = ["label", "dim", "shard"]


def placed(nodes: DataFrame) -> DataFrame:
    """Nodes once for each of their shards, with their block and the number of blocks there."""
    spread = nodes.withColumn("shard", F.explode("shards"))
    sizes = spread.groupBy(*SHARD).agg(F.ceil(F.count("*") / BLOCK_NODES).alias("blocks"))
    return spread.join(sizes, SHARD).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")))


def _near_type() -> pa.DataType:
    return pa.list_(pa.struct([("node", pa.int64()), ("cosine", pa.float32()), ("shard_a", pa.int32()), ("shard_b", pa.int32())]))


_NEAR = "array<struct<node:bigint,cosine:float,shard_a:int,shard_b:int>>"


def _two_shards(column: pa.ChunkedArray) -> np.ndarray:
    """The first and second shard of each row, -1 for none."""
    lists = column.combine_chunks()
    sizes = np.diff(lists.offsets.to_numpy())
    flat, out = lists.flatten().to_numpy(), np.full((len(lists), SHARDS), -1, np.int32)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def _build(table: pa.Table) -> pa.Table:
    """node and its adjacency in this block."""
    ids, x = table.column("node").to_numpy(), unit(table.column("embedding").combine_chunks())
    order = np.argsort(ids)
    ids, x, shards = ids[order], x[order], _two_shards(table.column("shards"))[order]
    near = flat_graph.build(x).near
    row, place = np.nonzero(near >= 0)
    to = near[row, place]
    values = [pa.array(ids[to]), pa.array(np.einsum("ij,ij->i", x[row], x[to]).astype(np.float32)), pa.array(shards[to, 0]), pa.array(shards[to, 1])]
    offsets = pa.array(np.searchsorted(row, np.arange(len(ids) + 1)).astype(np.int32))
    lists = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays(values, names=["node", "cosine", "shard_a", "shard_b"]))
    return pa.table([pa.array(ids), lists.cast(_near_type())], names=["node", "near"])


def adjacency(places: DataFrame) -> DataFrame:
    """node, near: the union of the lists that its shards' graphs give it, stored."""
    built = places.select(*SHARD, "block", "node", "embedding", "shards").groupBy(*SHARD, "block").applyInArrow(_build, f"node bigint, near {_NEAR}")
    return common.stored(built.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near")), "adjacency")


def _smallest_common(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest shard that both rows have, or a large number."""
    common_ = np.where((a[:, :, None] == b[:, None, :]).any(axis=2) & (a >= 0), a, np.iinfo(np.int32).max)
    return common_.min(axis=1)


def _roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The smallest of each node's component under these pairs."""
    root = np.arange(n)
    while True:
        before = root.copy()
        np.minimum.at(root, a, before[b])
        np.minimum.at(root, b, before[a])
        root = root[root]
        if (root == before).all():
            return root


def _audited(graph: flat_graph.Graph, x: np.ndarray, queries: np.ndarray, own: np.ndarray | None, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (query, node) within range, by a beam wide enough for the audit's recall."""
    drawn = np.random.default_rng(1).permutation(len(queries))[:AUDITED]
    true_q, true_x = np.nonzero(queries[drawn] @ x.T >= least)
    true = drawn[true_q] * len(x) + true_x
    width, small = flat_graph.BEAM, queries.astype(np.float32)
    while True:
        q, found = [], []
        for k in range(0, len(queries), flat_graph.QUERIES):
            part = slice(k, k + flat_graph.QUERIES)
            a, b = graph.within(small[part], least - SLACK, AROUND, width, own[part] if own is not None else None)
            q.append(a + k)
            found.append(b)
        q, found = np.concatenate(q), np.concatenate(found)
        if width >= len(x) or np.isin(true, q * len(x) + found).sum() >= RECALL * len(true):
            return q, found
        width *= 2


def _search(least: float, table: pa.Table) -> pa.Table:
    """node, links, root of the nodes met here; node, other of pairs to verify that are in no shard together."""
    # queries of one block against the graph of another, or of the same
    table = table.sort_by("node")
    ids, x, shards = table.column("node").to_numpy(), unit(table.column("embedding").combine_chunks()), _two_shards(table.column("shards"))
    is_query, is_node = (table.column(c).to_numpy() for c in ("is_query", "is_node"))
    shard, copies = table.column("shard")[0].as_py(), table.column("copies").to_numpy()
    here, asked = np.flatnonzero(is_node), np.flatnonzero(is_query)
    lists = table.column("near").combine_chunks()
    owner = np.repeat(np.arange(len(ids)), np.diff(lists.offsets.to_numpy()))
    edges = lists.flatten()
    to, cosine, a, b = (edges.field(c).to_numpy() for c in ("node", "cosine", "shard_a", "shard_b"))
    # the graph: union lists as far as they stay among this block's nodes
    at = np.minimum(np.searchsorted(ids[here], to), len(here) - 1)
    local = np.full(len(ids), -1)
    local[here] = np.arange(len(here))
    inside = (ids[here][at] == to) & is_node[owner]
    rows, row_to = local[owner[inside]], at[inside]
    place = np.arange(len(rows)) - np.searchsorted(rows, rows)
    near = np.full((len(here), int(place.max(initial=0)) + 1), -1, np.int32)
    near[rows, place] = row_to
    graph = flat_graph.Graph(x[here], near)
    same = len(here) == len(asked) and (here == asked).all()
    q, found = _audited(graph, x[here], x[asked], np.arange(len(here)) if same else None, least)
    q, found = asked[q], here[found]
    sure = (q != found) & (np.concatenate([np.einsum("ij,ij->i", x[q[k : k + 200_000]], x[found[k : k + 200_000]]) for k in range(0, len(q), 200_000)] or [np.zeros(0)]) >= least)
    q, found = q[sure], found[sure]
    mine = np.concatenate([_smallest_common(shards[q[k : k + 500_000]], shards[found[k : k + 500_000]]) for k in range(0, len(q), 500_000)] or [np.zeros(0)]) == shard
    links = np.zeros(len(ids), np.int64)
    np.add.at(links, q[mine], copies[found[mine]])
    root = _roots(len(ids), q, found)
    touched = np.unique(np.concatenate([q, found]))
    # lists that lead out of the shard, from nodes within range (or the query itself) to what may be within range too
    out = np.flatnonzero((cosine >= 2 * least**2 - 1 - SLACK) & (a != shard) & (b != shard))
    start = np.searchsorted(owner[out], np.arange(len(ids) + 1))
    some = np.flatnonzero(start[1:] > start[:-1])
    via_q, via = np.concatenate([asked, q]), np.concatenate([asked, found])
    leads = np.isin(via, some)
    via_q, via = via_q[leads], via[leads]
    times = start[via + 1] - start[via]
    edge = out[np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times) + np.repeat(start[via], times)]
    via_q = np.repeat(via_q, times)
    apart = _smallest_common(shards[via_q], np.stack([a[edge], b[edge]], axis=1)) == np.iinfo(np.int32).max
    pairs = np.unique(np.stack([ids[via_q[apart]], to[edge[apart]]], axis=1), axis=0) if apart.any() else np.zeros((0, 2), np.int64)
    columns = [np.concatenate([ids[touched], pairs[:, 0]]), np.concatenate([links[touched], np.zeros(len(pairs), np.int64)]), np.concatenate([ids[root[touched]], pairs[:, 0]]), np.concatenate([np.zeros(len(touched), np.int64), pairs[:, 1]])]
    crosses = np.arange(len(columns[0])) >= len(touched)
    return pa.table([pa.array(columns[0]), pa.array(columns[1]), pa.array(columns[2]), pa.array(columns[3], mask=~crosses)], names=["node", "links", "root", "other"])


def searched(places: DataFrame, near: DataFrame, least: float) -> DataFrame:
    """node, links, root, other (see _search) of every node in every block of its shards, stored."""
    block, blocks = F.col("block"), F.col("blocks")
    all_blocks = F.sequence(F.lit(0).cast("bigint"), blocks - 1)
    asks = F.transform(all_blocks, lambda j: F.struct(block.alias("i"), j.alias("j"), F.lit(True).alias("is_query"), (j == block).alias("is_node")))
    holds = F.transform(F.filter(all_blocks, lambda i: i != block), lambda i: F.struct(i.alias("i"), block.alias("j"), F.lit(False).alias("is_query"), F.lit(True).alias("is_node")))
    tasks = places.join(near, "node").withColumn("task", F.explode(F.concat(asks, holds)))
    rows = tasks.select(*SHARD, "task.*", "node", "embedding", "copies", "shards", "near")
    found = rows.groupBy(*SHARD, "i", "j").applyInArrow(lambda table: _search(least, table), "node bigint, links bigint, root bigint, other bigint")
    return common.stored(found, "vector-links")


def _verified(pairs: DataFrame, nodes: DataFrame, least: float) -> DataFrame:
    """a, b, copies_a, copies_b of the pairs that link."""
    ends = nodes.select("node", "label", "dim", "embedding", "copies")
    a, b = (ends.withColumnsRenamed({c: f"{c}_{x}" for c in ("label", "dim", "embedding", "copies")} | {"node": x}) for x in "ab")
    both = pairs.join(a, "a").join(b, "b").filter("label_a = label_b and dim_a = dim_b").select("a", "b", "copies_a", "copies_b", "dim_a", "embedding_a", "embedding_b")

    def check(batch: pa.RecordBatch) -> pa.RecordBatch:
        dims, keep = batch.column("dim_a").to_numpy(), np.zeros(batch.num_rows, bool)
        for d in np.unique(dims):
            some = np.flatnonzero(dims == d)
            x, y = (unit(batch.column(c).take(pa.array(some))) for c in ("embedding_a", "embedding_b"))
            keep[some] = np.einsum("ij,ij->i", x, y) >= least
        return batch.select(["a", "b", "copies_a", "copies_b"]).filter(pa.array(keep))

    return both.mapInArrow(common.per_batch(check), "a bigint, b bigint, copies_a bigint, copies_b bigint")


def components(embeddings: DataFrame, least: float = LEAST) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row."""
    common.small_batches(embeddings.sparkSession)
    rows = keyed(embeddings)
    groups = rows.filter("h1 is not null").groupBy("label", "h1", "h2").agg(F.min("row").alias("node"), F.count("*").alias("copies"), F.min("vec_id").alias("least"))
    groups = common.stored(groups, "vector-groups")
    nodes = nodes_of(rows, groups)
    places = placed(nodes)
    found = searched(places, adjacency(places), least)
    pairs = found.filter("other is not null").select(F.least("node", "other").alias("a"), F.greatest("node", "other").alias("b")).distinct()
    more = common.stored(_verified(pairs, nodes, least), "cross-vector-links")
    counted = found.filter("other is null").select("node", "links")
    counted = counted.unionByName(more.select(F.col("a").alias("node"), F.col("copies_b").alias("links"))).unionByName(more.select(F.col("b").alias("node"), F.col("copies_a").alias("links")))
    links = counted.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.filter("other is null and node <> root").select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(more.select("a", "b")))

    named = groups.join(links, "node", "left").join(roots.withColumnRenamed("v", "node"), "node", "left")
    named = common.stored(named.select("h1", "h2", "copies", "least", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("root", "node").alias("root")), "vector-roots")
    first = named.groupBy("root").agg(F.min("least").alias("component_id"))
    named = Dealt(named, "root").join(named, first).select("h1", F.col("h2").alias("second"), (F.col("copies") - 1 + F.col("links")).alias("n_links"), "component_id")
    named = common.stored(named, "vector-components")
    linked = rows.filter("h1 is not null").select("vec_id", "h1", "h2")
    linked = Dealt(linked, "h1").join(linked, named).filter("h2 = second").select("vec_id", "n_links", "component_id")
    alone = rows.filter("h1 is null").select("vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(alone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))


def audit(embeddings: DataFrame, found: DataFrame, queries: int = 256, least: float = LEAST) -> DataFrame:
    """queries, true_links, found_links, recall: about `queries` vectors against all rows by brute force. Ids must be unique."""
    spark, rows = embeddings.sparkSession, common.only(embeddings, "vec_id", "label", "embedding").filter("label is not null and embedding is not null")
    drawn = common.sample_below(rows, "vec_id", queries, rows.count()).collect()
    sent = spark.sparkContext.broadcast([(r["vec_id"], r["label"], r["embedding"]) for r in drawn])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = _by_dim(sent.value)
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("vec_id", "label", "embedding")), strict=True))
            for d, (ids, labels, x) in _by_dim(rows).items():
                if d in wanted:
                    names, others, y = wanted[d]
                    links = (y @ x.T >= least) & (others[:, None] == labels[None, :]) & (names[:, None] != ids[None, :])
                    yield pa.RecordBatch.from_arrays([pa.array(names), pa.array(links.sum(axis=1))], names=["vec_id", "links"])

    true = rows.mapInArrow(count, "vec_id bigint, links bigint").groupBy("vec_id").agg(F.sum("links").alias("links"))
    both = true.join(found.select("vec_id", "n_links"), "vec_id")
    total = both.agg(F.count("*").alias("queries"), F.sum("links").alias("true_links"), F.sum(F.least("links", "n_links")).alias("found_links"))
    return total.withColumn("recall", F.when(F.col("true_links") > 0, F.col("found_links") / F.col("true_links")).otherwise(1.0))


def _by_dim(rows: list[tuple]) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Of each dimension the ids, labels and unit vectors of the rows (id, label, vector) that can link."""
    out: dict[int, list[tuple]] = {}
    for i, label, vector in rows:
        v = np.array([np.nan if x is None else x for x in vector], np.float64)
        if len(v) and np.isfinite(v).all() and v.any():
            v = v / np.abs(v).max()
            out.setdefault(len(v), []).append((i, label, v / np.linalg.norm(v)))
    return {d: (np.array([r[0] for r in own]), np.array([r[1] for r in own]), np.array([r[2] for r in own])) for d, own in out.items()}
