"""Token ids in patched frame-of-reference blocks, written and read as a Spark table.

A file is a Parquet table of segments, so writing is atomic, survives lost
executors and works on any store that Spark knows. A segment holds whole
documents in ascending doc_id order and one binary payload:

    magic "PFR2", uint32 documents, uint32 ids, uint32 blocks
    int64[documents]     doc_id, 0 where it is null
    uint8[(documents + 7) // 8]  a bit for each null doc_id, big-endian bits
    uint32[documents]    ids of each document, the end id included
    uint32[blocks]       block minimum
    uint8[blocks]        packed width in bits
    uint16[blocks]       number of exceptions
    uint64[blocks + 1]   where each block's packed bits start, in bytes
    packed bits          BLOCK values of `width` bits each, big-endian bits
    uint8[exceptions]    place of each exception in its block
    uint32[exceptions]   its value less the block minimum

The width is the smallest that holds the PERCENTILE-th value of the block;
larger values are exceptions, and their packed slot is 0. The columns shard,
segment, first_doc, last_doc, n_ids and in_shard (the ids before it in its
shard) index the segments; a segment's start is that plus the totals of earlier
shards, one row each.

Cases: a null text is empty and has the end id alone. Rows with equal doc_id
follow one another, ordered by their text's hash and text. An empty table gives
an empty file. Null doc_ids come first and stay null. A text larger than a segment makes a larger segment.
Columns besides doc_id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common, tokens

BLOCK = 128
PERCENTILE = 90
#: Ids after which a segment is closed.
SEGMENT_IDS = 1 << 18
#: Bytes of text that a shard aims at.
SHARD_BYTES = 32 << 20
END_ID = 1
#: Shards whose totals may be broadcast (12 bytes each); beyond that they are joined by a shuffle.
BROADCAST_SHARDS = 1_000_000
SEGMENTS = "shard int, segment int, first_doc bigint, last_doc bigint, n_docs int, n_ids bigint, in_shard bigint, payload binary"


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, nulls: np.ndarray | None = None) -> bytes:
    """nulls: which doc_ids are null; none if left out."""
    nulls = np.zeros(len(doc_ids), bool) if nulls is None else nulls
    n = len(ids)
    blocks = -(-n // BLOCK)
    padded = np.zeros(blocks * BLOCK, np.uint32)
    padded[:n] = ids
    if n % BLOCK:
        padded[n:] = ids[-1]
    grid = padded.reshape(blocks, BLOCK)
    low = grid.min(axis=1, initial=2**32 - 1).astype(np.uint32)
    rest = grid - low[:, None]
    at = max(0, -(-BLOCK * PERCENTILE // 100) - 1)
    chosen = np.partition(rest, at, axis=1)[:, at] if blocks else np.zeros(0, np.uint32)
    width = np.ceil(np.log2(chosen.astype(np.float64) + 1)).astype(np.uint8)
    over = (rest >> width[:, None].astype(np.uint32)) > 0
    over[width == 32] = False
    rows, places = np.nonzero(over)
    values = rest[rows, places].astype(np.uint32)
    rest[over] = 0
    sizes = width.astype(np.uint64) * (BLOCK // 8)
    starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.uint64)
    body = np.zeros(int(starts[-1]), np.uint8)
    for w in np.unique(width[width > 0]):
        mine = np.flatnonzero(width == w)
        bits = (rest[mine][:, :, None] >> np.arange(int(w) - 1, -1, -1, dtype=np.uint32)) & np.uint32(1)
        packed = np.packbits(bits.astype(np.uint8).reshape(len(mine), -1), axis=1)
        body[(starts[mine].astype(np.int64)[:, None] + np.arange(packed.shape[1]))] = packed
    head = np.array([len(doc_ids), n, blocks], np.uint32)
    counts = np.bincount(rows, minlength=blocks).astype(np.uint16)
    return b"".join(
        [b"PFR2", head.tobytes(), doc_ids.astype(np.int64).tobytes(), np.packbits(nulls).tobytes(), lengths.astype(np.uint32).tobytes(), low.tobytes(), width.tobytes(), counts.tobytes(), starts.tobytes(), body.tobytes(), places.astype(np.uint8).tobytes(), values.tobytes()]
    )


class Segment:
    """Reads a payload: whole, or single blocks by way of the block starts."""

    def __init__(self, payload: bytes):
        if payload[:4] != b"PFR2":
            raise ValueError("not a token segment")
        docs, self.n, blocks = (int(x) for x in np.frombuffer(payload, np.uint32, 3, 4))
        at = 16

        def take(kind: type, count: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(payload, kind, count, at)
            at += out.nbytes
            return out

        self.doc_ids, nulls, self.lengths = take(np.int64, docs), take(np.uint8, -(-docs // 8)), take(np.uint32, docs)
        self.nulls = np.unpackbits(nulls, count=docs).astype(bool)
        self.low, self.width, self.counts = take(np.uint32, blocks), take(np.uint8, blocks), take(np.uint16, blocks)
        self.starts = take(np.uint64, blocks + 1)
        self.body = take(np.uint8, int(self.starts[-1]))
        total = int(self.counts.sum())
        self.places, self.values = take(np.uint8, total), take(np.uint32, total)
        self.first = np.concatenate([[0], np.cumsum(self.counts)]).astype(np.int64)

    def blocks(self, chosen: np.ndarray) -> np.ndarray:
        """The values of the chosen blocks, one row each."""
        out = np.zeros((len(chosen), BLOCK), np.uint32)
        for w in np.unique(self.width[chosen]):
            mine = np.flatnonzero(self.width[chosen] == w)
            if w:
                size = int(w) * (BLOCK // 8)
                rows = self.body[self.starts[chosen[mine]].astype(np.int64)[:, None] + np.arange(size)]
                bits = np.unpackbits(rows, axis=1).reshape(len(mine), BLOCK, int(w))
                values = np.zeros((len(mine), BLOCK), np.uint32)
                for k in range(int(w)):
                    values = (values << np.uint32(1)) | bits[:, :, k]
                out[mine] = values
        n = self.counts[chosen].astype(np.int64)
        row = np.repeat(np.arange(len(chosen)), n)
        at = np.repeat(self.first[chosen] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
        out[row, self.places[at]] = self.values[at]
        return out + self.low[chosen][:, None]

    def ids(self) -> np.ndarray:
        return self.blocks(np.arange(len(self.low))).ravel()[: self.n]

    def document(self, k: int) -> np.ndarray:
        """The ids of the k-th document, from its own blocks alone."""
        start = int(self.lengths[:k].sum(dtype=np.int64))
        end = start + int(self.lengths[k])
        first = start // BLOCK
        got = self.blocks(np.arange(first, -(-end // BLOCK))).ravel()
        return got[start - first * BLOCK : end - first * BLOCK]


def _write_partition(path: str, keep_space: bool, end_id: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    enc = tokens.encoder(path, keep_space)
    shard, segment, docs, arrays, size, done = TaskContext.get().partitionId(), 0, [], [], 0, 0

    def close() -> pa.RecordBatch:
        nonlocal segment, docs, arrays, size, done
        payload = encode_segment(np.array([d or 0 for d in docs], np.int64), np.array([len(a) for a in arrays], np.uint32), np.concatenate(arrays), np.array([d is None for d in docs]))
        out = pa.RecordBatch.from_pylist([{"shard": shard, "segment": segment, "first_doc": docs[0], "last_doc": docs[-1], "n_docs": len(docs), "n_ids": size, "in_shard": done, "payload": payload}], schema=_SEGMENT_ARROW)
        segment, docs, arrays, size, done = segment + 1, [], [], 0, done + size
        return out

    end = np.array([end_id], np.uint16)
    for batch in batches:
        ids, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
        for a, b in common.parts([len(t) for t in texts], 2_000_000):
            for doc, got in zip(ids[a:b], enc.encode(texts[a:b]), strict=True):
                docs.append(doc)
                arrays.append(np.concatenate([got, end]))
                size += len(got) + 1
                if size >= SEGMENT_IDS:
                    yield close()
    if docs:
        yield close()


_SEGMENT_ARROW = pa.schema([("shard", pa.int32()), ("segment", pa.int32()), ("first_doc", pa.int64()), ("last_doc", pa.int64()), ("n_docs", pa.int32()), ("n_ids", pa.int64()), ("in_shard", pa.int64()), ("payload", pa.binary())])


def write(docs: DataFrame, path: str, vocabulary: str, keep_space: bool = False, end_id: int = END_ID) -> None:
    """Encodes doc_id and text and writes the segments under path. Rows with a null doc_id sort first."""
    spark = docs.sparkSession
    common.small_batches(spark)
    docs = common.only(docs, "doc_id", "text")
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, spark.sparkContext.defaultParallelism, -(-size // SHARD_BYTES))
    dealt = docs.repartitionByRange(shards, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    dealt.mapInArrow(lambda batches: _write_partition(vocabulary, keep_space, end_id, batches), SEGMENTS).write.mode("overwrite").parquet(path)


def segments(spark: SparkSession, path: str) -> DataFrame:
    """The file's segments with start, the ids before each."""
    rows = spark.read.schema(SEGMENTS).parquet(path)
    totals = rows.groupBy("shard").agg(F.sum("n_ids").alias("total"))
    before = totals.select("shard", (F.sum("total").over(Window.orderBy("shard")) - F.col("total")).alias("shard_start"))
    if totals.count() <= BROADCAST_SHARDS:
        before = F.broadcast(before)
    return rows.join(before, "shard").withColumn("start", F.col("in_shard") + F.col("shard_start"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per document: doc_id, start, n_tokens, ids (binary, little-endian uint32)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start, payload in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                part = Segment(payload)
                ids, ends = part.ids().astype("<u4"), np.cumsum(part.lengths, dtype=np.int64)
                starts = ends - part.lengths
                rows = [ids[a:b].tobytes() for a, b in zip(starts, ends, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(part.doc_ids, mask=part.nulls), pa.array(start + starts, pa.int64()), pa.array(part.lengths.astype(np.int64)), pa.array(rows, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])

    return segments(spark, path).select("start", "payload").mapInArrow(work, "doc_id bigint, start bigint, n_tokens bigint, ids binary")


def digests(spark: SparkSession, path: str) -> DataFrame:
    """doc_id, start, n_tokens and the crc32 of each document's ids, read from the file."""
    return read(spark, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def crc_of(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())
