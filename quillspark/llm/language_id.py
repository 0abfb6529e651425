"""Language identification by multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 2- and 3-grams of every chosen document in Spark, one
row per language and bucket, and leaves a matrix of log probabilities of
languages x BUCKETS. That matrix is all that is broadcast; it doesn't grow with
the documents. Scoring looks up the n-grams of a batch in numpy.

Cases: a null text and a text without letters give `und` with score 0. Rows
that repeat are scored alike, each on its own. Without any labelled row every
text is `und`. Ties go to the language that sorts first. A very long text is
scored whole, in pieces of CHUNK_CHARS that overlap so that no n-gram is lost.
Columns besides doc_id, text and lang aren't read; predict() replaces columns
lang_pred and score of its input and keeps all others. Rows with a null doc_id
are in no held-out fold. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

UNKNOWN = "und"
BUCKETS = 1 << 15
#: Labelled documents that training reads at most (chosen by a hash of doc_id).
TRAIN_DOCS = 20_000
#: Characters that are hashed at a time.
CHUNK_CHARS = 1_000_000
_SEPARATOR = 0x20


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


_ASCII_LETTER = np.zeros(128, bool)
_ASCII_LETTER[97:123] = True


def _normalised(codes: np.ndarray) -> np.ndarray:
    """ASCII that isn't a letter becomes one separator; the rest stays."""
    low = codes < 128
    out = codes.copy()
    out[low] = np.where(_ASCII_LETTER[codes[low]], codes[low], _SEPARATOR)
    return out


def ngram_buckets(codes: np.ndarray) -> np.ndarray:
    """Buckets of the 2- and 3-grams that start at each position but the last two."""
    c = codes.astype(np.uint32)
    two = c[:-2] * np.uint32(0x9E3779B1) + c[1:-1] * np.uint32(0x85EBCA77)
    three = two ^ (c[2:] * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F))
    mix = lambda h: (((h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)) >> np.uint32(17)).astype(np.int32)
    return np.stack([mix(two), mix(three)])


def _pieces(starts: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """ngram_buckets() of codes, -1 at the last two places of each piece: their n-grams would reach into the next one."""
    buckets = np.full((2, len(codes)), -1, np.int32)
    if len(codes) > 2:
        buckets[:, :-2] = ngram_buckets(codes)
    ends = np.append(starts[1:], len(codes))
    for back in (1, 2):
        buckets[:, np.maximum(ends - back, starts)] = -1
    return buckets


def _chunks(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For runs of texts: (row of each piece, start of each piece, codes). Long texts span several."""
    rows, starts, held, size = [], [], [], 0
    for i, text in enumerate(texts):
        text = text or ""
        # pieces overlap by two characters, so no n-gram is lost or counted twice
        for at in range(0, max(1, len(text)), CHUNK_CHARS):
            piece = _normalised(_codes(text[max(0, at - 2) : at + CHUNK_CHARS]))
            piece = np.concatenate([[_SEPARATOR] * (1 if at == 0 else 0), piece, [_SEPARATOR, _SEPARATOR] if at + CHUNK_CHARS >= len(text) else []])
            rows.append(i)
            starts.append(size)
            held.append(piece.astype(np.uint32))
            size += len(piece)
            if size >= CHUNK_CHARS:
                yield np.array(rows), np.array(starts), np.concatenate(held)
                rows, starts, held, size = [], [], [], 0
    if rows:
        yield np.array(rows), np.array(starts), np.concatenate(held)


def train(docs: DataFrame, max_docs: int = TRAIN_DOCS, alpha: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages, sorted, and log probabilities [languages, BUCKETS + 1]; the last column is the prior."""
    labelled = common.only(docs, "doc_id", "text", "lang").filter(F.col("lang").isNotNull() & F.col("text").isNotNull())
    total = labelled.select("doc_id").count()
    chosen = common.sample_below(labelled, "doc_id", max_docs, total).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for lang in langs:
                sums.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))[BUCKETS] += 1
            for lang in set(langs):
                mine = [t for x, t in zip(langs, texts, strict=True) if x == lang]
                for _, starts, codes in _chunks(mine):
                    sums[lang][:BUCKETS] += np.bincount(_pieces(starts, codes).ravel() + 1, minlength=BUCKETS + 1)[1:]
        for lang, v in sums.items():
            at = np.flatnonzero(v)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(v[at], pa.int64())], names=["lang", "bucket", "n"])

    counts = chosen.mapInArrow(count, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS + 1))
    if langs:
        table[np.searchsorted(langs, counts["lang"]), counts["bucket"].to_numpy(np.int64)] = counts["n"]
        grams = table[:, :BUCKETS] + alpha
        table[:, :BUCKETS] = np.log(grams / grams.sum(axis=1, keepdims=True))
        table[:, BUCKETS] = np.log(table[:, BUCKETS] / table[:, BUCKETS].sum())
    return langs, table.astype(np.float32)


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def score_texts(texts: list[str | None], langs: list[str], table: np.ndarray) -> tuple[list[str], np.ndarray]:
    """The best language and its posterior probability, for each text."""
    log = np.zeros((len(texts), len(langs)))
    for rows, starts, codes in _chunks(texts) if langs else ():
        buckets = _pieces(starts, codes)
        for k in range(len(langs)):
            row = np.append(table[k, :BUCKETS], np.float32(0))  # -1 finds the zero at the end
            np.add.at(log[:, k], rows, np.add.reduceat((row[buckets[0]] + row[buckets[1]]).astype(np.float64), starts))
    known = np.array([_has_letter(t) for t in texts], bool) if langs else np.zeros(len(texts), bool)
    if not langs:
        return [UNKNOWN] * len(texts), np.zeros(len(texts))
    log += table[:, -1]
    best = log.argmax(axis=1)
    posterior = 1 / np.exp(log - log.max(axis=1, keepdims=True)).sum(axis=1)
    return [langs[b] if k else UNKNOWN for b, k in zip(best, known, strict=True)], np.where(known, posterior, 0.0)


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """docs with lang_pred and score. Only the column text is an input."""
    spark = docs.sparkSession
    common.small_batches(spark)
    model = spark.sparkContext.broadcast((langs, table))
    docs = docs.drop("lang_pred", "score")
    schema = docs.withColumns({"lang_pred": F.lit("").cast("string"), "score": F.lit(0.0)}).schema

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
        pred, score = score_texts(texts, *model.value)
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array(pred, pa.string()), pa.array(score, pa.float64())], names=[*batch.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(common.per_batch(work), schema)


def known(docs: DataFrame, fold: tuple[int, int] = (5, 0), least: float = 0.5) -> DataFrame:
    """The documents whose language is known and at least so certain, with their own columns."""
    langs, table = train(docs.filter(~common.held_out("doc_id", *fold)))
    rows, back = common.set_aside(docs, "lang_pred", "score")
    return back(predict(rows, langs, table).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least)))


def identify(docs: DataFrame, fold: tuple[int, int] = (5, 0), max_docs: int = TRAIN_DOCS) -> DataFrame:
    """Trains outside the held-out fold and predicts every row: docs, held_out, lang_pred, score."""
    out = common.held_out("doc_id", *fold)
    langs, table = train(docs.filter(~out), max_docs)
    return predict(docs, langs, table).withColumn("held_out", common.held_out("doc_id", *fold))
