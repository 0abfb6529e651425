"""A corpus pipeline: language, near duplicates, benchmark passages, personal data, packing.

Each stage takes all that the one before it kept, written as Parquet and read again. All but the last keep the columns
of documents, whatever further ones there are and whatever they are called.

Cases: null, empty and letterless texts are of no known language and go in the first stage, so that later ones see none.
Of rows that repeat, and of near copies, the one with the smallest doc_id stays (nulls last); rows with a null or a
repeated doc_id are told apart by a key of their own, and those that are linked with nothing all stay. Ties between
languages go to the one that sorts first. Very long texts are taken whole in every stage. Without labelled rows no
language is known and nothing stays; an empty table gives no sequences; an empty benchmark drops nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillspark.llm import common, decontamination, jaccard, language_id, packing, pii, tokens

#: Documents whose language is less certain than this go.
LEAST_CERTAIN = 0.5


def keep_known_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Trains on the labelled rows outside the held-out fold; drops texts of no or an uncertain language."""
    return language_id.known(docs, least=LEAST_CERTAIN)


def keep_first_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.first_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontamination.clean(docs, common.table(spark, sf_dir, "benchmark"))


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs, tokens.default_path("byte_bpe_50k.json"))


STAGES = [
    ("language_id", keep_known_languages),
    ("ngram_jaccard", keep_first_of_near_duplicates),
    ("decontamination", drop_contaminated),
    ("pii", redact_personal_data),
    ("packing", pack_sequences),
]

#: Models and tokenizers aren't expressible in SQL; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
