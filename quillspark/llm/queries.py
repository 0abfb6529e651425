"""The corpus operators as registered queries: production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common, decontamination, divergence, html_text, jaccard, language_id, licenses, near_vectors, packing, pii, quality, ranked_search, token_files, tokens, toxicity
from .oracles import ORACLES  # noqa: F401  (for the entry points)


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(common.table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.digest(pii.find(common.table(spark, sf_dir, "documents")))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(common.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def op4_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = common.only(common.table(spark, sf_dir, "pages"), "page_id", "url", "html")
    return html_text.main_text(pages).select("page_id", "url", "text", "n_chars")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text", "lang")
    held = common.held_out("doc_id", 5, 0)
    langs, model = language_id.train(docs.filter(~held))
    out = language_id.predict(docs.select("doc_id", "text"), langs, model)
    return out.select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    held = common.held_out("doc_id", 4, 2)
    labels = common.table(spark, sf_dir, "labels").filter(~held)
    out = toxicity.score(docs, toxicity.train(docs.filter(~held), labels))
    return out.select("doc_id", held.alias("held_out"), "score", "predicted", "n_sentences", "worst_sentence", "worst_score")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = common.shared_path(spark, "token-files")
    token_files.write(common.table(spark, sf_dir, "documents"), path, tokens.default_path("word_bpe_49k.json"))
    return token_files.digests(spark, path)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")
    found = decontamination.find(docs, common.table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality.judge(quality.ledger(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text")))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "failed")


def quality_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9's ledger stored once, and what each rule of each policy version costs."""
    rows = quality.ledger(common.only(common.table(spark, sf_dir, "documents"), "doc_id", "text"))
    return quality.ablation(common.stored(rows, "quality-ledger"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(common.table(spark, sf_dir, "documents"), tokens.default_path("byte_bpe_50k.json"))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(common.table(spark, sf_dir, "documents"))


def op12_flat_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors.components(common.table(spark, sf_dir, "embeddings"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = ranked_search.build(common.table(spark, sf_dir, "documents"))
    return ranked_search.search(index, common.table(spark, sf_dir, "benchmark"), "item_id")


QUERIES = {f.__name__: f for f in (op1_licenses, op2_pii, op3_ngram_jaccard, op4_html_text, op5_language_id, op6_toxicity, op7_token_files, op8_decontamination, op9_quality, op10_packing, op11_divergence, op12_flat_graph, op13_ranked_search, quality_ablation)}
