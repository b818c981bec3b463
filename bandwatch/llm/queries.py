"""One query per operator, over its whole table, with production parameters; SQL where it can express the result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, centroids, host_rules, html_text, jaccard_join, language_id, lm_scoring, packing, secret_scan, token_counts, topk_search, url_filter, whitening
from .common import remainder, table


def op1_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    """URL filters: the rule or the model's verdict on each page's URL."""
    return url_filter.judge(table(spark, folder, "pages"))


def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    """Language ID of each document, learned from those that are not held out."""
    docs = table(spark, folder, "documents")
    found = language_id.predict(docs, language_id.fit(language_id.learnable(docs)))
    held_out = remainder(F.col("doc_id"), language_id.FOLDS) == language_id.HELD_OUT
    return found.select("doc_id", held_out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_host_rules(spark: SparkSession, folder: str) -> DataFrame:
    """Quality rules: counts of each document, and whether it stays given its host."""
    judged = host_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op4_html_text(spark: SparkSession, folder: str) -> DataFrame:
    """HTML extraction: the main text of each page."""
    return html_text.main_text(table(spark, folder, "pages"))


def op5_topk_search(spark: SparkSession, folder: str) -> DataFrame:
    """Exact top-k search: the documents nearest to each document whose id is divisible by 20."""
    docs = table(spark, folder, "documents")
    return topk_search.search(docs, docs.where("doc_id % 20 = 0"))


def op6_bpe(spark: SparkSession, folder: str) -> DataFrame:
    """BPE: each document's ids and decoded text, as digests."""
    return bpe.digests(table(spark, folder, "documents"))


def op7_packing(spark: SparkSession, folder: str) -> DataFrame:
    """Packing: where each piece of each document lies."""
    return packing.pack(packing.cut(table(spark, folder, "documents")))


def op8_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    """Secrets in each document: counts and spans."""
    return secret_scan.digest(secret_scan.find(table(spark, folder, "documents")))


def op9_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    """LM scoring: log10 probability of each document, learned from those that are not held out."""
    return lm_scoring.score(table(spark, folder, "documents"))


def op10_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    """N-gram Jaccard join: the class of each document at similarity 0.75 of five-word shingles."""
    return jaccard_join.join(table(spark, folder, "documents"))


def op11_centroids(spark: SparkSession, folder: str) -> DataFrame:
    """Centroid clustering: the cluster of each vector after five rounds."""
    return centroids.summary(*centroids.cluster(table(spark, folder, "embeddings")))


def op12_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Token counts: bytes and tokens of each whole text."""
    return token_counts.count(table(spark, folder, "documents"))


def op13_whitening(spark: SparkSession, folder: str) -> DataFrame:
    """Embedding whitening: each vector on the 16 largest principal components."""
    return whitening.whiten(table(spark, folder, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_language_id, op3_host_rules, op4_html_text, op5_topk_search, op6_bpe, op7_packing, op8_secret_scan, op9_lm_scoring, op10_jaccard_join, op11_centroids, op12_token_counts, op13_whitening)}
ORACLES = {"op3_host_rules": host_rules.ORACLE, "op11_centroids": centroids.ORACLE}
