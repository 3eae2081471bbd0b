"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, covertree, html_text, jaccard, langid, line_runs, mixing, pieces, prefix_trie, quality, secrets, simhash, url_filter
from .common import held_out, table
from .oracles import ORACLES  # noqa: F401

#: Rules of the url query, and the targets of the mix. Fixed values of the contracts.
URL_RULES = [("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block")]
MIX_WEIGHTS, MIX_EPOCHS = (5.0, 2.0, 1.0), 3.0


def op1_html_wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op2_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), MIX_WEIGHTS, MIX_EPOCHS)


def op3_cover_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return covertree.near_duplicates(table(spark, sf_dir, "embeddings"), 0.98)


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages"), URL_RULES, url_filter.fit(url_filter.seeds(spark)))


def op5_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.components(table(spark, sf_dir, "documents"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.searched(simhash.neighbours(table(spark, sf_dir, "documents")))


def op7_quality_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    model = quality.fit(docs, table(spark, sf_dir, "labels"), ~out)
    return quality.score(docs, model).select("doc_id", out.alias("held_out"), "score", F.when(F.col("score") >= 0.3, 1).otherwise(0).alias("predicted"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, out = table(spark, sf_dir, "documents"), held_out(F.col("doc_id"))
    return langid.predict(docs, langid.fit(docs, ~out)).select("doc_id", out.alias("held_out"), "lang_pred", "score")


def op9_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def piece_model() -> str:
    """Path of the public tokenizer's model file; the package that holds it is installed on every node."""
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.digests(table(spark, sf_dir, "documents"), piece_model())


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(table(spark, sf_dir, "conversations"))


def op12_line_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_runs.dedup(table(spark, sf_dir, "documents"), min_docs=5, min_chars=40)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op13_zone_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"), k=16, rounds=3, dims=64, scale=64)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_html_wrapper, op2_source_mix, op3_cover_tree, op4_url_filter, op5_ngram_jaccard, op6_simhash, op7_quality_crf, op8_language_id, op9_secret_scan,
    op10_sentencepiece, op11_prefix_trie, op12_line_runs, op13_zone_clusters)}
