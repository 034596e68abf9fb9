"""One query per operator, over its whole table, and its SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import divergence, embedding_dedup, exact_search, fingerprints, language_id, license_scan, mixing, ngram_join, packing, quality, substring_dedup, url_filter, whitening

#: Rules of op10, as (verdict, host, path).
URL_RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"), ("block", "net", "/es/"), ("block", "net", "/fr/"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.jaccard_groups(_table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_vectors(_table(spark, sf_dir, "embeddings"))


def op3_pareto_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_sources(_table(spark, sf_dir, "documents").select("doc_id", "source", "text")).select("doc_id", "size", "source_size", "target", "taken")


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.identify(docs, language_id.fit(docs))


def op6_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"))


def sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, host, path) of documents whose number ends a page's path; path: its first part."""
    path = url_filter.url_path(F.col("url"))
    rows = _table(spark, sf_dir, "pages").select(_number(path).alias("doc_id"), url_filter.url_host(F.col("url")).alias("host"), F.regexp_extract(path, r"^/[^/]*", 0).alias("path"))
    return rows.where("doc_id is not null")


def _number(path: Column) -> Column:
    return F.regexp_extract(path, r"^/[^/]*/(\d{1,18})", 1).try_cast("long")


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), sites=sites(spark, sf_dir))


def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.cut_repeated(_table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_removed", "kept_sha256")


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_table(spark, sf_dir, "documents")).drop("spans")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A page's label is that of the document whose number ends its path."""
    pages, labels = _table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int").alias("bad")
    shown = pages.select(url_filter.url_host(F.col("url")).alias("host"), _number(url_filter.url_path(F.col("url"))).alias("number"))
    outcomes = shown.join(labels.select("doc_id", bad), F.col("number") == F.col("doc_id")).select("host", "bad")
    return url_filter.filter_urls(pages, outcomes, URL_RULES)


def op11_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fiftieth vector is a query against all others."""
    vectors = _table(spark, sf_dir, "embeddings")
    return exact_search.top_k(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.audit(_table(spark, sf_dir, "documents"))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A deviation beyond a long is null."""
    return whitening.whiten(_table(spark, sf_dir, "embeddings")).withColumn("deviation", F.col("deviation").try_cast("long"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    ops = (op1_ngram_jaccard_join, op2_embedding_near_dedup, op3_pareto_mixing, op4_fingerprints, op5_language_id, op6_best_fit_packing, op7_quality_classifier, op8_substring_dedup, op9_license_scan, op10_url_filter, op11_exact_top_k, op12_source_divergence, op13_embedding_whitening, pipeline)
    return {f.__name__: f for f in ops}
