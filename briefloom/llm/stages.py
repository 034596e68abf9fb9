"""Stages of the corpus pipeline: from raw documents to packed training sequences.

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as Parquet in between.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import mixing, ngram_join, packing, quality, substring_dedup
from .queries import sites
from .storage import stash

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")
#: Windows of so many words are repeats here: passages, not phrases.
PASSAGE = 25


def judged(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents of low quality and toxic ones."""
    return quality.keep_good(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), sites=sites(spark, sf_dir)).select(*COLUMNS)


def near_deduplicated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the first document of each group of near copies (five words, 0.8)."""
    return ngram_join.keep_first(docs).select(*COLUMNS)


def passages_cut(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages that stand in an earlier document; n_chars follows the text."""
    return substring_dedup.cut_repeated(docs, window=PASSAGE).selectExpr("doc_id", "text", "lang", "source", "cast(length(text) as bigint) as n_chars")


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Takes documents toward the sources' target weights, some more than once."""
    return mixing.mixed(docs).select(*COLUMNS)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs token sequences of 2048."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", judged),
    ("near_duplicates", near_deduplicated),
    ("substrings", passages_cut),
    ("mix", mixed),
    ("pack", packed),
]

#: The classifier and the packing have no form in SQL; tests hold stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = stash(docs)
    return docs
