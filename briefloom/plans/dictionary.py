"""Queries of dictionaries of any size: what texts name of them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import mentions
from .registry import query, table

_WORDS = "string_split(trim(regexp_replace(replace(lower(coalesce(text, '')), '&', ' and '), '[^a-z0-9]+', ' ', 'g')), ' ')"
_SPANS = f"""
t AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id, {_WORDS} AS w FROM benchmark),
a AS (SELECT DISTINCT item_id, n, array_to_string(w[1:n], ' ') AS phrase FROM b, (VALUES (3), (5), (8)) v(n) WHERE len(w) >= n),
g AS (SELECT doc_id, n, w, unnest(range(0, len(w) - n + 1)) AS place FROM t, (VALUES (3), (5), (8)) v(n) WHERE len(w) >= n),
s AS (SELECT DISTINCT doc_id, place, n, phrase FROM (SELECT doc_id, place, n, array_to_string(w[place + 1:place + n], ' ') AS phrase FROM g) SEMI JOIN a USING (n, phrase))
"""


def _names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three, five and eight words of each item: names that lie within each other."""
    items = table(spark, sf_dir, "benchmark").select("item_id", mentions.words(F.col("text")).alias("w"), F.explode(F.array(*map(F.lit, (3, 5, 8)))).alias("n"))
    return items.where(F.size("w") >= F.col("n")).select("item_id", F.array_join(F.slice("w", 1, F.col("n")), " ").alias("alias"))


@query(f"""
WITH RECURSIVE {_SPANS},
l AS (SELECT doc_id, place, max(n) AS n FROM s GROUP BY ALL),
f AS (
  SELECT doc_id, min(place) AS place, arg_min(n, place) AS n FROM l GROUP BY doc_id
  UNION ALL
  SELECT l.doc_id, min(l.place), arg_min(l.n, l.place) FROM f JOIN l ON l.doc_id = f.doc_id AND l.place >= f.place + f.n GROUP BY l.doc_id)
SELECT DISTINCT f.doc_id, f.place::INT AS place, f.n::INT AS n_words, a.item_id FROM f JOIN s ON s.doc_id = f.doc_id AND s.place = f.place AND s.n = f.n JOIN a ON a.phrase = s.phrase AND a.n = s.n
""")
def dictionary_mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What all documents name of a dictionary that grows with the benchmark, leftmost and longest first, with the items it stands for."""
    found = mentions.mentions(table(spark, sf_dir, "documents"), ["doc_id"], "text", _names(spark, sf_dir), "alias")
    return found.select("doc_id", "place", "n_words", F.col("entry.item_id").alias("item_id"))
