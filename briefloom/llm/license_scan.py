"""License scans by diagonal voting, by Spark functions alone.

All rolling hashes of k words of all texts are joined to the positions at which templates hold the same k words. A hit
whose k words are the template's own votes for its diagonal, the offset between text and template; votes are put
together per document, template and diagonal, and diagonals that differ by a few words (a word put in or left out) are
merged. A span is verified by the share of its template's words that its hits cover. Only hits are shuffled, texts
never; a small table of templates is broadcast, a large one joined by shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .fingerprints import let
from .license_texts import NOTICES, PHRASES, TEXTS

K = 3
#: Diagonals up to so many words apart are one alignment.
SLACK = 2
#: Share of a template's words that a span must hold.
LEAST = 0.8
#: Templates are broadcast up to so many words.
MOST_WORDS = 100_000
#: What stands between words.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
TEMPLATES = NOTICES + TEXTS

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def text_words(text: Column) -> Column:
    """Words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of the text, A-Z lower-cased."""
    return F.filter(F.split(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), BETWEEN), lambda w: w != "")


def template_words(text: str) -> list[str]:
    return [w for w in re.split(BETWEEN, text.translate(str.maketrans(_UPPER, _LOWER))) if w]


def _grams(words: Column) -> Column:
    """For each place the hash of K words, and the words."""
    at = lambda i: [F.get(words, i + j) for j in range(K)]
    grams = F.transform(F.sequence(F.lit(0), F.size(words) - K), lambda i: F.struct(F.xxhash64(*at(i)).alias("gram"), F.concat_ws(" ", *at(i)).alias("held")))
    return F.when(F.size(words) >= K, grams)


def _table(spark: SparkSession, rows: list[Column]) -> DataFrame:
    """A small table of structs."""
    return spark.range(1).select(F.inline(F.array(*rows)))


def _templates(spark: SparkSession, texts: Sequence[Sequence[str]]) -> DataFrame:
    """(template, at, gram, own)."""
    rows = _table(spark, [F.struct(F.lit(i).alias("template"), F.split(F.lit(" ".join(t)), " ").alias("words")) for i, t in enumerate(texts)])
    return rows.select("template", F.posexplode(_grams(F.col("words"))).alias("at", "g")).select("template", "at", F.col("g.gram").alias("gram"), F.col("g.held").alias("own"))


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", phrases: Sequence[tuple[str, str]] = PHRASES, templates: Sequence[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """(``key``, n_words, n_base, first_word, last_word, base_labels, labels, score, spans) for each row.

    n_base counts the places of phrases; first_word and last_word are the smallest and largest of their starts, else
    null. labels adds those of templates of which a span holds at least LEAST of the words and half of the
    k-grams; score is the best share (1 for a phrase, 0 without a span). Phrases and templates have at least K words.
    Null text: no words. Rows that repeat a key are judged each on its own text, as are rows with a null key.
    Other columns are not read.
    """
    every = [template_words(t) for t, _ in [*phrases, *templates]]
    if min(map(len, every), default=K) < K:
        raise ValueError(f"phrases and templates have {K} words or more")
    texts = docs.select(F.col(key).cast("long").alias("id"), F.col(text).cast("string").alias("text"))
    # a row is known by its key and its text
    texts = texts.select("id", F.xxhash64("text").alias("digest"), "text")
    known = _templates(docs.sparkSession, every)
    known = F.broadcast(known) if sum(map(len, every)) <= MOST_WORDS else known
    grams = texts.where("text is not null").select("id", "digest", F.posexplode(let(text_words(F.col("text")), _grams)).alias("place", "g"))
    hits = grams.select("id", "digest", "place", F.col("g.gram").alias("gram"), F.col("g.held").alias("held")).join(known, "gram").where("held = own")
    diagonals = hits.groupBy("id", "digest", "template", (F.col("place") - F.col("at")).alias("diagonal")).agg(F.collect_set("at").alias("votes"))

    # phrases stand on one diagonal; templates on neighbouring ones
    of_phrase = F.col("template") < len(phrases)
    along = Window.partitionBy("id", "digest", "template").orderBy("diagonal")
    new = (of_phrase | (F.coalesce(F.col("diagonal") - F.lag("diagonal").over(along), F.lit(SLACK + 1)) > SLACK)).cast("int")
    merged = diagonals.withColumn("grp", F.sum(new).over(along)).groupBy("id", "digest", "template", "grp").agg(F.min("diagonal").alias("low"), F.array_distinct(F.flatten(F.collect_list("votes"))).alias("votes"))
    needed = [len(w) - K + 1 if i < len(phrases) else max(1, (len(w) - K + 1) // 2) for i, w in enumerate(every)]
    given = _table(docs.sparkSession, [F.struct(F.lit(i).alias("template"), F.lit(label).alias("label"), F.lit(len(w)).alias("n"), F.lit(k).alias("needed")) for i, ((_, label), w, k) in enumerate(zip([*phrases, *templates], every, needed))])
    covered = F.size(F.array_distinct(F.flatten(F.transform("votes", lambda a: F.sequence(a, a + K - 1)))))
    spans = merged.join(F.broadcast(given) if len(every) <= MOST_WORDS else given, "template").where(F.size("votes") >= F.col("needed")).withColumn("share", covered / F.col("n")).where(F.col("share") >= F.when(of_phrase, 1.0).otherwise(LEAST))
    spans = spans.groupBy("id", "digest").agg(F.collect_list(F.struct(of_phrase.alias("base"), "label", F.greatest("low", F.lit(0)).alias("start"), "share")).alias("spans"))

    rows = texts.select("id", "digest", F.size(text_words(F.col("text"))).cast("long").alias("n_words"))
    spans = spans.withColumnRenamed("id", "i").withColumnRenamed("digest", "d")
    rows = rows.join(spans, (F.col("digest") == F.col("d")) & F.col("id").eqNullSafe(F.col("i")), "left")
    rows = rows.withColumn("spans", F.coalesce("spans", F.array().cast("array<struct<base:boolean,label:string,start:int,share:double>>")))
    base = F.filter("spans", lambda s: s["base"])
    named = lambda a: F.array_join(F.array_sort(F.array_distinct(F.transform(a, lambda s: s["label"]))), ",")
    starts = F.transform(base, lambda s: s["start"].cast("long"))
    return rows.select(
        F.col("id").alias(key), "n_words", F.size(base).cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        named(base).alias("base_labels"), named(F.col("spans")).alias("labels"), F.coalesce(F.array_max(F.transform("spans", lambda s: s["share"])), F.lit(0.0)).alias("score"),
        F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["label"].alias("label"), s["share"].alias("share")))).alias("spans"),
    )
