"""Names of a dictionary of any size in texts: brands, models, features or categories that no expression could list."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from ..functions.text import plain

#: The sieve's bits as a power of two: 2**24 are at most 262,144 rows of two numbers, whatever the dictionary's size.
SIEVE = 24
#: Parts into which a phrase's places are dealt, so that a phrase that most texts hold isn't one task's.
SALTS = 16


def words(c: Column) -> Column:
    """Words of a text in ``plain`` form; none of a null or empty one."""
    return F.filter(F.split(plain(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")


def phrases(dictionary: DataFrame, alias: str) -> DataFrame:
    """(phrase, n_words): a dictionary's distinct aliases; those without words are none."""
    held = dictionary.select(words(F.col(alias)).alias("_w")).where(F.size("_w") > 0)
    return held.select(F.array_join("_w", " ").alias("phrase"), F.size("_w").alias("n_words")).distinct()


def _slot(phrase: Column) -> tuple[Column, Column]:
    """Row of the sieve, and the bit of its number, that stand for a phrase."""
    h = F.xxhash64(phrase).bitwiseAND(F.lit((1 << SIEVE) - 1))
    return F.shiftright(h, 6), h.bitwiseAND(F.lit(63)).cast("int")


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at)


def sieve(found: DataFrame) -> DataFrame:
    """(slot, bits): bits of all values of a one-column table. What it lets through may be one of them; what it holds back is none."""
    slot, at = _slot(F.col(found.columns[0]))
    return found.select(slot.alias("slot"), at.alias("_at")).groupBy("slot").agg(F.bit_or(_bit(F.col("_at"))).alias("bits"))


def _sieved(rows: DataFrame, c: str, through: DataFrame) -> DataFrame:
    slot, at = _slot(F.col(c))
    return rows.withColumn("slot", slot).join(F.broadcast(through), "slot").where(F.col("bits").bitwiseAND(_bit(at)) != 0).drop("slot", "bits")


def _dealt(left: DataFrame, right: DataFrame, spread: Sequence[str]) -> DataFrame:
    """``left`` joined to ``right`` by phrase; ``left``'s rows of one phrase are dealt to SALTS parts, ``right`` meets them all."""
    own = left.withColumn("_salt", F.pmod(F.xxhash64(*spread), F.lit(SALTS)).cast("int"))
    return own.join(right.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["phrase", "_salt"]).drop("_salt")


def spans(rows: DataFrame, key: Sequence[str], text: str, found: DataFrame) -> DataFrame:
    """(``key``, text_id, place, n_words, phrase): every place where words of a phrase stand consecutively, words counted from 0.

    Where the text is read, its words pass a sieve of the first one or two words of phrases; where one stands, runs of as
    many words as phrases have pass a sieve of phrases; only those that may be one are shuffled, and meet phrases by equality. How many lengths phrases have is all that the driver learns: they
    are at most about the square root of twice the dictionary's words. Spans may overlap. text_id tells texts of a repeated
    key apart; rows that repeat key and text have equal spans, once each. Null texts and those without words have none.
    """
    lengths = sorted(r[0] for r in found.select("n_words").distinct().collect())
    heads = sorted({min(n, 2) for n in lengths})
    listed = lambda ns: F.array(*map(F.lit, ns)).cast("array<int>")
    out = rows.select(*key, words(F.col(text)).alias("_w")).select(*key, F.xxhash64("_w").alias("text_id"), "_w")
    out = out.select(*key, "text_id", "_w", F.posexplode_outer("_w").alias("place", "_word"))
    out = out.select("*", F.explode(listed(heads)).alias("_n")).where(F.col("place") + F.col("_n") <= F.size("_w"))
    head = F.when(F.col("_n") == 1, F.col("_word")).otherwise(F.concat_ws(" ", "_word", F.get("_w", F.col("place") + 1)))
    out = _sieved(out.withColumn("_head", head), "_head", sieve(found.select(F.substring_index("phrase", " ", 2)).distinct()))
    longer = F.when(F.col("_n") == 1, listed([n for n in lengths if n == 1])).otherwise(listed([n for n in lengths if n > 1]))
    out = out.select(*key, "text_id", "_w", "place", F.explode(longer).alias("_n")).where(F.col("place") + F.col("_n") <= F.size("_w"))
    run = F.array_join(F.slice("_w", F.col("place") + 1, F.col("_n")), " ")
    seen = _sieved(out.select(*key, "text_id", "place", run.alias("phrase")), "phrase", sieve(found.select("phrase")))
    met = _dealt(seen, found, ("text_id", "place"))
    return met.select(*key, "text_id", "place", "n_words", "phrase")


@F.pandas_udf(ArrayType(IntegerType()))
def _kept(starts: pd.Series, sizes: pd.Series) -> pd.Series:
    """Of a text's spans in order, the numbers of those that no kept one before overlaps."""

    def chosen(own, size) -> list[int]:
        end, kept = 0, []
        for i, (s, n) in enumerate(zip(own.tolist(), size.tolist())):
            if s >= end:
                kept.append(i)
                end = s + n
        return kept

    return pd.Series([chosen(s, n) for s, n in zip(starts, sizes)])


def longest(found: DataFrame, key: Sequence[str]) -> DataFrame:
    """Of ``spans``, those that a reader takes from left to right: at each place the longest, none inside or across another.

    A text's spans are one row, as its text was; rows that repeat are folded before the shuffle.
    """
    one = F.struct("place", (-F.col("n_words")).alias("less"), "phrase")
    lists = found.groupBy(*key, "text_id").agg(F.sort_array(F.collect_set(one)).alias("_s"))
    lists = lists.withColumn("_k", _kept(F.col("_s.place"), F.transform("_s", lambda s: -s["less"])))
    out = lists.select(*key, "text_id", F.explode(F.transform("_k", lambda i: F.get("_s", i))).alias("_m"))
    return out.select(*key, "text_id", "_m.place", (-F.col("_m.less")).alias("n_words"), "_m.phrase")


def named(found: DataFrame, dictionary: DataFrame, alias: str) -> DataFrame:
    """Spans with ``entry``, the dictionary's row of the phrase as a struct (no names clash); one row for each entry that has it."""
    entries = dictionary.select(F.array_join(words(F.col(alias)), " ").alias("phrase"), F.struct(*[F.col(c) for c in dictionary.columns]).alias("entry"))
    return _dealt(found, entries.where("phrase != ''"), ("text_id", "place"))


def mentions(rows: DataFrame, key: Sequence[str], text: str, dictionary: DataFrame, alias: str) -> DataFrame:
    """(``key``, text_id, place, n_words, phrase, entry): the dictionary's entries that texts name, leftmost and longest first."""
    return named(longest(spans(rows, key, text, phrases(dictionary, alias)), key), dictionary, alias)
