"""How alike repeated runs are, and which leaders of a market product names cover."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.titles import evaluated
from .quality import ratio


def resemblance(sets: DataFrame, pairs: DataFrame, run: str, item: str) -> DataFrame:
    """``pairs`` (one, other: runs) with shared, either and jaccard (four decimals; null for two empty sets) of their sets (``run``, ``item``).

    Only stated pairs are compared: the items of one run are looked up in the other's, by run and item, so that an item of
    very many runs makes no pairs of them. Repeated items count once, null items don't; a run without items is empty.
    """
    own = sets.where(F.col(run).isNotNull() & F.col(item).isNotNull()).select(F.col(run).alias("_run"), F.col(item).alias("_item")).distinct()
    sizes = own.groupBy("_run").agg(F.count("*").alias("_n"))
    stated = pairs.select("one", "other").distinct()
    left = stated.join(own, F.col("one") == F.col("_run")).select("one", "other", F.col("_item").alias("_sought"))
    met = left.join(own, (F.col("other") == F.col("_run")) & (F.col("_sought") == F.col("_item"))).groupBy("one", "other").agg(F.count("*").alias("shared"))
    out = pairs.join(met, ["one", "other"], "left")
    for side in ("one", "other"):
        out = out.join(sizes.withColumnsRenamed({"_run": f"_run_{side}", "_n": f"_n_{side}"}), F.col(side) == F.col(f"_run_{side}"), "left").drop(f"_run_{side}")
    shared = F.coalesce("shared", F.lit(0))
    either = F.coalesce("_n_one", F.lit(0)) + F.coalesce("_n_other", F.lit(0)) - shared
    return out.select(*pairs.columns, shared.alias("shared"), either.alias("either"), ratio(shared, either).alias("jaccard"))


def words(c: Column) -> Column:
    """Distinct words of a name, as evaluations compare them."""
    return F.array_distinct(F.filter(F.split(evaluated(F.coalesce(c, F.lit(""))), " "), lambda w: w != ""))


def _states_line(held: Column, line: Column) -> Column:
    """Whether one of the words is the line's word; a word of letters also stands where digits follow it (hd, HD1400)."""
    return F.array_contains(held, line) | (line.rlike("^[a-z]+$") & F.exists(held, lambda w: F.startswith(w, line) & F.regexp_replace(w, "^[a-z]+", "").rlike(r"^\d+$") & (F.regexp_extract(w, "^[a-z]+", 0) == line)))


def _meeting(named: DataFrame, listed: DataFrame) -> DataFrame:
    """``named`` (with _held, its words) joined to each of ``listed`` (with _brand and _lines, words) that it covers."""
    common = named.select(F.explode("_held").alias("_word")).groupBy("_word").agg(F.count("*").alias("_count"))
    own = listed.columns
    listed = listed.withColumn("_place", F.monotonically_increasing_id())
    # a word of no product has no count: the leader can't be covered, and the join drops it
    sought = listed.withColumn("_word", F.explode("_brand")).join(common, "_word", "left")
    rarest = sought.groupBy("_place").agg(F.min_by(F.struct("_word", *own), F.struct(F.coalesce("_count", F.lit(0)).alias("n"), "_word")).alias("l")).select("l.*")
    met = named.withColumn("_word", F.explode("_held")).join(rarest, "_word").drop("_word")
    return met.where((F.size(F.array_except("_brand", "_held")) == 0) & ((F.size("_lines") == 0) | F.exists("_lines", lambda line: _states_line(F.col("_held"), line))))


def covered(products: DataFrame, leaders: DataFrame, name: str, leader: str, brand: str, lines: str) -> DataFrame:
    """``products`` joined to each of ``leaders`` (``leader``, ``brand``, ``lines``: an array of names) that ``name`` covers; adds ``leader``.

    A name covers a leader if it holds every word of its brand and, where it has lines, a word of one of them. A leader
    meets only names that hold its brand's rarest word, by an equi join; the rest is verified on the row. Leaders without
    a word of brand cover nothing. Rows of products and leaders that repeat are each counted.
    """
    named = products.withColumn("_held", words(F.col(name)))
    listed = leaders.select(F.col(leader).alias("_leader"), words(F.col(brand)).alias("_brand"), words(F.array_join(F.col(lines), " ")).alias("_lines"))
    return _meeting(named, listed).select(*products.columns, F.col("_leader").alias(leader))


def covering(products: DataFrame, leaders: DataFrame, name: str, leader: str, brand: str, lines: str) -> DataFrame:
    """(``leader``, names): how many rows ``covered`` has of each leader; leaders that no name covers are left out.

    Names with the same words are one with their number, and so are leaders with the same brand and lines: where a market
    repeats both, its pairs are counted and never made.
    """
    texts = products.groupBy(F.col(name).alias("_name")).agg(F.count("*").alias("_n"))
    named = texts.groupBy(F.array_sort(words(F.col("_name"))).alias("_held")).agg(F.sum("_n").alias("_n"))
    told = leaders.select(F.col(leader).alias(leader), F.col(brand).alias("_said"), F.array_join(F.col(lines), " ").alias("_listed"))
    kinds = told.select("_said", "_listed").distinct().withColumns({"_brand": F.array_sort(words(F.col("_said"))), "_lines": F.array_sort(words(F.col("_listed")))})
    counted = _meeting(named, kinds.select("_brand", "_lines").distinct()).groupBy("_brand", "_lines").agg(F.sum("_n").alias("names"))
    known = kinds.join(counted, ["_brand", "_lines"]).select(F.col("_said").alias("_own_said"), F.col("_listed").alias("_own_listed"), "names")
    out = told.join(known, F.col("_said").eqNullSafe(F.col("_own_said")) & F.col("_listed").eqNullSafe(F.col("_own_listed")))
    return out.groupBy(leader).agg(F.sum("names").alias("names"))
