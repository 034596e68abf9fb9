"""Mixing sources to target weights by Pareto order sampling.

Targets fill like water: each source gets its share by weight of all words, stops at ``cap`` times its own size, and
what is over goes to the others by weight. Within a source the expected number of copies of a document follows its
merit: it stops at ``cap`` too, and what is over goes to the other documents. The whole part of that number are certain
copies; its fraction is the inclusion probability of one more. For these, documents are ranked by their random odds
divided by their inclusion odds, and the lowest ranks are taken until the words that are missing are reached as nearly
as possible. Random numbers come from a hash of the key, so that reruns agree. The cutting rank of a source is found
from a histogram of ranks and an exact order inside the one bucket that holds it, so that no source is sorted as a whole.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .storage import stash

#: Ranks are dealt to so many buckets; only the bucket at the cut is ordered exactly.
BUCKETS = 4096
#: Merits are rounded to so many steps an octave, so that a source has few different ones.
STEPS = 16


def n_words(text: Column) -> Column:
    """Number of words ``[^\\x20\\x09-\\x0D]+``; null: 0."""
    return F.coalesce(F.size(F.filter(F.split(text, "[ \\x09-\\x0D]+"), lambda w: w != "")), F.lit(0)).cast("long")


def uniform(key: Column) -> Column:
    """A fixed number between 0 and 1, exclusive, from the MD5 of the key as text."""
    digest = F.md5(F.coalesce(key.cast("string"), F.lit("null")))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def by_length(size: Column) -> Column:
    """The merit of a document of so many words: longer ones are taken more often, by the logarithm."""
    return 1 + F.log2(1 + size)


def _shares(rows: DataFrame, by: Sequence[str]) -> DataFrame:
    """Adds ``share`` of ``total`` to rows (weight, full, level = full / weight, total): in proportion to weight, full at most, within each group of ``by``."""
    every, up = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("level").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    filled = F.sum("full").over(up) + F.col("level") * (F.sum("weight").over(every) - F.sum("weight").over(up))
    rows = rows.withColumn("filled", filled <= F.col("total"))
    rest = F.col("total") - F.sum(F.when(F.col("filled"), F.col("full")).otherwise(0.0)).over(every)
    share = F.try_divide(rest * F.col("weight"), F.sum(F.when(F.col("filled"), 0.0).otherwise(F.col("weight"))).over(every))
    return rows.withColumn("share", F.when(F.col("filled"), F.col("full")).otherwise(F.least(F.col("full"), F.coalesce(share, F.lit(0.0))))).drop("weight", "full", "level", "total", "filled")


def targets(sizes: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """Adds ``target`` to one row per source (source, source_size). Sources in code point order, null last, take the weights in turn."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    at = F.pmod(F.row_number().over(order) - 1, F.lit(len(weights)))
    rows = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (at + 1).cast("int")))
    rows = rows.withColumn("full", cap * F.col("source_size")).withColumn("level", F.try_divide("full", "weight")).withColumn("total", F.sum("source_size").over(Window.partitionBy()))
    return _shares(rows, []).withColumnRenamed("share", "target")


def _plan(sized: DataFrame, weights: Sequence[float], cap: float) -> DataFrame:
    """(source, grade, source_size, target, expected copies, words missing from the source's whole copies): a few rows per source."""
    graded = sized.groupBy("source", "grade").agg(F.sum("size").alias("words"))
    graded = stash(graded)
    goals = targets(graded.groupBy("source").agg(F.sum("words").alias("source_size")), weights, cap)
    rows = graded.join(goals.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
    merit = F.pow(F.lit(2.0), F.col("grade") / STEPS)
    rows = rows.withColumn("weight", merit * F.col("words")).withColumn("full", cap * F.col("words")).withColumn("level", cap / merit).withColumn("total", F.col("target"))
    rows = _shares(rows, ["source"]).withColumn("expected", F.round(F.coalesce(F.try_divide("share", "words"), F.lit(0.0)), 9))
    missing = F.col("target") - F.sum(F.floor("expected") * F.col("words")).over(Window.partitionBy("source"))
    return rows.withColumn("missing", missing).drop("words", "share")


def _ranked(docs: DataFrame) -> DataFrame:
    """Adds ``whole`` copies and ``rank``, the Pareto rank mapped to 0..1, null without inclusion odds; needs size, id and expected."""
    part, u = F.col("expected") - F.floor("expected"), uniform(F.col("id"))
    ranks = (u / (1 - u)) / (part / (1 - part))
    return docs.withColumn("whole", F.floor("expected")).withColumn("rank", F.when((part > 0) & (F.col("size") > 0), ranks / (1 + ranks)))


def mix_sources(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", weights: Sequence[float] = (5, 2, 1), cap: float = 3.0, merit: Column | None = None) -> DataFrame:
    """``docs`` with size, source_size, target, copies and taken (= size * copies), one row per row.

    Expected copies within a source are in proportion to merit (> 0, by default that of ``by_length``; null: 1), rounded
    to STEPS an octave. Null text: size 0. A null source is a source of its own. Rows with one key (or null keys) share their random
    number; those of one size are taken alike. An empty table gives an empty result; a source without words has
    target 0 and copies 0. Extra columns are carried along, also those with the names of added ones, which come last.
    """
    names = [f"c{i}" for i in range(len(docs.columns))]
    col = lambda name: F.col(names[docs.columns.index(name)])
    given = docs.select("*", (F.lit(None) if merit is None else merit).cast("double").alias("_merit")).toDF(*names, "merit")
    rows = given.withColumn("size", n_words(col(text))).withColumn("id", col(key)).withColumn("source", col(source))
    if merit is None:
        rows = rows.withColumn("merit", by_length(F.col("size")))
    rows = rows.withColumn("grade", F.round(STEPS * F.log2(F.coalesce("merit", F.lit(1.0)))).cast("int")).drop("merit")
    sized = stash(rows.select("id", "source", "size", "grade"))
    plan = stash(_plan(sized, weights, cap))

    def with_plan(df: DataFrame, p: DataFrame) -> DataFrame:
        p = p.withColumnRenamed("source", "s").withColumnRenamed("grade", "g")
        return df.join(p, F.col("source").eqNullSafe(F.col("s")) & (F.col("grade") == F.col("g")), "left").drop("s", "g")

    ranked = _ranked(with_plan(sized, plan)).where("rank is not null").withColumn("bucket", F.floor(F.col("rank") * BUCKETS))
    sums = ranked.groupBy("source", "bucket").agg(F.sum("size").alias("words"), F.first("missing").alias("missing"))
    before = F.coalesce(F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    cut = stash(sums.withColumn("before", before).where("before <= missing and missing < before + words").select("source", "bucket", "before", "missing"))
    edge = ranked.select("source", "bucket", "id", "rank", "size").join(cut.select(F.col("source").alias("s"), F.col("bucket").alias("b"), "before", "missing"), F.col("source").eqNullSafe(F.col("s")) & (F.col("bucket") == F.col("b")))
    edge = edge.groupBy("source", "bucket", "before", "missing", "rank", "id").agg(F.sum("size").alias("size"))
    running = F.sum("size").over(Window.partitionBy("source", "bucket").orderBy("rank", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    taken = edge.withColumn("running", F.col("before") + running - F.col("size") / 2).where("running <= missing")
    last = taken.groupBy("source").agg(F.max(F.struct("rank", "id")).alias("last"))
    cuts = cut.select("source", "bucket").join(last.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").select("source", "bucket", "last")
    plan = stash(plan.join(cuts.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s"))

    out = _ranked(with_plan(rows, plan))
    at = F.floor(F.col("rank") * BUCKETS)
    inside = F.struct("rank", "id") <= F.col("last")
    # no bucket at the cut: nothing is missing
    extra = F.when(F.col("rank").isNull() | F.col("bucket").isNull(), F.lit(False)).when(at == F.col("bucket"), F.coalesce(inside, F.lit(False))).otherwise(at < F.col("bucket"))
    copies = F.when(F.col("size") > 0, F.col("whole") + extra.cast("long")).otherwise(F.lit(0).cast("long"))
    out = out.withColumn("copies", copies).withColumn("taken", F.col("size") * F.col("copies"))
    return out.select(*[F.col(n).alias(c) for n, c in zip(names, docs.columns)], "size", "source_size", F.col("target").cast("double").alias("target"), "copies", "taken")


def mixed(docs: DataFrame, **options) -> DataFrame:
    """The rows that the mix takes, each as often as it is taken, with the columns of ``docs``."""
    names = [f"c{i}" for i in range(len(docs.columns))]
    rows = mix_sources(docs, **options).toDF(*names, "size", "source_size", "target", "copies", "taken")
    return rows.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select(*names).toDF(*docs.columns)
