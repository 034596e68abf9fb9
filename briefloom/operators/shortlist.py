"""Clean-up of ranked lists: observed links only, greedy dedupe in order, first matches, enrichment."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import images, links, titles
from .stored import stored


def observed_only(rows: DataFrame, observed: DataFrame, on: Sequence[str]) -> DataFrame:
    """Rows whose link was seen: a semi join, so that repeated sightings add nothing."""
    return rows.join(observed, list(on), "left_semi")


#: Rows that are left to be put in order group by group; and the least part of them that a round must settle.
REST, PROGRESS = 200_000, 16


def _folded(rows: DataFrame, group: str, order: str, keys: Sequence[str]) -> DataFrame:
    """The rule itself: rows in order, group by group; only keys of kept rows are held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, started, held = None, False, [set() for _ in keys]
        for batch in batches:
            codes = [batch.column(c).flatten()[-1].to_pylist() for c in (group, *keys)]
            chosen = []
            for i, (g, *own) in enumerate(zip(*codes)):
                if not started or g != current:
                    current, started, held = g, True, [set() for _ in keys]
                if not any(k in h for k, h in zip(own, held)):
                    for k, h in zip(own, held):
                        h.add(k)
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int64()))

    return rows.repartition(group).sortWithinPartitions(group, order).mapInArrow(run, rows.schema)


def _numbered(rows: DataFrame, group: str, order: str, at_most: int | None) -> DataFrame:
    """Adds kept_pos, the place of a row in its group: counted within ranges of rows, and on from the ranges before."""
    ranged = stored(rows.repartitionByRange(group, order).withColumn("_part", F.spark_partition_id()))
    own = F.row_number().over(Window.partitionBy(group, "_part").orderBy(order))
    sizes = ranged.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = sizes.select(F.col(group).alias("_in"), F.col("_part").alias("_at"), before.alias("_before"))
    placed = ranged.withColumn("kept_pos", own).join(before, F.col(group).eqNullSafe(F.col("_in")) & (F.col("_part") == F.col("_at")))
    placed = placed.withColumn("kept_pos", (F.col("kept_pos") + F.col("_before")).cast("int")).drop("_part", "_in", "_at", "_before")
    return placed if at_most is None else placed.where(F.col("kept_pos") <= at_most)


def greedy_dedupe(rows: DataFrame, group: str, pos: str, keys: Sequence[str], at_most: int | None = None) -> DataFrame:
    """Keeps a row if none of its keys was held by a row *kept* before it in the group; kept_pos counts from 1, to ``at_most``.

    A sequential rule, not two windows: a row that is dropped blocks nothing. Order is that of pos, then of keys; null
    keys, and null groups, equal each other. Of rows with all keys alike only the first can count. The others are settled
    in rounds: a row that comes first at each of its keys is kept, and all that share one of them go. What is left after
    rounds, or where they settle too little (rows that depend on each other in one long chain), is taken in order, group by
    group, as a stream.
    """
    own = [f"_k{i}" for i in range(len(keys))]
    order = F.struct(F.col(pos).alias("p"), *[F.col(k).alias(f"k{i}") for i, k in enumerate(keys)])
    given = rows.select(F.struct(*rows.columns).alias("_row"), F.struct(F.col(group).alias("g")).alias("_g"), order.alias("_order"), *[F.struct(F.col(group).alias("g"), F.col(k).alias("k")).alias(o) for k, o in zip(keys, own)])
    left = stored(given.groupBy("_g", *own).agg(F.min_by("_row", "_order").alias("_row"), F.min("_order").alias("_order")))
    kept, n = [], left.count()
    while n > REST:
        marked = left
        for k in own:
            first = left.groupBy(F.col(k).alias("_at")).agg(F.min("_order").alias("_first"))
            marked = marked.join(first, F.col(k) == F.col("_at")).withColumn(f"_is{k}", F.col("_order") == F.col("_first")).drop("_at", "_first")
        first = stored(marked.where(F.forall(F.array(*[f"_is{k}" for k in own]), lambda x: x)).select(*left.columns))
        for k in own:
            left = left.join(first.select(F.col(k).alias("_at")), F.col(k) == F.col("_at"), "left_anti")
        kept.append(first)
        left = stored(left)
        before, n = n, left.count()
        if (before - n) * PROGRESS < before:
            break
    out = _folded(left, "_g", "_order", own)
    for part in kept:
        out = out.unionByName(part)
    numbered = _numbered(out.select("_row", "_g", "_order"), "_g", "_order", at_most)
    return numbered.select(*[F.col("_row")[c].alias(c) for c in rows.columns], "kept_pos")


def first_match(rows: DataFrame, options: DataFrame, on: Sequence[str], matches: Column, row_key: Sequence[str], order: Sequence[Column], keep: Sequence[str]) -> DataFrame:
    """Rows with the columns ``keep`` of their first matching option, or nulls: equi join, residual, first by ``order``.

    min_by aggregates on both sides of the shuffle, so that a row with many options needs no sort.
    """
    hits = rows.join(options, list(on)).where(matches)
    best = hits.groupBy(*row_key).agg(F.min_by(F.struct(*keep), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)])).alias("_best"))
    return rows.join(best, list(row_key), "left").select(*rows.columns, *[F.col(f"_best.{k}").alias(k) for k in keep])


def enriched(products: DataFrame, listings: DataFrame, on: Sequence[str], products_most: int = 5, listings_most: int = 10) -> DataFrame:
    """``products`` (on, pos, name, url) with the picture ``image`` (url, source_url, title, product_id) of a listing; null for none.

    listings: (on, pos, rank, title, image_url, link, product_id) of the search for each product. Of the first products
    and their first listings those count that are the product's model and may be shown; one of the product's own page
    comes first, then the best rank. A product id that is no number is left out.
    """
    number = F.when(F.col("product_id").rlike(r"^\d{1,40}$"), F.col("product_id"))
    given = listings.where(F.col("rank") <= listings_most).select(*on, "pos", "rank", "title", "image_url", "link", number.alias("product_id"))
    asked = products.where(F.col("pos") <= products_most).select(*on, "pos", "name", "url")
    fit = asked.join(given, [*on, "pos"]).where(images.product_image(F.col("image_url"), F.col("link"), F.col("title"), F.col("product_id"))).withColumn("fits", titles.matches_model(F.col("name"), F.col("title"))).where("fits")
    order = F.struct((links.page_key(F.col("url")) != links.page_key(F.col("link"))).alias("other"), F.col("rank").alias("rank"))
    picture = F.struct(F.col("image_url").alias("url"), F.col("link").alias("source_url"), F.col("title"), F.col("product_id"))
    return products.join(fit.groupBy(*on, "pos").agg(F.min_by(picture, order).alias("image")), [*on, "pos"], "left")


def latest(rows: DataFrame, keys: Sequence[str], seq: str) -> DataFrame:
    """The last row of each key, as a map that is written in order keeps it."""
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), seq).alias("_r")).select(*[F.col(c if c in keys else f"_r.{c}") for c in rows.columns])
