"""Categories of products: what a search is for, and which selectable features go with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import dictionaries as D
from .text import bound, feature_text, squeezed


def base_category(query: Column) -> Column:
    """A search without sizes, prices, colours, orientation and praise; the search itself where nothing is left."""
    out = F.concat(F.lit(" "), F.lower(query), F.lit(" "))
    for p in D.SEARCH_NOISE:
        out = F.regexp_replace(out, p, " ")
    out = squeezed(out)
    for p in D.SEARCH_PRAISE:
        out = F.regexp_replace(out, p, " ")
    return F.coalesce(bound(squeezed(out), lambda t: F.when(t != "", t)), squeezed(query))


def feature_category(category: Column) -> Column:
    """The category of the longest name or alias that the text holds; else the text in ``feature_text`` form."""
    names = {**{n: n for n in D.CATEGORY_NAMES}, **D.CATEGORY_ALIASES}
    said, out = feature_text(category), None
    # of names of one length at most one may hold where others would differ; they are tried in alphabetical order
    for name in sorted(names, key=lambda n: (-len(n), n)):
        hit = F.contains(said, F.lit(name))
        out = F.when(hit, names[name]) if out is None else out.when(hit, names[name])
    return out.otherwise(said)


def fallback_features(rows: DataFrame, category: str, catalogue: DataFrame) -> DataFrame:
    """``rows`` with ``features``, the catalogue's list for their category in order, as structs; null where it has none.

    catalogue: (category_key, ord, and the features' own columns), a row per feature.
    """
    own = [c for c in catalogue.columns if c not in ("category_key", "ord")]
    lists = catalogue.groupBy("category_key").agg(F.sort_array(F.collect_list(F.struct("ord", *own))).alias("_all"))
    lists = lists.select("category_key", F.transform("_all", lambda x: F.struct(*[x[c].alias(c) for c in own])).alias("features"))
    keyed = rows.withColumn("_key", feature_category(F.col(category)))
    return keyed.join(lists, keyed["_key"] == lists["category_key"], "left").drop("_key", "category_key")
