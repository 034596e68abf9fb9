"""Connected components of an edge table, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .storage import places, stash


def _with_min(edges: DataFrame) -> DataFrame:
    """Edges (u, v) with m, the smallest of u and its neighbours. Two plain joins on u: a vertex with very many edges is split by AQE."""
    least = edges.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return edges.join(least.withColumnRenamed("u", "k"), F.col("u") == F.col("k")).drop("k")


def _digest(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v")), F.sum(F.col("v").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame, max_rounds: int = 50) -> DataFrame:
    """(id, component) for each id of ``edges`` (u, v); component is the smallest id reachable.

    Self loops and repeated edges are ignored; an empty table gives an empty result; null ends are dropped.
    Each round is a stashed table, so that neither plan nor lost executors force earlier rounds to run again; it takes the
    place of the one before the last.
    """
    spots = places(edges.sparkSession)
    state = stash(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), spots[1])
    before = _digest(state)
    for i in range(max_rounds):
        both = state.unionAll(state.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = _with_min(both).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        small = _with_min(down)
        small = small.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(small.select("u", F.col("m").alias("v"))).where("u <> v").distinct()
        state = stash(small, spots[i % 2])
        now = _digest(state)
        if now == before or now[0] == 0:
            break
        before = now
    else:
        raise RuntimeError(f"components not settled in {max_rounds} rounds")
    return state.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("component")).unionAll(state.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
