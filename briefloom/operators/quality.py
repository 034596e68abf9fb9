"""Ranking quality: ratios, percentiles, NDCG, loss stages, breakdowns, inversions, comparisons."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.window import Window

from .stored import stored

#: Rows of a group that one task counts.
CHUNK = 200_000
#: Tasks that a smaller table's groups are dealt to.
SLOTS = 32


def ratio(num: Column, den: Column) -> Column:
    """Four decimals, from exact decimals; null for nothing."""
    return F.when(den != 0, F.round(num.cast("decimal(20,0)") / den, 4).cast("double"))


def nearest_ranks(rows: DataFrame, by: Sequence[str], value: str, ranks: Mapping[str, float]) -> DataFrame:
    """(by, and a column per rank): exact nearest-rank percentiles of each group; nulls don't count, groups of nothing have no row.

    Values are counted, and counts put in buckets of near values; only the bucket that holds a rank is put in order, so
    that no group is sorted or held as a whole. NaN is the greatest value.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    v = F.col("_v")
    bucket = F.when(F.isnan(v), F.lit(1 << 20)).otherwise(F.floor(F.signum(v) * F.least(F.log2(1 + F.abs(v)), F.lit(1024.0)) * 64))
    given = rows.where(F.col(value).isNotNull()).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(value).cast("double").alias("_v"))
    counted = given.groupBy(*keys, "_v").agg(F.count("*").alias("n")).withColumn("bucket", bucket.cast("long"))
    sizes = counted.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))
    along, every = Window.partitionBy(*keys).orderBy("bucket"), Window.partitionBy(*keys)
    sizes = sizes.withColumn("upto", F.sum("n").over(along)).withColumn("total", F.sum("n").over(every))
    wanted = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("total") * F.lit(p))).alias("rank")) for name, p in ranks.items()]))
    held = sizes.withColumn("w", wanted).where("upto - n < w.rank and w.rank <= upto").select(*[F.col(k).alias(f"{k}_") for k in keys], F.col("bucket").alias("b"), "w.name", (F.col("w.rank") - (F.col("upto") - F.col("n"))).alias("rank"))
    same = F.col("bucket") == F.col("b")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"{k}_"))
    inside = counted.join(held, same)
    inside = inside.withColumn("upto", F.sum("n").over(Window.partitionBy(*keys, "bucket", "name").orderBy("_v"))).where("upto >= rank")
    found = inside.groupBy(*keys).agg(*[F.min(F.when(F.col("name") == name, F.col("_v"))).alias(name) for name in ranks])
    return found.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], *ranks)


def gain(grade: Column) -> Column:
    """0 to 3, in whole steps; 0 for nothing."""
    return F.greatest(F.lit(0), F.least(F.lit(3), F.floor(F.coalesce(grade, F.lit(0))))).cast("double")


def ndcg(rows: DataFrame, by: Sequence[str], pos: str, grade: str, ideal: DataFrame, ideal_grade: str, k: int = 3) -> DataFrame:
    """NDCG@k per group: gains of the first k positions over the k best grades of ``ideal``; null if those are 0."""
    discount = lambda at: F.log2(at + 1)
    got = rows.where(F.col(pos) <= k).groupBy(*by).agg(F.sum(gain(F.col(grade)) / discount(F.col(pos))).alias("dcg"))
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col(ideal_grade).desc()))
    best = ideal.select(*by, ideal_grade).withColumn("_r", rank).where(F.col("_r") <= k).groupBy(*by).agg(F.sum(gain(F.col(ideal_grade)) / discount(F.col("_r"))).alias("best"))
    return best.join(got, list(by), "left").select(*by, F.when(F.col("best") > 0, F.round(F.coalesce("dcg", F.lit(0.0)) / F.col("best"), 4)).alias("ndcg"))


def loss_stage(seen: Sequence[tuple[Column, str]], returned: str = "returned") -> Column:
    """The first stage at which a reference isn't seen."""
    return F.coalesce(*[F.when(~F.coalesce(s, F.lit(False)), F.lit(loss)) for s, loss in seen], F.lit(returned))


def stages_seen(events: DataFrame, by: Sequence[str], stage: str, stages: Sequence[str]) -> DataFrame:
    """One boolean per stage, in one aggregation."""
    return events.groupBy(*by).agg(*[F.bool_or(F.col(stage) == s).alias(f"seen_{i}") for i, s in enumerate(stages)])


def breakdown(rows: DataFrame, sets: Sequence[Sequence[str]], measures: Sequence[Column]) -> DataFrame:
    """Several groupings of one scan: grouping sets, with ``level`` naming the set's columns."""
    every = list(dict.fromkeys(c for s in sets for c in s))
    label = F.concat_ws("+", *[F.when(F.grouping(c) == 0, F.lit(c)) for c in every])
    return rows.groupingSets([[F.col(c) for c in s] for s in sets], *[F.col(c) for c in every]).agg(label.alias("level"), *measures)


def _dominance(group: np.ndarray, x: np.ndarray, y: np.ndarray, value: np.ndarray, missing: np.ndarray, weight: np.ndarray, groups: int) -> tuple[np.ndarray, np.ndarray]:
    """(inverted, pairs) per group: see ``inversions``. Points of one group with different x are pairs, counted by their weights.

    Two different x part at one bit of their ranks within the group, and only there: at each bit, points with a 0 and points
    with a 1 of one block meet once, in the order of y. No pair is made.
    """
    order = np.lexsort((x, group))
    new = np.r_[True, group[order][1:] != group[order][:-1]]
    step = np.r_[False, x[order][1:] != x[order][:-1]] & ~new
    rank = np.empty(len(x), np.int64)
    rank[order] = np.cumsum(step) - np.maximum.accumulate(np.where(new, np.cumsum(step), 0))
    kinds, kind = np.unique(np.stack([value, missing]), axis=1, return_inverse=True)
    kind, height = kind.ravel(), np.unique(y, return_inverse=True)[1].ravel()
    inverted, pairs = np.zeros(groups, np.int64), np.zeros(groups, np.int64)
    for bit in range(int(rank.max(initial=0)).bit_length()):
        block = rank >> (bit + 1)
        order = np.lexsort((height, block, group))
        g, later, own, w = group[order], (rank[order] >> bit & 1).astype(bool), kind[order], weight[order]
        starts = np.r_[True, (g[1:] != g[:-1]) | (block[order][1:] != block[order][:-1])]
        levels = starts | np.r_[True, height[order][1:] != height[order][:-1]]
        at = np.arange(len(order))
        first, same = (np.maximum.accumulate(np.where(m, at, 0)) for m in (starts, levels))
        last, beyond = (np.r_[np.flatnonzero(m)[1:], len(at)][np.cumsum(m) - 1] for m in (starts, levels))
        for one in range(kinds.shape[1]):
            upto = np.r_[0, np.cumsum(np.where(~later & (own == one), w, 0))]
            for two in range(kinds.shape[1]):
                right = np.flatnonzero(later & (own == two))
                rising = w[right] * (upto[same[right]] - upto[first[right]])
                if kinds[0, one] < kinds[0, two]:
                    np.add.at(inverted, g[right], rising)
                if one != two:
                    dearer = w[right] * (upto[last[right]] - upto[beyond[right]]) if kinds[0, one] > kinds[0, two] else rising
                    np.add.at(pairs, g[right], dearer)
    return inverted, pairs


def _counted(own: Sequence[str], schema: pa.Schema):
    """Of some groups, each named by ``own``, from their points: their counts, and whether a group has several x."""

    def run(table: pa.Table) -> pa.Table:
        rows = pa.array(np.arange(table.num_rows))
        named = table.select(own).append_column("_row", rows).group_by(own).aggregate([("_row", "list")])
        lists = named.column("_row_list").combine_chunks()
        group = np.empty(table.num_rows, np.int64)
        group[np.asarray(lists.flatten())] = np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
        x, y, weight = (np.asarray(table.column(c)) for c in ("x", "y", "weight"))
        grade = table.column("grade")
        inverted, pairs = _dominance(group, x, y, np.asarray(grade.fill_null(0)), np.asarray(grade.is_null()), weight, len(lists))
        low, high = np.full(len(lists), np.inf), np.full(len(lists), -np.inf)
        np.minimum.at(low, group, x)
        np.maximum.at(high, group, x)
        keys = [named.column(f.name) for f in schema if f.name in own]
        return pa.table([*keys, pa.array(inverted), pa.array(pairs), pa.array(low < high)], schema=schema)

    return run


def inversions(rows: DataFrame, by: Sequence[str], pos: str, price: str, grade: str) -> DataFrame:
    """Per group: pairs in which an earlier product is cheaper and weaker than a later one, and all pairs in which the stronger costs more.

    Missing grades are 0 for the former; for the latter they differ from 0. Rows without a price or a place, and null keys,
    don't count; groups without two places have no row. No pair is made: dominance is counted along sorted lists. A
    group of more than CHUNK rows is cut twice, by place and by price: pairs within a piece of either are counted there,
    all others between pieces.
    """
    keys = [f"_k{i}" for i in range(len(by))]
    held = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in (*by, pos, price)])
    given = rows.where(held).select(*[F.col(c).alias(k) for c, k in zip(by, keys)], F.col(pos).cast("double").alias("x"), F.col(price).cast("double").alias("y"), F.col(grade).cast("double").alias("grade"))
    sizes = given.groupBy(*keys).agg(F.count("*").alias("n"))
    largest, total = (v or 0 for v in sizes.agg(F.max("n"), F.sum("n")).first())
    pieces = -(-largest // CHUNK)
    none = F.lit(0)
    if pieces > 1:
        at = F.lit([i / pieces for i in range(1, pieces)])
        cuts = given.groupBy(*keys).agg(F.count("*").alias("n"), F.percentile_approx("x", at, 100_000).alias("xs"), F.percentile_approx("y", at, 100_000).alias("ys"))
        cuts = stored(cuts.where(F.col("n") > CHUNK).drop("n"))
        piece = lambda v, cs: F.coalesce(F.size(F.filter(cs, lambda c: c < v)), none)
        given = stored(given.join(cuts, keys, "left").withColumns({"px": piece(F.col("x"), F.col("xs")), "py": piece(F.col("y"), F.col("ys")), "cut": F.col("xs").isNotNull()}).drop("xs", "ys"))
    else:
        given = given.withColumns({"px": none, "py": none, "cut": F.lit(False)})

    def part(name: str, piece: Column, x: Column, y: Column) -> DataFrame:
        own = given if name == "place" else given.where("cut")
        return own.groupBy(*keys, F.lit(name).alias("part"), piece.alias("piece"), x.cast("double").alias("x"), y.cast("double").alias("y"), "grade").agg(F.count("*").alias("weight"))

    points = part("place", F.col("px"), F.col("x"), F.col("y"))
    if pieces > 1:
        points = points.unionByName(part("price", F.col("py"), F.col("px"), F.col("y"))).unionByName(part("both", none, F.col("px"), F.col("py")))
    # many groups, or pieces, make a task
    own = [*keys, "part", "piece"]
    slots = max(SLOTS, total // CHUNK * 2)
    kept = points.select(*keys).schema
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept) + ", inverted long, pairs long, several boolean"
    schema = to_arrow_schema(kept)
    for name, kind in (("inverted", pa.int64()), ("pairs", pa.int64()), ("several", pa.bool_())):
        schema = schema.append(pa.field(name, kind))
    found = points.withColumn("_slot", F.pmod(F.xxhash64(*own), F.lit(slots))).groupBy("_slot").applyInArrow(_counted(own, schema), types)
    out = found.groupBy(*keys).agg(F.sum("inverted").alias("inverted"), F.sum("pairs").alias("pairs"), F.bool_or("several").alias("several")).where("several")
    return out.select(*[F.col(k).alias(c) for k, c in zip(keys, by)], "inverted", "pairs")


def long_form(report: DataFrame, metrics: Sequence[str], name: str) -> DataFrame:
    """(metric, name) rows of a one-row report."""
    return report.select(F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias(name)) for m in metrics])).alias("m")).select("m.*")


def compared(before: DataFrame, after: DataFrame, metrics: Sequence[str]) -> DataFrame:
    """(metric, before, after, delta); delta has four decimals and is null if either is."""
    joined = long_form(before, metrics, "before").join(long_form(after, metrics, "after"), "metric")
    return joined.withColumn("delta", F.round(F.col("after") - F.col("before"), 4))


def measure(report: Column, path: str) -> Column:
    """A metric of a JSON report by its dotted path: a number, or the rate of a ratio; else null."""
    at = f"$.{path}"
    return F.coalesce(F.get_json_object(report, at).try_cast("double"), F.get_json_object(report, f"{at}.rate").try_cast("double"))


def same_cases(before: DataFrame, after: DataFrame) -> DataFrame:
    """``before`` (pos, case_id), checked to hold the same cases as ``after`` at the same positions; fails where they differ."""
    both = before.alias("a").join(after.select(F.col("pos").alias("_pos"), F.col("case_id").alias("_case")), F.col("pos") == F.col("_pos"), "full_outer")
    same = F.col("case_id").eqNullSafe(F.col("_case")) & F.col("pos").eqNullSafe(F.col("_pos"))
    return both.where(F.when(same, True).otherwise(F.raise_error(F.lit("case ids or their order differ")).cast("boolean"))).select("pos", "case_id")


def bayesian_rating(rating: Column, count: Column, prior: float = 4.0, strength: float = 50.0) -> Column:
    """A rating shrunk toward the prior by its number of votes."""
    return (rating * count + prior * strength) / (count + strength)


# What a failed metric takes from 100, by its impact; a ranking of score 3 takes less; the least score of each grade.
DEDUCTIONS = {"high": 15, "medium": 8}
RANKING, RANKING_SCORE, RANKING_DEDUCTION = "ranking", 3, 4
GRADES = {"A": 90, "B": 75, "C": 60}


def search_grades(results: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, score, unsafe, complete, grade) of searches, from a row per result of a metric.

    results: ``by`` and metric, axis (safety, quality), impact (high, medium), state (pass, fail, not_scored,
    not_applicable), score (of the ranking metric). A metric that fails takes its points once a search, the most of its
    results; a safety failure makes the grade F and leaves the score; a metric of high impact without a score allows no
    grade above B. What isn't applicable, and what is null or another word, takes nothing. Metrics are folded before searches.
    """
    failed = (F.col("axis") == "quality") & (F.col("state") == "fail")
    third = (F.col("metric") == RANKING) & (F.col("score") == RANKING_SCORE)
    medium = F.when(third, RANKING_DEDUCTION).otherwise(DEDUCTIONS["medium"])
    points = F.when(failed & (F.col("impact") == "high"), DEDUCTIONS["high"]).when(failed & (F.col("impact") == "medium"), medium).otherwise(0)
    unsafe = (F.col("axis") == "safety") & (F.col("state") == "fail")
    unscored = F.col("state") == "not_scored"
    high = unscored & (F.col("axis") == "quality") & (F.col("impact") == "high")
    some = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    each = results.groupBy(*by, "metric").agg(F.max(points).alias("points"), some(unsafe).alias("unsafe"), some(unscored).alias("unscored"), some(high).alias("high"))
    out = each.groupBy(*by).agg(F.greatest(F.lit(0), 100 - F.sum("points")).cast("int").alias("score"), F.bool_or("unsafe").alias("unsafe"), (~F.bool_or("unscored")).alias("complete"), F.bool_or("high").alias("_high"))
    letter = F.when(F.col("unsafe"), "F").when(F.col("_high") & (F.col("score") >= GRADES["A"]), "B")
    for name, least in GRADES.items():
        letter = letter.when(F.col("score") >= least, name)
    return out.withColumn("grade", letter.otherwise("D")).drop("_high")
