import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from briefloom.operators import quality

SCHEMA = "g string, pos int, price double, grade double, x int, weight int"


def brute(rows):
    """All pairs of each group, one by one."""
    groups, out = defaultdict(list), {}
    for g, pos, price, grade, *_ in rows:
        if g is not None and price is not None and pos is not None:
            groups[g].append((pos, price, grade))
    for g, own in groups.items():
        pairs = [(a, b) for a in own for b in own if a[0] < b[0]]
        zero = lambda x: x or 0
        inverted = sum(zero(a[2]) < zero(b[2]) and a[1] < b[1] for a, b in pairs)
        dearer = sum(a[2] != b[2] and (a[1] > b[1] if zero(a[2]) > zero(b[2]) else b[1] > a[1]) for a, b in pairs)
        if pairs:
            out[g] = (inverted, dearer)
    return out


def _rows(n, seed, groups=("a", "a", "a", "b", None)):
    rng = random.Random(seed)
    return [(rng.choice(groups), rng.choice([None, *range(1, n)]), rng.choice([None, 1.0, 2.5, 2.5, rng.randrange(1, 50) / 2]), rng.choice([None, 0.0, 1.0, 2.0, 3.0, 1.5]), 1, 1) for _ in range(n)] + [("one", 1, 5.0, 1.0, 1, 1), ("no price", 1, None, 1.0, 1, 1), ("tied", 4, 1.0, 1.0, 1, 1), ("tied", 4, 2.0, 3.0, 1, 1)]


def _found(spark, rows):
    got = quality.inversions(spark.createDataFrame(rows, SCHEMA), ["g"], "pos", "price", "grade").collect()
    return {r["g"]: (r["inverted"], r["pairs"]) for r in got}


@pytest.mark.parametrize("chunk", [200_000, 40])
def test_inversions_against_all_pairs(spark, monkeypatch, chunk):
    monkeypatch.setattr(quality, "CHUNK", chunk)
    rows = _rows(300, 1)
    assert _found(spark, rows) == brute(rows)
    assert _found(spark, []) == {}


def test_a_list_of_many_lines(spark):
    """Half a million lines, whose pairs a self join would have to make."""
    n = 500_000
    frame = spark.range(n).select(F.lit("a").alias("g"), (F.col("id") + 1).cast("int").alias("pos"), (F.col("id") * 7 % n).cast("double").alias("price"), (F.col("id") % 4).cast("double").alias("grade"))
    falling = frame.withColumn("price", -F.col("price").cast("double"))
    one, two = (quality.inversions(f, ["g"], "pos", "price", "grade").first() for f in (frame, falling))
    # of two lines with other grades one is dearer: here the stronger, there the weaker
    differ = n * (n - 1) // 2 - 4 * ((n // 4) * (n // 4 - 1) // 2)
    assert one["pairs"] + two["pairs"] == differ and 0 < one["inverted"] < differ


def test_gain_goes_in_steps(spark):
    rows = spark.createDataFrame([(g,) for g in (None, -1.0, 0.5, 1.0, 2.5, 3.0, 7.0)], "g double")
    assert [r[0] for r in rows.select(quality.gain(F.col("g"))).collect()] == [0, 0, 0, 1, 2, 3, 3]


def test_search_grades(spark):
    rows = [
        ("a", "m1", "quality", "high", "pass", None), ("a", "ranking", "quality", "medium", "fail", 3), ("a", "m2", "quality", "medium", "not_applicable", None),  # 96: A
        ("b", "m1", "quality", "high", "not_scored", None), ("b", "m2", "quality", "medium", "pass", None),  # 100, but B
        ("c", "m1", "quality", "high", "fail", None), ("c", "m1", "quality", "high", "fail", None), ("c", "m2", "quality", "medium", "fail", None),  # 77: once each
        ("d", "m1", "safety", "high", "fail", None), ("d", "m2", "quality", "medium", "not_scored", None),  # 100, but F
        *[("e", f"m{i}", "quality", "high", "fail", None) for i in range(9)],  # not below 0
        ("f", None, "quality", None, None, None), ("g", "ranking", "quality", "medium", "fail", 3), ("g", "ranking", "quality", "medium", "fail", 2),
        ("h", "m1", "quality", "high", "fail", None), ("h", "m2", "quality", "high", "fail", None), ("h", "m3", "quality", "medium", "fail", None), ("h", "m4", "safety", "high", "not_scored", None),
    ]
    got = {r[0]: tuple(r)[1:] for r in quality.search_grades(spark.createDataFrame(rows, "g string, metric string, axis string, impact string, state string, score int"), ["g"]).collect()}
    assert got == {"a": (96, False, True, "A"), "b": (100, False, False, "B"), "c": (77, False, True, "B"), "d": (100, True, False, "F"), "e": (0, False, True, "D"), "f": (100, False, True, "A"), "g": (92, False, True, "A"), "h": (62, False, False, "C")}
