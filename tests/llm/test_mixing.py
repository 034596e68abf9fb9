import hashlib
import math
import random
from collections import defaultdict

import pytest

from briefloom.llm import mixing

SCHEMA = "doc_id long, text string, source string, size string, rank int"


def wanted(sizes, weights, cap):
    """Targets by repeated sharing: what is over the cap goes to the others."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, full, out = sum(sizes.values()), set(), {}
    while True:
        rest = total - sum(cap * sizes[s] for s in full)
        share = sum(weight[s] for s in names if s not in full)
        out = {s: cap * sizes[s] if s in full else rest * weight[s] / share for s in names}
        over = {s for s in names if s not in full and out[s] > cap * sizes[s]}
        if not over:
            return out
        full |= over


def test_targets_and_takes(spark):
    rng = random.Random(4)
    docs = [(i, " ".join(["w"] * rng.randrange(0, 60)), rng.choice(["a"] * 2 + ["b"] * 20 + ["Z", None, "é"] * 3), "x", 1) for i in range(3000)]
    docs += [(9000, None, "a", "x", 1), (9001, "", "empty", "x", 1)]
    rows = mixing.mix_sources(spark.createDataFrame(docs, SCHEMA).drop("size")).collect()
    sizes, taken = defaultdict(int), defaultdict(int)
    for r in rows:
        sizes[r["source"]] += r["size"]
        taken[r["source"]] += r["taken"]
        assert r["taken"] <= 3 * r["size"] and r["size"] == len((docs[r["doc_id"]][1] or "").split()) if r["doc_id"] < 3000 else r["taken"] == 0
    targets = wanted(sizes, (5, 2, 1), 3)
    for r in rows:
        assert r["target"] == pytest.approx(targets[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 60
    again = mixing.mix_sources(spark.createDataFrame(docs[::-1], SCHEMA).drop("size")).collect()
    assert {r["doc_id"]: r["taken"] for r in rows} == {r["doc_id"]: r["taken"] for r in again}


def drawn(docs, sizes, targets, merit, cap=3):
    """Words that a plain Pareto sample takes of each document."""
    out = {}
    for source, goal in targets.items():
        rows = [(key, size, 2 ** (math.floor(16 * math.log2(merit(key, size)) + 0.5) / 16)) for key, s, size in docs if s == source and size]
        low, high = 0.0, 1e9
        for _ in range(200):  # expected copies per merit
            mid = (low + high) / 2
            low, high = (mid, high) if sum(n * min(cap, mid * m) for _, n, m in rows) < goal else (low, mid)
        expected = {key: round(min(cap, high * m), 9) for key, _, m in rows}
        missing, order = goal, []
        for key, n, _ in rows:
            out[key] = n * int(expected[key])
            missing -= out[key]
            if p := expected[key] % 1:
                u = (int(hashlib.md5(str(key).encode()).hexdigest()[:13], 16) + 0.5) / 2**52
                order.append(((u / (1 - u)) / (p / (1 - p)), key, n))
        for _, key, n in sorted(order):
            if n / 2 > missing:
                break
            missing -= n
            out[key] += n
    return out


@pytest.mark.parametrize("given", [False, True])
def test_draws_a_pareto_sample(spark, given):
    from pyspark.sql import functions as F

    rng = random.Random(8)
    docs = [(i, rng.choice(["a"] * 20 + ["b"] * 5 + ["c"] * 2), rng.choice([0, 1, 3, 9, 40, 400, 3000])) for i in range(1500)]
    frame = spark.createDataFrame([(i, "w " * n, s, "x", 1) for i, s, n in docs], SCHEMA).drop("size")
    options = {"merit": F.lit(1.0) + F.col("doc_id") % 7} if given else {}
    rows = mixing.mix_sources(frame, **options).collect()
    sizes = {s: sum(n for _, x, n in docs if x == s) for s in "abc"}
    merit = (lambda key, n: 1 + key % 7) if given else (lambda key, n: 1 + math.log2(1 + n))
    want = drawn(docs, sizes, wanted(sizes, (5, 2, 1), 3), merit)
    assert {r["doc_id"]: r["taken"] for r in rows if r["size"]} == want
    assert {r["copies"] for r in rows if r["size"]} >= {0, 1, 3}


def test_equal_odds_that_are_whole(spark):
    from pyspark.sql import functions as F

    docs = spark.createDataFrame([(i, "w w", None, "x", 1) for i in range(50)], SCHEMA).drop("size")
    assert {r["taken"] for r in mixing.mix_sources(docs, merit=F.lit(1.0)).collect()} == {2}


def test_merit_raises_inclusion(spark):
    from pyspark.sql import functions as F

    docs = [(i, "w w", "a" if i % 4 else "b", "x", 1) for i in range(4000)]
    rows = mixing.mix_sources(spark.createDataFrame(docs, SCHEMA).drop("size"), weights=(1, 3), merit=F.when(F.col("doc_id") % 2 == 0, 3.0).otherwise(1.0)).where("source = 'a'").collect()
    share = lambda odd: sum(r["taken"] for r in rows if r["doc_id"] % 2 == odd) / sum(r["size"] for r in rows if r["doc_id"] % 2 == odd)
    assert share(0) > 1.3 * share(1)


def test_copies_and_empty_table(spark):
    docs = spark.createDataFrame([(1, "w " * 90, "a", "x", 1), (2, "w " * 10, "b", "x", 1)], SCHEMA)
    out = mixing.mixed(docs, weights=(1, 9))
    assert out.columns == docs.columns and sorted(r["doc_id"] for r in out.collect()).count(2) == 3
    assert mixing.mix_sources(docs.where("doc_id > 5").drop("size")).count() == 0
