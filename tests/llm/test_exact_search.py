import math

import numpy as np
import pytest

from briefloom.llm import exact_search

SCHEMA = "vec_id long, embedding array<double>, id string, block int"


def brute(queries, rows, k, scale=256):
    """Every score by Python's integers."""
    ok = lambda v: v is not None and None not in v and all(math.isfinite(x) for x in v)
    whole = [(i, [math.floor(scale * x) for x in v]) for i, v in rows if i is not None and ok(v)]
    asked = {}
    for i, v in queries:
        if i is not None and ok(v):
            asked.setdefault(i, [math.floor(scale * x) for x in v])
    out = []
    for q, v in asked.items():
        scores = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in whole if i != q and len(w) == len(v))
        out += [(q, rank + 1, i, -s) for rank, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def _found(spark, queries, rows, **more):
    return sorted(tuple(r) for r in exact_search.top_k(_frame(spark, queries), _frame(spark, rows), **more).collect())


@pytest.mark.parametrize("sizes", [None, (1 << 15, 1 << 12, 64, 16)])
def test_against_brute_force(spark, monkeypatch, sizes):
    if sizes:
        for name, size in zip(("CANDIDATE_BYTES", "QUERY_BYTES", "AT_ONCE", "QUERIES_AT_ONCE"), sizes):
            monkeypatch.setattr(exact_search, name, size)
    rng = np.random.default_rng(1)
    bases = rng.normal(size=(20, 40))
    vectors = [(bases[i % 20] + 0.3 * rng.normal(size=40)).tolist() for i in range(600)]
    vectors += [vectors[0]] * 90 + [[0.0] * 40] * 5 + [None, [], [], [float("nan")] * 40, [None] * 40, [1.0, float("inf")], [1.0, 2.0], [-2.0, 4.0], [0.001] * 40]
    rows = list(zip(rng.permutation(len(vectors)).tolist(), vectors))
    queries = [r for r in rows if r[0] % 5 == 0]
    assert _found(spark, queries, rows) == brute(queries, rows, 5)
    assert _found(spark, queries, rows, k=1, scale=3.0) == brute(queries, rows, 1, 3)


def test_pruning_keeps_what_counts():
    rng = np.random.default_rng(2)
    candidates = np.floor(rng.normal(size=(7000, 64)) * np.linspace(90, 2, 64))
    queries = candidates[rng.choice(7000, 300, replace=False)] + rng.integers(-3, 4, (300, 64))
    ids = np.sort(rng.choice(10**6, 7000, replace=False))
    best = exact_search.search(queries, np.arange(300) - 1000, candidates, ids, 5)
    scores = queries @ candidates.T
    for q in range(300):
        want = np.lexsort((ids, -scores[q]))[:5]
        assert best.place[q].tolist() == want.tolist() and best.score[q].tolist() == scores[q][want].tolist()


def test_ties_go_to_smaller_keys_and_own_key_is_out(spark):
    rows = [(i, [1.0, 1.0]) for i in range(40, 0, -1)] + [(0, [1.0, 1.0])]
    assert _found(spark, rows[-1:], rows) == [(0, i, i, 131072) for i in range(1, 6)]
    assert _found(spark, rows[:1], rows[-3:]) == [(40, 1, 0, 131072), (40, 2, 1, 131072), (40, 3, 2, 131072)]


def test_repeated_and_null_keys(spark):
    rows = [(None, [1.0]), (7, [1.0]), (7, [2.0]), (8, [3.0]), (8, [3.0]), (9, None)]
    assert _found(spark, [(7, [1.0]), (7, [1.0]), (None, [1.0])], rows) == [(7, 1, 8, 256 * 768), (7, 2, 8, 256 * 768)]
    assert _found(spark, rows[-1:], rows) == []
    assert _found(spark, [], rows) == _found(spark, rows, []) == []


def test_large_numbers_are_exact(spark):
    rows = [(i, [2.0**40 + i, -(2.0**41)]) for i in range(6)] + [(99, [1e300, 1.0]), (98, [1e308, 1e308])]
    got = _found(spark, rows[:1], rows)
    clipped = [(q, r, i, max(-(2**63), min(2**63 - 1, s))) for q, r, i, s in brute(rows[:1], rows[:7], 6)]
    assert [x[2:] for x in got] == sorted(((i, s) for _, _, i, s in clipped), key=lambda x: (-x[1], x[0]))[:5]
