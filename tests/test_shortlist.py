import random

import pytest

from briefloom.operators import shortlist

SCHEMA = "g string, pos long, a string, b long, _k0 int"


def folded(rows, most=None):
    want, held, n = [], {}, {}
    for g, pos, a, b, x in sorted(rows, key=lambda r: (r[1], r[2] is not None, r[2] or "", r[3])):
        known = held.setdefault(g, (set(), set()))
        if a in known[0] or b in known[1] or (most is not None and n.get(g, 0) >= most):
            continue
        known[0].add(a)
        known[1].add(b)
        n[g] = n.get(g, 0) + 1
        want.append((g, pos, a, b, x, n[g]))
    return sorted(map(repr, want))


def _kept(spark, rows, most=None):
    got = shortlist.greedy_dedupe(spark.createDataFrame(rows, SCHEMA), "g", "pos", ["a", "b"], most)
    return sorted(map(repr, map(tuple, got.collect())))


CASES = {
    "random": lambda rng: [(rng.choice(["g", "h", None]), i // 3, rng.choice([None, "x", "y", "z"]), rng.randrange(60), 7) for i in range(500)],
    "sparse": lambda rng: [("g", i, f"a{rng.randrange(700)}", rng.randrange(700), 7) for i in range(1000)],
    "chain": lambda rng: [("g", i, f"a{(i + 1) // 2}", i // 2, 7) for i in range(60)],
    "star": lambda rng: [("g", 0, "hub", 0, 7)] + [("g", i, "hub", i, 7) for i in range(1, 200)] + [("g", 200 + i, f"a{i}", i, 7) for i in range(200)],
    "late hub": lambda rng: [("g", i, f"a{i}", i % 5, 7) for i in range(200)] + [("g", 300, "a3", 900, 7), ("g", 301, "a9", 901, 7)],
    "repeated rows": lambda rng: [("g", 1, "x", 1, 7)] * 50 + [("g", 1, "y", 1, 7), ("g", 1, "y", 2, 7)] * 3,
    "empty": lambda rng: [],
}


@pytest.mark.parametrize("case", CASES)
@pytest.mark.parametrize("rest", [200_000, 0])
def test_greedy_dedupe_against_a_fold(spark, monkeypatch, case, rest):
    """Without a rest only rounds settle rows, but for a chain, which they leave to the stream."""
    monkeypatch.setattr(shortlist, "REST", rest)
    rows = CASES[case](random.Random(3))
    for most in (None, 2):
        assert _kept(spark, rows, most) == folded(rows, most)


def test_one_large_group_in_rounds(spark, monkeypatch):
    monkeypatch.setattr(shortlist, "REST", 1000)
    rng = random.Random(5)
    rows = [("g", i, f"a{rng.randrange(9000)}", rng.randrange(9000), 7) for i in range(30_000)]
    assert _kept(spark, rows) == folded(rows)
