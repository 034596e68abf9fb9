import math
from fractions import Fraction

import numpy as np
import pytest

from briefloom.llm import whitening

SCHEMA = "vec_id long, embedding array<double>, n string, component int"


def brute(rows, components=8):
    """(id, component) -> whitened up to its sign, deviations, explained, by exact integers and LAPACK."""
    kept = [(i, [math.floor(1024 * c) + 100_000 for c in v]) for i, v in rows]
    n, sums = len(kept), [sum(c) for c in zip(*(x for _, x in kept))]
    apart = [[n * a - s for a, s in zip(x, sums)] for _, x in kept]
    centred = np.array([[float(Fraction(a, n)) for a in row] for row in apart])
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1], vectors[:, ::-1]
    white = centred @ vectors[:, :components] / np.sqrt(values[:components])
    return n, {i: sum(a * a for a in row) for (i, _), row in zip(kept, apart)}, {i: w for (i, _), w in zip(kept, white)}, values[:components] / values.sum()


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def _check(got, rows, components=8):
    n, deviations, white, explained = brute(rows, components)
    width = min(components, len(explained))
    assert len(got) == len(rows) * width and {r["component"] for r in got} == set(range(1, width + 1))
    signs = {}
    for r in got:
        k, want = r["component"] - 1, white[r["vec_id"]][r["component"] - 1]
        assert r["n"] == n and int(r["deviation"]) == deviations[r["vec_id"]]
        if abs(want) > 0.1:
            signs.setdefault(k, np.sign(want * r["whitened"]))
        assert abs(r["whitened"] - signs.get(k, 1) * want) < 1e-7 or k not in signs
        assert abs(r["explained"] / explained[k] - 1) < 1e-9 and r["identity_error"] < 1e-9


def _rows(n, dims, seed):
    rng = np.random.default_rng(seed)
    turn = np.linalg.qr(rng.normal(size=(dims, dims)))[0]
    return list(enumerate((rng.normal(size=(n, dims)) * np.geomspace(3, 0.2, dims) @ turn + rng.normal(size=dims) * 50).tolist()))


def test_against_brute_force(spark):
    rows = _rows(700, 24, 1)
    odd = [(900, None), (901, []), (902, [float("nan")] * 24), (903, [None] * 24), (904, [float("-inf")] + [0.0] * 23), (905, [1.0, 2.0]), (906, [1e300] * 24)]
    _check(whitening.whiten(_frame(spark, rows + odd).repartition(5)).collect(), rows)
    _check(whitening.whiten(_frame(spark, rows), components=2).collect(), rows, 2)


def test_parts_are_merged_in_levels(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 3)
    rows = _rows(200, 3, 2)
    _check(whitening.whiten(_frame(spark, rows).repartition(29)).collect(), rows)


def test_welford_and_merging_hold_far_from_zero():
    rng = np.random.default_rng(3)
    x = rng.integers(-5, 6, (4000, 6)) + 10**12
    whole, parts = whitening.Moments(6), [whitening.Moments(6) for _ in range(3)]
    whole.add(x)
    for part, rows in zip(parts, (x[:1], x[1:2500], x[2500:])):
        part.add(rows)
    parts[0].merge(parts[1])
    parts[0].merge(parts[2])
    want = np.cov((x - 10**12).T, bias=True)
    for m in (whole, whitening.Moments.of(parts[0].row(0))):
        assert m.sums == x.sum(axis=0).tolist() and m.n == 4000 and np.abs(m.covariance - want).max() < 1e-4


@pytest.mark.parametrize("n", [1, 2, 3, 17, 80])
def test_symmetric_qr(n):
    rng = np.random.default_rng(n)
    a = rng.normal(size=(n, n))
    for m in (a + a.T, np.ones((n, n)), np.eye(n), np.zeros((n, n)), np.diag(np.geomspace(1, 1e-12, n)), a[:, :1] @ a[:, :1].T):
        values, vectors = whitening.symmetric_qr(m)
        size = max(1e-300, np.abs(m).max()) * n
        assert (np.diff(values) <= 0).all() and np.abs(vectors @ vectors.T - np.eye(n)).max() < 1e-13 * (n + 10)
        assert np.abs(vectors @ m - values[:, None] * vectors).max() < 1e-14 * size * 10
        assert np.abs(np.sort(values) - np.linalg.eigvalsh(m)).max() < 1e-14 * size * 10


def test_without_variance(spark):
    same = whitening.whiten(_frame(spark, [(1, [0.5, 0.25]), (1, [0.5, 0.25]), (None, [0.5, 0.25])])).collect()
    assert len(same) == 6 and {tuple(r)[2:] for r in same} == {(3, 0, None, None, None)}
    flat = sorted(tuple(r) for r in whitening.whiten(_frame(spark, [(i, [float(i), 1.0]) for i in range(4)])).collect())
    assert [r[5] for r in flat[:2]] == [1.0, 0.0] and flat[1][4] is None and flat[0][4] is not None and flat[0][6] < 1e-12


def test_no_rows(spark):
    assert whitening.whiten(_frame(spark, [])).count() == whitening.whiten(_frame(spark, [(1, None), (2, [])])).count() == 0


def test_entries_of_any_size(spark):
    rows = [(i, [float(i) * 1e13, -float(i % 3)]) for i in range(9)]
    got = whitening.whiten(_frame(spark, rows)).collect()
    assert {r["vec_id"]: int(r["deviation"]) for r in got} == brute(rows, 1)[1]
