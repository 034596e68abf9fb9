import numpy as np
import pytest

from briefloom.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<double>, id string, code int"


def brute(rows, cosine=0.95):
    ok = [i for i, (_, v) in enumerate(rows) if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links = {i: set() for i in range(len(rows))}
    for i in ok:
        for j in ok:
            a, b = np.array(rows[i][1]), np.array(rows[j][1])
            if i != j and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= cosine:
                links[i].add(j)
    out = []
    for i, (key, _) in enumerate(rows):
        seen, todo = {i}, [i]
        while todo:
            for j in links[todo.pop()] - seen:
                seen.add(j)
                todo.append(j)
        least = min(rows[j][0] for j in seen)
        out.append((key, len(links[i]), least, key == least))
    return sorted(out)


@pytest.mark.parametrize("block", [512, 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embedding_dedup, "BLOCK", block)
    rng = np.random.default_rng(1)
    vectors = []
    for _ in range(25):
        base = rng.normal(size=64)
        vectors += [(base * rng.uniform(0.5, 3) + rng.normal(size=64) * 0.12 * k).tolist() for k in range(6)]
    vectors += [vectors[0]] * 40 + [None, [], [0.0] * 64, [float("nan")] * 64, [None, 1.0], [1.0, 2.0], [2.0, 4.0], [float("inf")] + [0.0] * 63]
    rows = list(zip(rng.permutation(len(vectors)).tolist(), vectors))
    got = embedding_dedup.near_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA))
    assert sorted(tuple(r) for r in got.collect()) == brute(rows)


def test_recall_of_buckets():
    rng = np.random.default_rng(2)
    a = rng.normal(size=(3000, 64))
    a /= np.linalg.norm(a, axis=1, keepdims=True)
    noise = rng.normal(size=a.shape)
    noise -= (noise * a).sum(1, keepdims=True) * a
    noise /= np.linalg.norm(noise, axis=1, keepdims=True)
    b = 0.951 * a + np.sqrt(1 - 0.951**2) * noise
    x, y = embedding_dedup.buckets(a), embedding_dedup.buckets(b)
    met = (x[:, :, :, None] == y[:, :, None, :]).any(axis=(1, 2, 3))
    assert met.mean() > 0.998


def test_empty_table_and_null_keys(spark):
    assert embedding_dedup.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    got = embedding_dedup.near_vectors(spark.createDataFrame([(None, [1.0, 2.0], "x", 1), (None, [1.0, 2.0], "x", 1), (4, [1.0, 2.0], "x", 1)], SCHEMA)).collect()
    assert sorted((repr(r["vec_id"]), r["n_links"]) for r in got) == [("4", 0), ("None", 0), ("None", 0)]


def test_floats_and_odd_arrays(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(30, 24)).astype(np.float32)
    vectors = [(base[i % 30] + rng.normal(size=24).astype(np.float32) * np.float32(0.08 * (i % 4))).tolist() for i in range(150)]
    vectors += [None, [], [0.0] * 24, [-0.0] * 24, [float("nan")] * 24, [None] * 24, [1e-30] * 24, [1e30] * 24, [3.0], [4.0], [-3.0]]
    rows = list(enumerate(vectors))
    got = embedding_dedup.near_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA.replace("double", "float")))
    assert sorted(tuple(r) for r in got.collect()) == brute([(k, v if v is None else [None if x is None else float(np.float32(x)) for x in v]) for k, v in rows])


def test_threshold_is_that_of_the_plain_formula(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(40):
        a = rng.normal(size=16)
        b = rng.normal(size=16)
        b -= (a @ b) / (a @ a) * a
        rows += [(2 * i, a.tolist()), (2 * i + 1, (0.95 * a / np.linalg.norm(a) + np.sqrt(1 - 0.95**2) * b / np.linalg.norm(b)).tolist())]
    links = {r["vec_id"]: r["n_links"] for r in embedding_dedup.near_vectors(spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)).collect()}
    for (i, a), (j, b) in zip(rows[::2], rows[1::2]):
        assert links[i] == links[j] == int(embedding_dedup._plain(np.array([a]), np.array([b]))[0] >= 0.95)
