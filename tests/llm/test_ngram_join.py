import random
import re

import pytest

from briefloom.llm import ngram_join

SCHEMA = "doc_id long, text string, id string, node int, grp int"


def brute(docs, n, percent):
    sets = []
    for _, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set())
    root = list(range(len(docs)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            same_key = docs[i][0] is not None and docs[i][0] == docs[j][0]
            linked = sets[i] and docs[i][0] is not None and docs[j][0] is not None and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j])
            if same_key or linked:
                root[top(i)] = top(j)
    least = {}
    for i, (key, _) in enumerate(docs):
        if key is not None:
            least[top(i)] = min(key, least.get(top(i), key))
    return sorted(((k, len(s), least.get(top(i))) for i, ((k, _), s) in enumerate(zip(docs, sets))), key=repr)


def corpus(seed):
    rng, out = random.Random(seed), []
    vocabulary = [f"v{i}" for i in range(200)] + ["Größe", "X"]
    for _ in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 8, 30, 120, 400]))]
        for _ in range(rng.choice([1, 2, 12, 30])):
            w = list(base)
            for _ in range(rng.choice([0, 0, 1, 1, 2, 5])):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            out.append(rng.choice([" ", "\n", " \t"]).join(w[rng.choice([0, 0, 0, 1]) :]))
    out += [None, "", " \n ", "one", "ONE", "one  "]
    return list(zip(rng.sample(range(1000), len(out)), out))


@pytest.mark.parametrize(("n", "percent", "block"), [(3, 90, 4), (5, 80, 192), (3, 60, 7)])
def test_against_brute_force(spark, monkeypatch, n, percent, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    docs = [*corpus(n * percent), (None, "no key"), (None, "no key"), (7, "a key twice with these words"), (7, "and again with others here")]
    frame = spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA)
    got = ngram_join.jaccard_groups(frame, n=n, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, n, percent)


def test_empty_table_and_first_of_each_group(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert ngram_join.jaccard_groups(empty).count() == 0
    docs = spark.createDataFrame([(3, "a b c d e f g", "x", 1, 2), (2, "A b c d e f g", "y", 1, 2), (9, None, "z", 1, 2), (8, None, "z", 1, 2)], SCHEMA)
    assert sorted(r["doc_id"] for r in ngram_join.keep_first(docs).collect()) == [2, 8, 9]


def test_tree_finds_all_similar_sets():
    rng = random.Random(5)
    sets = [sorted(rng.sample(range(30), rng.randrange(1, 12))) for _ in range(120)]
    want = {(i, j) for i in range(120) for j in range(i + 1, 120) if 100 * len(set(sets[i]) & set(sets[j])) >= 60 * len(set(sets[i]) | set(sets[j]))}
    assert set(ngram_join.similar(sets, None, 60)) == want


def _same(spark, docs, n, percent):
    got = ngram_join.jaccard_groups(spark.createDataFrame([(*d, "x", 1, 2) for d in docs], SCHEMA), n=n, percent=percent)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == brute(docs, n, percent)


@pytest.mark.parametrize(("n", "percent", "many", "cut"), [(3, 90, 12, 1), (3, 90, 102, 10), (5, 80, 14, 2)])
def test_links_at_exactly_the_threshold(spark, n, percent, many, cut):
    w = [f"w{i}" for i in range(many)]
    docs = [(1, " ".join(w[:-cut])), (2, " ".join(w)), (3, " ".join(w[cut:])), (9, "other words that stand alone here")]
    assert [r[2] for r in brute(docs, n, percent)] == [1, 1, 1, 9]
    _same(spark, docs, n, percent)


def test_key_of_several_sets_of_which_one_is_a_copy(spark):
    a, b = ([f"{x}{i}" for i in range(60)] for x in "ab")
    near = [*b[:-1], "z"]
    _same(spark, [(3, " ".join(a)), (7, " ".join(a)), (7, " ".join(b)), (20, " ".join(near)), (21, " ".join([*near[:-2], "y", "z"]))], 3, 90)
    _same(spark, [(3, None), (3, " ".join(a)), (3, " ".join(b)), (20, " ".join(near)), (21, " ".join([*a[:-1], "z"]))], 3, 90)
