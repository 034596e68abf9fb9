import math
import random

import pytest

from briefloom.llm import quality

DOCS = "doc_id long, text string, lang string, source string, path string, keep int"


def corpus(n=3000):
    rng, docs, labels = random.Random(2), [], []
    for i in range(n):
        words = [f"w{rng.randrange(300)}" for _ in range(rng.choice([2, 20, 200]))]
        toxic, bad = i % 10 == 0, i % 7 == 0
        if toxic:
            words[rng.randrange(len(words))] = rng.choice(["nasty", "vile"])
        if bad:
            words = [w + "%%%" for w in words]
        docs.append((i, " ".join(words), "en", f"s{i % 5}", "p", 1))
        if i % 3:
            labels.append((i, int(not bad), int(toxic)))
    return docs, labels


def test_catches_unlabelled_documents(spark):
    docs, labels = corpus()
    docs += [(9000, None, None, None, "p", 1), (9001, "", "en", "s1", "p", 1), (None, "w1 w2", "en", "s1", "p", 1)]
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = {r["doc_id"]: r for r in quality.judge(frame, marks).collect()}
    assert len(rows) == len(docs)
    shown = [i for i in range(3000) if i % 3 == 0]
    bad = [i for i in shown if i % 7 == 0 or i % 10 == 0]
    good = [i for i in shown if i % 7 and i % 10]
    assert sum(not rows[i]["keep"] for i in bad) > 0.95 * len(bad)
    assert sum(rows[i]["keep"] for i in good) > 0.99 * len(good)
    assert rows[9000]["keep"] and rows[9001]["keep"]
    kept = quality.keep_good(frame, marks)
    assert kept.columns == frame.columns and None in {r["doc_id"] for r in kept.collect()}


def test_no_labels_and_empty_table(spark):
    frame = spark.createDataFrame(corpus(40)[0], DOCS)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.keep_good(frame, none).count() == 40
    assert quality.judge(frame.where("doc_id > 99"), none).count() == 0
    assert quality.judge(frame, spark.createDataFrame([(1, None, None), (None, 0, 1)], none.schema)).where("keep").count() == 40


def plain_shift(rows, host, path, t, left_out=None):
    """A site's log odds less the global ones, by sums in Python."""
    count = lambda keep: (sum(keep(r) for r in rows), sum(r[t] for r in rows if keep(r)))

    def strength(groups):
        chance = sum(p * (1 - p) for _, _, p in groups)
        spread = sum(n * (bad / n - p) ** 2 for n, bad, p in groups)
        more = sum(p * (1 - p) * (n - 1) for n, _, p in groups)
        return max(2.0, min(200.0, more / (spread - chance) - 1 if spread > chance else 200.0))

    n, bad = count(lambda r: True)
    p0 = (bad + 0.5) / (n + 1)
    hosts = {h: count(lambda r: r[0] == h) for h in {r[0] for r in rows}}
    k1 = strength([(*c, p0) for c in hosts.values()])
    p1 = lambda n, bad: (bad + k1 * p0) / (n + k1)
    paths = {(h, p): count(lambda r: r[:2] == (h, p)) for h, p in {r[:2] for r in rows}}
    k2 = strength([(*c, p1(*hosts[h])) for (h, _), c in paths.items()])
    less = lambda c: c if left_out is None else (c[0] - 1, c[1] - left_out)
    own, (n, bad) = p1(*less(hosts.get(host, (0, 0)))), less(paths.get((host, path), (0, 0)))
    p2 = (bad + k2 * own) / (n + k2)
    return math.log(p2 / (1 - p2)) - math.log(p0 / (1 - p0))


def test_posteriors_against_plain_sums(spark):
    rng = random.Random(5)
    rates = {h: rng.random() ** 2 for h in [None, *"abcdefgh"]}
    rows = [(h := rng.choice(list(rates)), rng.choice(["x", "y", None]), int(rng.random() < rates[h]), int(rng.random() < 0.1)) for _ in range(700)]
    rows += [("one", "x", 1, 0)] * 2
    out = quality.site_posteriors(spark.createDataFrame(rows, "host string, path string, bad int, toxic int")).collect()
    assert len(out) == len({r[:2] for r in rows})
    for r in out:
        for t, shift in ((2, r["bad_shift"]), (3, r["toxic_shift"])):
            assert shift == pytest.approx(plain_shift(rows, r["host"], r["path"], t), abs=1e-9)


def test_own_label_is_left_out_and_sites_come_first(spark):
    rng = random.Random(6)
    docs = [(i, "plain words", "en", f"s{i % 4}", "p", 1) for i in range(400)]
    labels = [(i, int(rng.random() < 0.7), int(rng.random() < 0.2)) for i in range(0, 400, 2)]
    sites = [(i, f"h{i % 9}", f"/{i % 2}") for i in range(0, 400, 3)] + [(0, "z", "/"), (None, "h1", "/"), (5, None, "/")]
    frame, marks = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = quality.judge(frame, marks, sites=spark.createDataFrame(sites, "doc_id long, host string, path string")).collect()
    place = {i: (f"h{i % 9}", f"/{i % 2}") if i % 3 == 0 else (f"s{i % 4}", "en") for i in range(400)}
    own = {i: (1 - q, t) for i, q, t in labels}
    known = [(*place[i], *own[i]) for i in own]
    for r in rows:
        i = r["doc_id"]
        for at, t in enumerate(("bad", "toxic")):
            assert r[f"{t}_shift"] == pytest.approx(plain_shift(known, *place[i], 2 + at, own[i][at] if i in own else None), abs=1e-9)


def test_long_repeated_and_tied_rows(spark):
    docs, labels = corpus(600)
    long = (700, "w1 w2 w3 " * 60_000, "en", "s1", "p", 1)
    frame = spark.createDataFrame(docs + [docs[7], docs[7], long, long], DOCS)
    rows = [r for r in quality.judge(frame, spark.createDataFrame(labels + labels[:50], "doc_id long, quality int, toxic int")).collect()]
    assert len(rows) == 604 and len({repr(r) for r in rows if r["doc_id"] == 7}) == 1 and sum(r["doc_id"] == 7 for r in rows) == 3
    assert len({repr(r) for r in rows if r["doc_id"] == 700}) == 1


def test_sparse_sites_are_shrunk(spark):
    rows = [("a", "x", 1)] + [("b", "x", int(i % 2)) for i in range(200)] + [(f"c{i}", "x", int(i % 4 == 0)) for i in range(300)]
    out = {r["host"]: r["toxic_shift"] for r in quality.site_posteriors(spark.createDataFrame([(*r, 0) for r in rows], "host string, path string, toxic int, bad int")).collect()}
    assert 0 < out["a"] < 3 and 0.3 < out["b"] < 0.62


def test_paths_without_labels_follow_their_host(spark):
    docs = [(i, f"plain words {i % 7}", "p0", f"h{i % 40}", "p", 1) for i in range(2000)] + [(9000 + i, "plain words 3", lang, host, "p", 1) for i, (lang, host) in enumerate([("new", "h3"), ("new", "h4"), (None, "h3"), ("new", "unseen"), ("p0", "h3"), ("new", None)])]
    labels = [(i, int(i % 40 != 3), 0) for i in range(2000)]
    rows = {r["doc_id"]: r for r in quality.judge(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), path="lang").collect()}
    assert len(rows) == len(docs)
    assert rows[9000]["bad_shift"] > 2 and rows[9002]["bad_shift"] == rows[9000]["bad_shift"] and rows[9001]["bad_shift"] < 0
    assert abs(rows[9003]["bad_shift"]) < 1e-9 > abs(rows[9005]["bad_shift"]) and rows[9004]["bad_shift"] > 2
