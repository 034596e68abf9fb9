import hashlib
import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from briefloom.llm import substring_dedup

SCHEMA = "doc_id long, text string, spans string, n_words2 int, id string"


def brute(docs, window):
    words = [re.findall(r"[^\x20\x09-\x0D]+", t or "") for _, t in docs]
    first = {}
    for (key, _), w in zip(docs, words):
        for i in range(len(w) - window + 1):
            if key is not None:
                g = tuple(w[i : i + window])
                first[g] = min(key, first.get(g, key))
    out = []
    for (key, _), w in zip(docs, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if key is not None and first[tuple(w[i : i + window])] < key:
                gone |= set(range(i, i + window))
        kept = [x for i, x in enumerate(w) if i not in gone]
        out.append((key, len(w), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("window", [3, 13, 25])
def test_against_brute_force(spark, window):
    rng = random.Random(window)
    passages = [[f"w{rng.randrange(40)}" for _ in range(rng.randrange(5, 70))] for _ in range(8)]
    texts = []
    for _ in range(60):
        w = [f"ü{rng.randrange(3)}" for _ in range(rng.randrange(0, 30))]
        for _ in range(rng.randrange(0, 3)):
            p = rng.choice(passages)
            w += p[rng.randrange(3) : len(p) - rng.randrange(3)] + [f"x{rng.randrange(500)}"] * rng.randrange(3)
        texts.append(rng.choice([" ", "\n", "\t "]).join(w))
    texts += [None, "", "a a a a a " * 30, "a a a a a " * 30]
    docs = list(zip(rng.sample(range(500), len(texts)), texts))
    docs += [(None, docs[0][1]), (None, None), (600, docs[1][1]), (600, docs[1][1])]
    frame = spark.createDataFrame([(*d, "s", 1, "i") for d in docs], SCHEMA)
    got = substring_dedup.cut_repeated(frame, window=window)
    assert got.columns[:5] == frame.columns
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute(docs, window)


def test_layout_and_empty_table(spark):
    p = " ".join(f"p{i}" for i in range(20))
    frame = spark.createDataFrame([(1, p, "", 0, ""), (2, f"Before\nthat  line {p}\nafter it", "", 0, "")], SCHEMA)
    texts = {r["doc_id"]: r["text"] for r in substring_dedup.cut_repeated(frame).collect()}
    assert texts == {1: p, 2: "Before\nthat  line after it"}
    assert substring_dedup.cut_repeated(frame.where("doc_id > 5")).count() == 0


def _paths(edges):
    """Edges in sets that straight nodes connect; circles are left out."""
    into, out = {}, {}
    for u, v in edges:
        out.setdefault(u, []).append((u, v))
        into.setdefault(v, []).append((u, v))
    straight = {n for n in into if len(into[n]) == len(out.get(n, ())) == 1}
    found = []
    for e in edges:
        if e[0] not in straight:
            path = [e]
            while path[-1][1] in straight:
                path.append(out[path[-1][1]][0])
            found.append(path)
    return found


def test_compaction_against_walks(spark):
    rng = random.Random(9)
    passage = [rng.randrange(10**6) for _ in range(120)]
    docs = [passage[:40], passage[30:70], passage[60:], passage[20:90], passage[:50] + [1, 2, 3] + passage[55:], passage[100:] + passage[:20], [7, 8, 9] * 5, [8, 9, 7, 8]]
    rng.shuffle(docs)
    source = {}
    for key, d in enumerate(docs):
        for i in range(len(d) - 1):
            source.setdefault((d[i], d[i + 1]), (key, i))
    frame = spark.createDataFrame([(at, u, v) for (u, v), at in source.items()], "at struct<sid:long,sstart:int>, u long, v long")
    rows = substring_dedup.compact(frame).collect()
    assert len(rows) == len(source)
    edge, got = {at: e for e, at in source.items()}, {}
    for r in sorted(rows, key=lambda r: r["place"]):
        got.setdefault(tuple(r["path"]), []).append(edge[tuple(r["at"])])
    walks = _paths(list(source))
    assert len([w for w in walks if len({source[e][0] for e in w}) > 1]) > 0
    for w in walks:
        assert w in list(got.values())
    circle = [e for e in source if e not in {e for w in walks for e in w}]
    assert circle and sum(len(p) for p in got.values()) == len(source)


def test_compacted_paths_are_the_candidates(spark, monkeypatch):
    """A long passage of many documents is one path: one span a document, one place to verify. Without compaction it is many."""
    rng = random.Random(11)
    p = " ".join(f"p{rng.randrange(10**6)}" for _ in range(400))
    docs = [(i, f"{' '.join(f'a{i}_{j}' for j in range(20))} {p} {' '.join(f'b{i}_{j}' for j in range(20))}") for i in range(12)]
    frame = spark.createDataFrame([(*d, "s", 1, "i") for d in docs], SCHEMA)

    def spans():
        rows = [r for r in substring_dedup.repeated_spans(frame).collect() if r["n"] > 12]  # others are windows at the ends of the passage
        return {r["id"] for r in rows}, len(rows), len({(r["sid"], r["sstart"]) for r in rows}), min(r["n"] for r in rows)

    held, n, places, least = spans()
    assert held == set(range(1, 12)) and n == 11 and places == 1 and least > 350
    assert sorted((tuple(r) for r in substring_dedup.cut_repeated(frame).select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute(docs, 13)
    monkeypatch.setattr(substring_dedup, "compact", lambda paths: paths.select("at", F.col("at").alias("path"), F.lit(0).alias("place")))
    rows = substring_dedup.repeated_spans(frame).collect()
    assert len(rows) > 11 * 20 and max(r["n"] for r in rows) < 20


def test_documents_that_leave_and_enter_a_path(spark):
    """Where one document goes on otherwise, or comes from elsewhere, a path ends, whatever the number of documents."""
    rng = random.Random(12)
    p = [f"p{rng.randrange(10**6)}" for _ in range(200)]
    own = lambda i: [f"x{i}_{rng.randrange(10**6)}" for _ in range(30)]
    docs = [(1, own(1) + p), (2, own(2) + p[:100] + own(3)), (3, own(4) + p[100:] + own(5)), (4, own(6) + p[:100] + own(7) + p[100:]), (5, p[50:150]), (6, p[:60] + p[50:150] + p[140:] + p[:60]), (7, (p[:40] + own(8)) * 3)]
    docs = [(key, " ".join(w)) for key, w in docs]
    got = substring_dedup.cut_repeated(spark.createDataFrame([(*d, "s", 1, "i") for d in docs], SCHEMA))
    assert sorted(tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()) == brute(docs, 13)


def test_spans_are_verified_at_their_source(spark):
    """Words that aren't those of the source stay."""
    p, q = " ".join(f"p{i}" for i in range(20)), " ".join(f"q{i}" for i in range(20))
    frame = spark.createDataFrame([(1, "a " + p, "", 0, ""), (2, "b " + p, "", 0, ""), (3, q, "", 0, "")], SCHEMA)
    spans = substring_dedup.repeated_spans(frame)
    rows = spans.collect()
    assert sorted(i for r in rows for i in range(r["start"], r["start"] + r["n"])) == list(range(1, 9))
    assert all((r["id"], r["sid"], r["sstart"]) == (2, 1, r["start"]) for r in rows)
    digest = substring_dedup._digest(p.encode().split())
    cut = substring_dedup._cutter(["id", "text"], "text", 13)
    batch = pa.RecordBatch.from_pylist([{"id": 2, "text": "b " + p, "spans": [{"start": 1, "n": 8, "digest": digest}]}, {"id": 3, "text": q, "spans": [{"start": 0, "n": 8, "digest": digest}]}])
    assert next(cut(iter([batch]))).column("n_removed").to_pylist() == [20, 0]


def test_rows_that_repeat_a_key_with_other_texts(spark):
    p = " ".join(f"p{i}" for i in range(20))
    docs = [(1, p), (2, "x " + p), (2, "some other words that are of no passage at all and go on for a while longer"), (2, p), (3, "y " + p + " y"), (3, "short")]
    got = substring_dedup.cut_repeated(spark.createDataFrame([(*d, "s", 1, "i") for d in docs], SCHEMA))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute(docs, 13)


def test_hot_edges_are_joined_in_parts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "HOT", 40)
    p = " ".join(f"p{i}" for i in range(16))
    docs = [(i, f"{i} x{i} {p} y{i}") for i in range(300)] + [(1000 + i, " ".join(f"q{i}_{j}" for j in range(14)) + f" z{k}") for k in range(2) for i in range(200)]
    docs = [(2 * i, t) for i, (_, t) in enumerate(docs)]
    got = substring_dedup.cut_repeated(spark.createDataFrame([(*d, "s", 1, "i") for d in docs], SCHEMA))
    assert sorted((tuple(r) for r in got.select("doc_id", "n_words", "n_removed", "kept_sha256").collect()), key=repr) == brute(docs, 13)
