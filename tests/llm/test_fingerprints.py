import hashlib
import re

import pytest
from pyspark.sql import functions as F

from briefloom.llm import fingerprints as fp

SCHEMA = "doc_id long, text string, id string, next_id int"
LONG = " ".join(f"w{i * i % 997}" for i in range(3000))
TEXTS = [(1, "one two three four five six seven eight nine"), (2, None), (5, ""), (4, "One two three four five six seven eight nine ten"), (9, LONG), (8, LONG + " more"), (7, "é" * 10), (None, "no key at all here now"), (3, "a b"), (6, "a b")]


def shingles(text):
    w = [x for x in re.split("[ \t-\r]+", (text or "").lower()) if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_edited_against_brute_force(spark):
    rows = {r["doc_id"]: r for r in fp.edited_fingerprints(spark.createDataFrame([(*t, "x", 1) for t in TEXTS], SCHEMA)).collect()}
    order = sorted(TEXTS, key=lambda t: (t[0] is not None, t[0] or 0), reverse=True)
    assert len(rows) == len(TEXTS)
    for i, (key, text) in enumerate(order):
        text, after = text or "", order[(i + 1) % len(order)][1] or ""
        n = len(text) // 3
        edited = text[: len(text) - n] + after[:n]
        r = rows[key]
        assert (r["n_chars"], r["edited_sha256"]) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r["near_edited"] == pytest.approx(jaccard(text, edited), abs=0.15)
        assert r["near_next"] == pytest.approx(jaccard(text, after), abs=0.15)
        assert r["fingerprint"] == r["edited_fingerprint"] or shingles(text) != shingles(edited)
    assert rows[3]["fingerprint"] == rows[6]["fingerprint"] and rows[2]["fingerprint"] == rows[5]["fingerprint"] == ""


def test_repeated_keys_and_empty_table(spark):
    docs = [(1, "a b c", "", 0), (1, "d e f", "", 0), (2, "g h i", "", 0)]
    rows = fp.edited_fingerprints(spark.createDataFrame(docs, SCHEMA)).collect()
    assert sorted(r["doc_id"] for r in rows) == [1, 1, 2]
    assert next(r for r in rows if r["doc_id"] == 2)["edited_sha256"] == hashlib.sha256(b"g h a").hexdigest()
    assert fp.edited_fingerprints(spark.createDataFrame([], SCHEMA)).count() == 0
    only = fp.edited_fingerprints(spark.createDataFrame(docs[2:], SCHEMA)).first()
    assert only["near_next"] == 1.0


def test_sketches_merge_and_estimate(spark):
    a, b = " ".join(f"x{i}" for i in range(1500)), " ".join(f"x{i}" for i in range(750, 2250))
    row = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a")).alias("a"), fp.sketch(F.col("b")).alias("b"))
    row = row.select(fp.resemblance(F.col("a"), F.col("b")), fp.containment(F.col("a"), F.col("b")), fp.distinct_count(F.col("a")), fp.distinct_count(fp.merge(F.col("a"), F.col("b")))).first()
    assert row[0] == pytest.approx(1 / 3, abs=0.13) and row[1] == pytest.approx(0.5, abs=0.2)
    assert row[2] == pytest.approx(1496, rel=0.3) and row[3] == pytest.approx(2246, rel=0.3)


def test_sketches_of_many_parts(spark):
    parts = [(g, " ".join(f"{g}{(i * 37 + j) % 900}" for j in range(90))) for i in range(40) for g in ("a", "b", None)] + [("empty", ""), ("empty", None)]
    rows = spark.createDataFrame(parts, "g string, t string").withColumn("s", fp.sketch(F.col("t")))
    got = {r["g"]: r["s"] for r in fp.merge_all(rows, ["g"], "s").collect()}
    hashes = {}
    for r in rows.select("g", fp.shingle_hashes(F.col("t")).alias("h")).collect():
        hashes.setdefault(r["g"], set()).update(r["h"])
    assert got == {g: sorted(h)[: fp.K] for g, h in hashes.items()} and got["empty"] == []
