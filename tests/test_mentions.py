import random

import pytest
from pyspark.sql import functions as F

from briefloom.operators import mentions


def _plain(t):
    return "".join(c if c.isascii() and c.isalnum() else " " for c in (t or "").lower().replace("&", " and ")).split()


def _brute(texts, dictionary):
    names = {}
    for alias, entry in dictionary:
        if _plain(alias):
            names.setdefault(tuple(_plain(alias)), []).append((alias, entry))
    every, taken = set(), []
    for key, t in texts:
        w, end = _plain(t), 0
        for p in range(len(w)):
            here = [n for n in range(len(w) - p, 0, -1) if tuple(w[p : p + n]) in names]
            every |= {(key, p, n, " ".join(w[p : p + n])) for n in here}
            if here and p >= end:
                end = p + here[0]
                taken += [(key, p, here[0], e) for _, e in names[tuple(w[p:end])]]
    return sorted(every, key=repr), sorted(taken, key=repr)


def _frames(spark, texts, dictionary):
    return spark.createDataFrame(texts, "key int, text string"), spark.createDataFrame(dictionary, "alias string, phrase string")


def _same(spark, texts, dictionary):
    rows, names = _frames(spark, texts, dictionary)
    every, taken = _brute(texts, dictionary)
    got = mentions.spans(rows, ["key"], "text", mentions.phrases(names, "alias"))
    assert sorted(map(tuple, got.select("key", "place", "n_words", "phrase").collect()), key=repr) == every
    got = mentions.mentions(rows, ["key"], "text", names, "alias")
    assert sorted(map(tuple, got.select("key", "place", "n_words", "entry.phrase").collect()), key=repr) == taken


def test_random_texts_against_plain_python(spark):
    rng = random.Random(7)
    say = lambda n: rng.choice([" ", "-", ", "]).join(rng.choice(["Air", "fryer", "XL", "&", "pro", "9"]) for _ in range(n))
    texts = [(i, say(rng.randrange(40))) for i in range(60)]
    _same(spark, texts, [(say(rng.randrange(1, 6)), f"e{i}") for i in range(40)])


def test_odd_rows(spark):
    texts = [(1, None), (2, ""), (3, "--"), (None, "Black & Decker drill"), (None, "a drill"), (4, "DRILL drill drill"), (5, "drill"), (5, "the drill")]
    _same(spark, texts, [("drill", "x"), ("Drill!", "y"), ("black and decker", "b"), ("decker drill", "never"), (None, "n"), ("", "n"), ("?", "n"), ("of no text", "z")])
    rows, names = _frames(spark, texts, [])
    assert mentions.mentions(rows, ["key"], "text", names, "alias").count() == 0
    rows, names = _frames(spark, [], [("drill", "x")])
    assert mentions.mentions(rows, ["key"], "text", names, "alias").count() == 0


def test_rows_that_repeat_count_once(spark):
    rows, names = _frames(spark, [(1, "my drill")] * 3, [("drill", "x")])
    assert mentions.mentions(rows, ["key"], "text", names, "alias").count() == 1


def test_a_long_text_and_a_hot_phrase(spark):
    rows, names = _frames(spark, [(1, "pro air " * 30_000)] + [(i, "air pro") for i in range(2, 3000)], [("air", "a"), ("air pro", "b"), ("pro air pro", "c")])
    got = mentions.mentions(rows, ["key"], "text", names, "alias").groupBy("entry.phrase").count()
    # the long text: pro air pro | air pro | air pro ... | air; the short ones: air pro
    assert {r["phrase"]: r["count"] for r in got.collect()} == {"c": 1, "b": 29_998 + 2998, "a": 1}


@pytest.mark.parametrize("bits", [6, 10])
def test_a_full_sieve_only_lets_more_through(spark, monkeypatch, bits):
    monkeypatch.setattr(mentions, "SIEVE", bits)
    _same(spark, [(i, f"part {i} of {i + 1} pieces") for i in range(50)], [(f"{i} of", str(i)) for i in range(200)])


def test_two_hundred_thousand_names_make_no_longer_plan(spark):
    names = spark.range(200_000).select(F.concat(F.lit("model x"), "id").alias("alias"), F.col("id").alias("number"))
    rows = spark.range(500).select("id", F.concat(F.lit("the model x"), F.col("id") * 400, F.lit(" and model x"), F.col("id") + 300_000).alias("text"))
    got = mentions.mentions(rows, ["id"], "text", names, "alias")
    assert len(got._jdf.queryExecution().optimizedPlan().toString()) < 10_000
    assert got.where("entry.number = id * 400").count() == got.count() == 500
