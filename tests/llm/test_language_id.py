import random
import zlib

from pyspark.sql import functions as F

from briefloom.llm import language_id

SCHEMA = "doc_id long, text string, lang string, held_out string"


def _model(samples):
    return language_id.Model(language_id.learn(k, v) for k, v in samples.items())


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = language_id.identify(docs, language_id.fit(docs)).collect()
    given = {r["doc_id"]: r for r in docs.collect()}
    assert len(rows) == len(given)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"] and given[r["doc_id"]]["lang"] is not None]
    assert sum(r["lang_pred"] == given[r["doc_id"]]["lang"] for r in held) / len(held) > 0.98


def test_odd_texts(spark):
    docs = spark.createDataFrame([(1, "the house is near the other one", "en", "x"), (3, "das Haus ist bei dem anderen", "de", "x"), (4, None, "en", "x"), (5, "", "en", "x"), (6, "123 !!", None, "x"), (None, "das Haus", None, "x"), (8, "\ud7ff 東京", None, "x"), (8, "the house", None, "x")], SCHEMA)
    model = language_id.fit(docs)
    rows = sorted((repr(r["doc_id"]), r["lang_pred"]) for r in language_id.identify(docs, model).collect())
    assert [r for r in rows if r[0] in "456"] == [("4", "und"), ("5", "und"), ("6", "und")]
    assert ("None", "de") in rows and ("8", "en") in rows
    nothing = language_id.fit(docs.where("lang = 'xx'"))
    assert {r["lang_pred"] for r in language_id.identify(docs, nothing).collect()} == {"und"}
    assert language_id.identify(docs.where("doc_id > 99"), model).count() == 0


def test_phrases_are_longest_matches():
    model = _model({"a": ["abcabcabd"], "b": ["xyz"]})
    found = model.phrases([model.coded(language_id.folded(t)) for t in ("abcabd", "xyzxyz", "abxy")])
    assert found[0].tolist()[0] == 1 and found[1].tolist()[1] == 2


def _right(spark, docs):
    frame = spark.createDataFrame([(*d, "x") for d in docs], SCHEMA)
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(frame, language_id.fit(frame)).collect()}
    return {key: (lang, found[key]) for key, _, lang in docs if zlib.crc32(str(key).encode()) % 4 == 2}


def _words(rng, lexicon, n):
    return " ".join(rng.choice(lexicon) for _ in range(n))


def test_learns_from_whole_texts(spark):
    rng = random.Random(3)
    lexicons = {k: ["".join(rng.choice("abcdefghijklmno") for _ in range(rng.randrange(2, 8))) for _ in range(120)] for k in ("aa", "bb", "cc")}
    openings = {"aa": "shared header of all pages, with notices and terms. " * 20, "bb": "shared header of all pages, with notices and terms. " * 20, "cc": "2026 10 11 " * 100}
    docs = [(i, (openings[k] if zlib.crc32(str(i).encode()) % 4 != 2 else "") + _words(rng, lexicons[k], 600), k) for i, k in enumerate(["aa", "bb", "cc"] * 60)]
    shown = _right(spark, docs)
    assert {lang for lang, _ in shown.values()} == {"aa", "bb", "cc"} and all(a == b for a, b in shown.values())


def test_scripts_of_many_letters_are_told_apart(spark):
    rng = random.Random(4)
    han, kana, hangul, latin = ([chr(a + i) for i in range(n)] for a, n in ((0x4E00, 900), (0x3041, 80), (0xAC00, 900), (0x61, 26)))
    cyrillic = [chr(0x430 + i) for i in range(32)]
    lexicons = {k: ["".join(rng.choice(letters) for _ in range(size)) for _ in range(400)] for k, letters, size in (("en", latin, 5), ("ja", kana + han[:300], 3), ("ko", hangul, 3), ("ru", cyrillic, 5), ("zh", han, 3))}
    docs = [(i, _words(rng, lexicons[k], 150), k) for i, k in enumerate(["en", "ja", "ko", "ru", "zh"] * 40)]
    shown = _right(spark, docs)
    assert {lang for lang, _ in shown.values()} == set(lexicons) and all(a == b for a, b in shown.values())


def test_sparse_and_dense_tables_agree(monkeypatch):
    rng = random.Random(5)
    samples = {"a": ["".join(rng.choice("abcd ") for _ in range(500))], "b": ["".join(rng.choice("cdef ") for _ in range(500))]}
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(rng.randrange(1, 600))) for _ in range(20)]
    found = []
    for most in (1 << 20, 0):
        monkeypatch.setattr(language_id, "DENSE_BYTES", most)
        model = _model(samples)
        found.append(model.phrases([model.coded(language_id.folded(t)) for t in texts]).tolist())
    assert found[0] == found[1]


def test_unknown_letters_are_phrases_of_their_own():
    model = _model({"a": ["ab"], "b": ["xyz"]})
    found = model.phrases([model.coded(language_id.folded(t)) for t in ("axb", "xab", "abq")])
    assert found[0].tolist() == [3, 2, 2]


def _longest(sample, text):
    """Phrases by trying every longer match."""
    sample, text = ([chr(c) for c in language_id.folded(t)] for t in (sample, text))
    sample, at, n = "".join(sample), 0, 0
    while at < len(text):
        length = 1
        while at + length < len(text) and "".join(text[at : at + length + 1]) in sample:
            length += 1
        at, n = at + length, n + 1
    return n


def test_phrases_cross_blocks():
    rng = random.Random(6)
    random_letters = lambda letters, n: "".join(rng.choice(letters) for _ in range(n))
    han = [chr(0x4E00 + i) for i in range(700)]
    samples = {"a": [random_letters("ab ", 3000)], "b": [random_letters("abcdefghij ", 4000)], "c": [random_letters(han[:400], 4000)], "d": [random_letters(han[300:], 4000)]}
    model = _model(samples)
    texts = ["", "a", "ab" * 900, "a" * 1000, random_letters("ab ", 2000), random_letters("abcxyz ", 1500), random_letters(han, 1200), random_letters(han[:400], 511), *(s[0] for s in samples.values())]
    texts += [s[0][700:1900] + s[0][100:1300] for s in samples.values()]
    found = model.phrases([model.coded(language_id.folded(t)) for t in texts])
    for k, s in enumerate(samples.values()):
        assert found[k].tolist() == [_longest(s[0] + " ", t) for t in texts]
    assert [found[k, 8 + k] for k in range(4)] == [1] * 4


def test_ties_and_repeated_rows(spark):
    one, two = [i for i in range(20) if zlib.crc32(str(i).encode()) % 4 != 2][:2]
    docs = spark.createDataFrame([(i, "same words in both", lang, "x") for i, lang in ((one, "bb"), (two, "aa"), (one, "bb"))] + [(99, "same words", None, "x")] * 2, SCHEMA)
    rows = language_id.identify(docs, language_id.fit(docs)).collect()
    assert {r["lang_pred"] for r in rows} == {"aa"} and len(rows) == 5 and {r["score"] for r in rows} == {0.0}


def test_sample_is_bounded_in_rows_of_whole_texts(spark):
    docs = spark.createDataFrame([(i, f"word{chr(97 + i % 20)} " * (30 + i % 7), f"l{i % 20:02}", "x") for i in range(800)] + [(5000, "abc " * 5000, "l00", "x"), (5001, "def " * 9000, "zz", "x"), (5006, "ghi " * 8000, "zz", "x")], SCHEMA)
    learned = {r["lang"]: r["n"] for r in language_id.fit(docs, rows=3, letters=10_000).collect()}
    assert len(learned) == 21 and all(100 < n <= 3 * 216 for k, n in learned.items() if k != "zz") and learned["zz"] == 4 * 8000
    few = {r["lang"]: r["n"] for r in language_id.fit(docs, rows=8, letters=450).collect()}
    assert all(n <= 450 for k, n in few.items() if k != "zz")


def test_one_long_text_each(spark):
    """Two languages with one labelled book each: texts of eight words are told apart."""
    rng = random.Random(7)
    lexicons = {k: ["".join(rng.choice("abcdefghijklm") for _ in range(rng.randrange(2, 8))) for _ in range(3000)] for k in ("aa", "bb")}
    taught, asked = ([i for i in range(3000) if (zlib.crc32(str(i).encode()) % 4 == 2) == held] for held in (False, True))
    docs = [(taught[j], _words(rng, lexicons[k], 20_000), k) for j, k in enumerate(lexicons)] + [(asked[j], _words(rng, lexicons[k], 8), k) for j, k in enumerate(["aa", "bb"] * 200)]
    shown = _right(spark, docs)
    assert len(shown) == 400 and sum(a == b for a, b in shown.values()) / 400 >= 0.99


def test_three_hundred_languages_in_groups(spark, monkeypatch):
    monkeypatch.setattr(language_id, "GROUP_BYTES", 1 << 20)
    rng = random.Random(8)
    letters = "abcdefghijklmnopqrstuvwxyz"
    lexicons = {f"l{i:03}": ["".join(rng.choice(letters) for _ in range(rng.randrange(3, 8))) for _ in range(60)] for i in range(300)}
    taught, asked = ([i for i in range(4000) if (zlib.crc32(str(i).encode()) % 4 == 2) == held] for held in (False, True))
    docs = [(taught[j], _words(rng, lexicons[k], 150), k) for j, k in enumerate(lexicons)] + [(asked[j], _words(rng, lexicons[k], 15), k) for j, k in enumerate(lexicons)]
    frame = spark.createDataFrame([(*d, "x") for d in docs] + [(asked[-1], "42", None, "x")], SCHEMA)
    learned = language_id.fit(frame)
    assert len(language_id._groups(learned)) > 3
    rows = {r["doc_id"]: r for r in language_id.identify(frame, learned).collect()}
    assert rows[asked[-1]]["lang_pred"] == "und" and sum(rows[key]["lang_pred"] == k for key, _, k in docs[300:]) / 300 >= 0.99
    one = {r["doc_id"]: r for r in language_id.identify(frame.where(F.col("doc_id").isin(asked[:40])), learned.where("lang < 'l040'")).collect()}
    assert all(one[key]["score"] >= rows[key]["score"] for key in asked[:40])
