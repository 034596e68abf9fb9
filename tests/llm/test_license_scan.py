import random
import re

from briefloom.llm import license_scan

SCHEMA = "doc_id long, text string, spans string, place int, gram long"


def test_base_against_brute_force(spark):
    rng = random.Random(6)
    parts = ["under the MIT license", "Apache License, Version 2.0", "apache license version 2", "cc by nc", "CC-BY-NC", "cc by", "by nc", "é", "Über", "the", "under the mit", "license", "x_y", "under the M\u0130T license", "apac\u212Ae license version 2"]
    docs = [(i, rng.choice([" ", "\n", ", "]).join(rng.choice(parts) for _ in range(rng.randrange(0, 40)))) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "cc by nc " * 5000), (503, "under the mit license")]
    rows = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame([(*d, "s", 1, 2) for d in docs], SCHEMA)).collect()}
    assert len(rows) == len(docs)
    for key, text in docs:
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        places = [(i, label) for phrase, label in license_scan.PHRASES for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
        r = rows[key]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert (r["first_word"], r["last_word"]) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places}))
        assert set(r["base_labels"].split(",")) - {""} <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1


def test_templates_by_diagonals(spark):
    gpl = "This work is licensed under the GNU General Public License, version 3."
    docs = [(1, "Some words. " + gpl), (2, gpl.replace("Public", "Public (really)")), (3, "this work is public"), (3, gpl), (None, "x " + gpl)]
    rows = license_scan.scan(spark.createDataFrame([(*d, "s", 1, 2) for d in docs], SCHEMA)).collect()
    found = sorted((repr(r["doc_id"]), r["labels"], r["score"] > 0.8) for r in rows)
    assert found == [("1", "gpl-3", True), ("2", "gpl-3", True), ("3", "", False), ("3", "gpl-3", True), ("None", "gpl-3", True)]
    assert license_scan.scan(spark.createDataFrame([], SCHEMA)).count() == 0


def test_whole_licences_and_large_tables_of_templates(spark, monkeypatch):
    text = dict((label, t) for t, label in license_scan.TEXTS)
    mit = text["mit"].replace("sublicense, and/or sell", "sublicence, or even sell")
    docs = [(1, "Intro. " * 40 + mit + " end " * 30), (2, mit[: len(mit) // 3]), (3, text["zlib"]), (4, (text["isc"] + " x ") * 40), (5, text["gpl-3"]), (6, " ".join(w if i % 4 else "xx" for i, w in enumerate(text["bsl-1"].split())))]
    docs += [(7, "same " + text["unlicense"])] * 3
    frame = spark.createDataFrame([(*d, "s", 1, 2) for d in docs], SCHEMA)
    rows = license_scan.scan(frame).collect()
    labels = [(r["doc_id"], set(r["labels"].split(","))) for r in rows]
    found = dict(labels)
    assert "mit" in found[1] and "zlib" in found[3] and "isc" in found[4] and "gpl-3" in found[5] and "bsl-1" not in found[6]
    assert [k for k, x in labels if "unlicense" in x] == [7] * 3
    assert {s["label"] for r in rows if r["doc_id"] == 1 for s in r["spans"] if s["start"] == 40 and s["share"] > 0.95} >= {"mit"}
    assert sum(s["label"] == "isc" and s["share"] == 1 for r in rows if r["doc_id"] == 4 for s in r["spans"]) >= 40
    assert found[2] == {"mit"}  # of its opening, a notice of its own
    monkeypatch.setattr(license_scan, "MOST_WORDS", 0)
    assert sorted(map(repr, license_scan.scan(frame).collect())) == sorted(map(repr, rows))
