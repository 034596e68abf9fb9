import random
import re
from collections import Counter, defaultdict

import pytest

from briefloom.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, term string, tile int"
_TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
_SMALL = {c: c + 32 for c in range(65, 91)}


def brute(docs, least, top):
    uses, documents, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = [w.translate(_SMALL) for w in _TERM.findall(text or "")]
        groups.add((lang, source))
        uses[lang, source].update(found)
        documents[lang].update(set(found))
    out = []
    for lang in {g[0] for g in groups}:
        kept = [t for t, n in documents[lang].items() if n >= least]
        share = lambda counts: {t: 1 + 10**9 * (counts[t] + 5) // (sum(counts[k] for k in kept) + 5 * len(kept)) for t in kept}  # noqa: E731, B023
        sources = sorted(s for k, s in groups if k == lang)
        p, q = {s: share(uses[lang, s]) for s in sources}, share(sum((uses[lang, s] for s in sources), Counter()))
        for s in sources:
            pairs = [("pair", o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            marks = [("term", t, p[s][t] - q[t]) for t in kept if uses[lang, s][t] and p[s][t] > q[t]]
            for rows, most in ((pairs, None), (marks, top)):
                rows.sort(key=lambda r: (-r[2], r[1].encode()))
                out += [(lang, s, *r, i + 1) for i, r in enumerate(rows[:most])]
    return sorted(out)


def _found(spark, docs, **more):
    frame = spark.createDataFrame([(*d, "t", 1) for d in docs], SCHEMA)
    return sorted(tuple(r) for r in divergence.audit(frame, **more).select("lang", "source", "part", "item", "value", "rank").collect())


def _docs(n, seed):
    rng = random.Random(seed)
    lexicon = ["Straße", "東京", "naïve", "É", "é", "a", "B", "b"] + ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(60)]
    docs = [(i, rng.choice([", ", " ", "1", "\x00"]).join(rng.choices(lexicon, range(len(lexicon), 0, -1), k=rng.choice([0, 1, 30, 80]))), rng.choice(["en", "en", "en", "de", None]), rng.choice(["s1", "s1", "s1", "s2", "ß", "", None])) for i in range(n)]
    return docs + [(1, None, "en", "only null"), (1, "12 34", "en", "no letters"), (None, "", "xx", "alone"), (2, "a a a", "xx", "other")] + docs[:20]


@pytest.mark.parametrize("sizes", [None, (8, 2, 64, 50)])
def test_against_brute_force(spark, monkeypatch, sizes):
    if sizes:
        for name, size in zip(("TERMS", "GROUPS", "AT_ONCE", "GATHERED"), sizes):
            monkeypatch.setattr(divergence, name, size)
    docs = _docs(300, 1)
    assert _found(spark, docs) == brute(docs, 30, 50)
    assert _found(spark, docs, min_documents=5, top=3) == brute(docs, 5, 3)


def test_long_texts_are_cut_between_terms(monkeypatch):
    text = ("word Ärger x" * 50 + "y" * 300 + " z") * 3
    whole = [t for part in divergence.terms(text.encode()) for t in part]
    monkeypatch.setattr(divergence, "PIECE", 7)
    parts = [*divergence.terms(text.encode())]
    assert [t for part in parts for t in part] == whole == [w.translate(_SMALL).encode() for w in _TERM.findall(text)] and len(parts) > 50


def test_counts_beyond_what_billionths_of_a_long_hold():
    import numpy as np

    counts = np.array([[10**12, 0], [3, 10**10]])
    want = [[1 + 10**9 * (int(c) + 5) // (int(t) + 10) for c in row] for row, t in zip(counts, counts.sum(axis=1))]
    assert divergence.shares(counts, counts.sum(axis=1), 2).tolist() == want


def test_empty_table(spark):
    assert _found(spark, []) == []
