import json
import random

import pytest
from pyspark.sql import functions as F

from briefloom.functions import brands, features, images, payloads, requests, text, titles
from briefloom.operators import adjudication

GOOD = {"id": "a", "name": "Width", "type": "number", "operator": "lte", "value": 30, "unit": "in", "required": True, "source": "smart_features"}


def each(spark, rows, schema, column):
    frame = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, {schema}")
    return [r[0] for r in frame.orderBy("i").select(column.alias("x")).collect()]


def test_request_errors(spark):
    with_features = lambda *f: {"query": "robot vacuum", "selectedFeatures": list(f)}
    cases = [
        ("[1]", "invalid_body"), ("{", "invalid_body"), (None, "invalid_body"), ("{}", "empty"), ({"query": 5}, "empty"), ({"query": "x" * 201}, "query_too_long"),
        ({"query": "😀" * 101}, "query_too_long"), ({"query": "best stuff"}, "vague"), ({"query": "robot vacuum", "other": [1]}, None), ({"query": "robot vacuum", "budget": None}, None), ({"query": "robot vacuum", "budget": 500}, "invalid_budget"),
        ({"query": "robot vacuum", "budget": "x" * 501, "priorities": 1}, "invalid_budget"), ({"query": "robot vacuum", "priorities": "x" * 2001}, "invalid_priorities"),
        ({"query": "robot vacuum", "avoid": {}}, "invalid_avoid"), ({"query": "robot vacuum", "selectedFeatures": "a"}, "invalid_feature_list"), (with_features(*["a"] * 13), "too_many_features"),
        (with_features("Color: red", None, GOOD), None), (with_features(), None), (with_features(GOOD | {"more": 1}), "invalid_feature"), (with_features(GOOD | {"required": False}), "invalid_feature"), (with_features(GOOD | {"unit": None}), "invalid_feature"),
        (with_features(GOOD | {"value": [1, 2.5]}), None), (with_features(GOOD | {"value": [1]}), "invalid_feature"), (with_features(GOOD | {"value": [None, 1]}), "invalid_feature"), (with_features(GOOD | {"value": None}), "invalid_feature"), (with_features(GOOD | {"id": " "}), "invalid_feature"),
        (with_features({k: v for k, v in GOOD.items() if k != "unit"}), None), (with_features({k: v for k, v in GOOD.items() if k != "value"}), "invalid_feature"), (with_features("x" * 501), "invalid_feature"), (with_features(7), "invalid_feature"),
    ]
    bodies = [(b if b is None or isinstance(b, str) else json.dumps(b),) for b, _ in cases]
    got = each(spark, bodies, "b string", requests.request_error(F.col("b")))
    assert [(b[0][:80] if b[0] else None, g) for b, g in zip(bodies, got)] == [(b[0][:80] if b[0] else None, w) for b, (_, w) in zip(bodies, cases)]


def test_selected_features(spark):
    options = [("under 1,500 watts", "number"), ("at least 5", "range"), ("10 to 20", "range"), ("Red", "enum"), ("yes", "boolean"), ("50 ft", "number"), (None, "enum")]
    made = requests.selected_feature(F.lit("f"), F.lit("Power"), F.col("k"), F.lit("ft"), F.array(F.lit("includes"), F.lit("equals")), F.col("r"))
    got = each(spark, options, "r string, k string", F.struct(made["operator"], made["value"], requests.feature_label(made), requests.feature_search_text(made), made["id"]))
    assert [tuple(x) for x in got[:6]] == [
        ("lte", "1500", "Power: under 1500 ft", "Power under 1500 ft", "f-lte-1500"), ("gte", "5", "Power: at least 5 ft", "Power at least 5 ft", "f-gte-5"), ("between", "10-20", "Power: 10-20 ft", "Power 10 to 20 ft", "f-between-10-20"),
        ("equals", "Red", "Power: Red ft", "Power Red ft", "f-equals-red"), ("required", "true", "Power", "Power", "f-required-true"), ("equals", "50", "Power: 50 ft", "Power 50 ft", "f-equals-50"),
    ]
    legacy = each(spark, [("Color: deep red",), ("Ice: nugget: soft",), ("quiet",), (": x",)], "r string", requests.legacy_feature(F.col("r")))
    assert [(x["name"], x["type"], x["value"], x["id"]) for x in legacy] == [("Color", "enum", "deep red", "color-deep-red"), ("Ice", "text", "nugget: soft", "ice-nugget-soft"), ("quiet", "text", "quiet", "quiet-quiet"), ("Feature", "text", "x", "feature-x")]


@pytest.mark.parametrize(("said", "name", "status"), [
    ("A rechargeable drill", "cordless", "pass"), ("corded electric drill", "cordless", "fail"), ("Battery-Powered", "cordless", "pass"), ("it is not cordless", "cordless", "fail"), ("cordless was not confirmed", "cordless", "needs_verification"),
    ("charger sold separately", "charger included", "fail"), ("no tools required, charger included", "charger included", "pass"), ("no charger required", "charger included", "fail"), ("noise of only 45 dB", "quiet", "pass"), ("noise of 70 dB", "quiet", "needs_verification"),
    ("weighs 6.5 lbs", "lightweight", "pass"), ("a 25 feet rubber hose", "long hose", "pass"), ("", "quiet", "needs_verification"), (None, "gas", "needs_verification"), ("gasket", "gas", "needs_verification"),
])
def test_feature_evidence(spark, said, name, status):
    feature = next(f for f in features.FEATURES if f.name == name)
    assert each(spark, [(said,)], "t string", features.evidence(F.col("t"), feature))[0]["status"] == status


def test_free_text_and_names(spark):
    wanted = features.free_text("wide shelves")
    got = each(spark, [("shelf", ), ("wide oak shelve",), ("without wide shelves",)], "t string", features.evidence(F.col("t"), wanted)["status"])
    assert got == ["needs_verification", "pass", "fail"]
    got = each(spark, [("Self-Empty",), ("needs bluetooth please",), ("velvet",), (None,)], "t string", features.canonical_feature(F.col("t")))
    assert got == ["self emptying", "wireless", "velvet", ""]
    assert each(spark, [("K-Cup, 5 feet & 3 inches",), ("ties",), ("glasses",)], "t string", F.array_join(text.tokens(F.col("t")), " ")) == ["k cup 5 ft and 3 in", "ty", "glass"]


@pytest.mark.parametrize(("name", "title", "match"), [
    ("Sony WH-1000XM5", "Sony WH 1000XM5 Wireless Headphones", True), ("Sony WH-1000XM5", "Sony WH-1000XM4", False), ("Sony WH-1000XM5", "Case for Sony WH-1000XM5", False), ("Breville Barista", "Breville Barista Pro", False),
    ("coffee maker", "coffee maker", False), ("Café Bellissimo", "Cafe Bellissimo 2-cup machine", True), ("Café Bellissimo", "Cafe Bellissimo 44x", False), ("Dyson V15", "Dyson V15 set of 2", False), ("Dyson V15", "", False), ("Dyson V15", None, False),
    ("Dyson V15", "Dyson V15 15 in", True), ("Dyson V15", "Dyson V15 + stand", False), ("Bosch's drill", "Boschs drill", True), ("Bosch drill", "Bosch 2 packs", False), ("A1 B2", "a1 b2" + " x" * 200, False),
])
def test_titles(spark, name, title, match):
    assert each(spark, [(name, title)], "n string, t string", titles.matches_model(F.col("n"), F.col("t"))) == [match]


def test_evaluated_names(spark):
    assert each(spark, [("Café™ X",), (None,), ("",)], "t string", titles.evaluated(F.col("t"))) == ["cafe tm x", None, ""]


def test_adjudication(spark):
    rng = random.Random(5)
    products = [(c, p, f"n{c}{p}", f"u{p}" if p else None, rng.choice([None, "strong"])) for c in range(5) for p in range(1, 4)]
    decisions = [(c, p, rng.choice([None, "ok"]), rng.choice([None, "poor"]), rng.choice([None, 0, 1, 2])) for c, p, *_ in products]
    earlier = [(c, n, u, rng.choice([None, "old"]), "fair", s) for c, p, n, u, _ in products for s in range(2) if rng.random() < 0.6]
    frames = [spark.createDataFrame(*x) for x in ((products, "c int, p int, n string, u string, ref string"), (decisions, "c int, p int, price string, grade string, dup int"), (earlier, "c int, n string, u string, price string, grade string, s int"))]
    got = adjudication.adjudicated(*frames, {"price": "unset", "grade": "none"}, "c", "p", "n", "u", "grade", F.col("ref"), "dup", "s").collect()
    last, want = {(e[0], e[1], e[2]): e for e in earlier}, []
    for (c, p, n, u, ref), (_, _, price, grade, dup) in zip(products, decisions):
        e = last.get((c, n, u), (None,) * 6)
        want.append((c, p, n, price or e[3] or "unset", grade or ref or e[4] or "none", f"n{c}{dup}" if dup else None))
    assert sorted(map(tuple, got)) == sorted(want)
    with pytest.raises(Exception, match="differ in number"):
        adjudication.by_position(frames[0], frames[1].where("p < 3"), "c", "p").count()
    with pytest.raises(Exception, match="no such position"):
        adjudication.duplicate_names(frames[0], "c", "p", "n", F.lit(9)).count()


def test_day_in_utc_whatever_the_zone(spark):
    zone = spark.conf.get("spark.sql.session.timeZone")
    try:
        for other in ("America/New_York", "Asia/Tokyo", "UTC"):
            spark.conf.set("spark.sql.session.timeZone", other)
            days = ["2026-01-01T00:30:00Z", "2025-12-31T23:59:59.999999Z", "1969-12-31T23:59:59Z", None]
            assert each(spark, [(t,) for t in days], "t string", payloads.utc_day(F.col("t").cast("timestamp"))) == ["2026-01-01", "2025-12-31", "1969-12-31", None]
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)


def test_patterns_are_tried_only_where_a_feature_is_spoken_of(spark):
    by = {f.name: f for f in features.FEATURES}
    texts = ["a product", "it has a corded plug", "without battery no powered tools needed", "noise of only 45 db", "no tools here"]
    said = [(t,) for t in texts]
    assert each(spark, said, "t string", features.spoken_of(F.col("t"), by["cordless"])) == [False, True, True, False, False]
    assert each(spark, said, "t string", features.spoken_of(F.col("t"), by["quiet"])) == [False, False, True, False, False]
    # a "no" that is left out joins a name's words; measures count beside names
    assert [x["status"] for x in each(spark, said, "t string", features.evidence(F.col("t"), by["cordless"]))] == ["needs_verification", "fail", "fail", "needs_verification", "needs_verification"]
    assert each(spark, said, "t string", features.evidence(F.col("t"), by["quiet"]))[3] == ("pass", "low noise rating: 45 db")
    # free text whose signs are a pattern's is always tried
    assert each(spark, [("aab x",)], "t string", features.evidence(F.col("t"), features.free_text("a+b x"))["status"]) == ["needs_verification"]
    assert each(spark, [("aab x",)], "t string", features.spoken_of(F.col("t"), features.free_text("a+b x"))) == [True]


def _places(expected, actual):
    """The rule as a loop: each expected word takes the first place that it can."""
    spans, taken, at = {}, set(), 0
    for i in range(len(actual)):
        for end in range(i + 1, min(i + 3, len(actual)) + 1):
            spans.setdefault("".join(actual[i:end]), range(i, end))
    while at < len(expected):
        for end in range(at + 1, min(at + 3, len(expected)) + 1):
            word = "".join(expected[at:end])
            code = any(c.isalpha() for c in word) and any(c.isdigit() for c in word)
            span = spans.get(word) if code else range(actual.index(word), actual.index(word) + 1) if end == at + 1 and word in actual else None
            if span:
                taken.update(span)
                at = end
                break
        else:
            return None
    return sorted(taken)


def test_places_of_a_model(spark):
    r = random.Random(3)
    rows = [([r.choice("a b 1 2 a1 1a b2 ab".split()) for _ in range(r.randint(0, 4))], [r.choice("a b 1 2 a1 1a b2 ab".split()) for _ in range(r.randint(0, 7))]) for _ in range(3000)]
    got = each(spark, rows, "e array<string>, a array<string>", F.array_sort(F.array_distinct(titles.model_places(F.col("e"), F.col("a")))))
    assert got == [_places(e, a) for e, a in rows]


def test_titles_need_no_python_and_links_as_written_no_parser(spark):
    plan = spark.createDataFrame([("a", "b")], "n string, t string").where(titles.matches_model(F.col("n"), F.col("t")))._jdf.queryExecution().toString()
    assert "EvalPython" not in plan
    tail, source = "gstatic.com/shopping?q=", "https://a-b.com/p?x=1"
    urls = [(f"https://encrypted-tbn0.{tail}tbn:1", source, True), (f"HTTPS://encrypted-tbn0.{tail}%41", source, True), (f"https://encrypted-tbn4.{tail}1", source, False), (f"https://encrypted-tbn0.{tail}1\n", source, False), (f"https://encrypted-tbn0.{tail}1", "https://a.test/p", False), (f"https://encrypted-tbn0.{tail}1", "https://a-.com/p", False), (f"https://encrypted-tbn0.{tail}1", "https://a.com\n", False)]
    assert each(spark, [u[:2] for u in urls], "u string, s string", images.product_image(F.col("u"), F.col("s"), F.lit("t"), F.lit(None).cast("string"))) == [u[2] for u in urls]


def test_brands_that_stand_only_without_horsepower_or_spaces(spark):
    said = [("HP laptop",), ("a 5 hp motor",), ("de 5 hp walt drill",), ("a DeWalt and an hp laptop",), (None,)]
    assert each(spark, said, "t string", F.array_contains(brands.known_brands(F.coalesce(F.col("t"), F.lit(""))), "HP")) == [True, False, False, True, False]
    assert each(spark, said, "t string", F.array_contains(brands.known_brands(F.coalesce(F.col("t"), F.lit(""))), "DeWalt")) == [False, False, False, True, False]
