import random
import re

import hypothesis
import pytest

from pyspark.sql import functions as F

from briefloom.functions import briefs, categories, requests, specs
from briefloom.functions import dictionaries as D
from briefloom.operators import shortlist
from briefloom.plans import queries


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t"))).first()[0]


def sizes(spark, text):
    return [r["label"] for r in briefs.size_constraints(spark.createDataFrame([(text,)], "t string"), "t").orderBy("ord").collect()]


def test_sizes(spark):
    assert sizes(spark, "under 50 ft") == ["Length: under 50 ft", "Length: 50 ft"]
    assert sizes(spark, "depth under 30 inches") == ["Width: under 30 inches", "Depth: under 30 inches"]
    assert sizes(spark, "200 sq ft room") == [] and sizes(spark, None) == [] and sizes(spark, "") == []


def test_budgets(spark):
    rule = lambda b, p, q: spark.range(1).select(briefs.budget_rule(F.lit(b).cast("string"), F.lit(p).cast("string"), F.lit(q).cast("string")).alias("r")).select("r.*").first()
    assert rule("$500", "between $100 and $300", "tv")["amount"] == 300
    assert rule("about 800", None, "tv")["operator"] == "target"
    assert rule("whatever", None, "tv")["operator"] == "unknown"


def test_look_back_of_specifications(spark):
    rows = specs.spec_constraints(spark.createDataFrame([("at least 400 cfm, under 9 lbs",), (None,), ("",)], "t string"), "t").collect()
    assert {(r["spec"], r["operator"], r["value"]) for r in rows} == {("cfm", "min", 400.0), ("weightLb", "min", 9.0)}


def test_greedy_dedupe_against_a_fold(spark):
    rng = random.Random(3)
    rows = [(u, i, rng.choice("abcd"), rng.randrange(4)) for u in range(20) for i in range(15)]
    want = []
    for u in range(20):
        names, links, n = set(), set(), 0
        for _, i, a, b in (r for r in rows if r[0] == u):
            if a not in names and b not in links and n < 5:
                names.add(a)
                links.add(b)
                n += 1
                want.append((u, i))
    got = shortlist.greedy_dedupe(spark.createDataFrame(rows, "u long, i long, a string, b long"), "u", "i", ["a", "b"], at_most=5)
    assert sorted((r["u"], r["i"]) for r in got.collect()) == want


@pytest.mark.parametrize("spec", D.SPECS, ids=lambda s: s.id)
def test_what_a_specification_needs_stands_in_all_that_it_matches(spec):
    """Texts made from a pattern hold one of its units: no reading is left out."""

    @hypothesis.settings(max_examples=60, deadline=None, suppress_health_check=list(hypothesis.HealthCheck), database=None)
    @hypothesis.given(hypothesis.strategies.one_of(*[hypothesis.strategies.from_regex(re.compile(m, re.ASCII | re.IGNORECASE), fullmatch=True) for m in spec.matchers]))
    def holds(text):
        assert any(n in text.lower() for n in spec.needs)

    assert spec.needs
    holds()


def _regexes(spark, f):
    """How many patterns the plan of f of a text tries."""
    plan = spark.createDataFrame([("x",)], "t string").select(f(F.col("t")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    return len(re.findall("regexp_replace|regexp_extract|RLIKE", plan))


def test_a_category_is_read_once(spark):
    assert _regexes(spark, briefs.category_group) < 30
    assert _regexes(spark, lambda t: briefs.premium_cap(F.lit(10.0), briefs.category_group(t))) < 30


def test_base_categories_make_the_base_once(spark):
    plan = queries.queries()["base_categories"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("|taupe|") == 1  # the pattern of colours


def test_groups_of_bases_are_groups_of_their_searches(spark):
    texts = ["Best black sofa under $2,000", "desk under 30 inches wide for sale", "carpet cleaner", "black", "best deals", "  ", "", None, "R&D laptop & left-facing", "best for sale for sale"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(briefs.category_group(F.col("t")).alias("a"), categories.base_category(F.col("t")).alias("base"))
    assert all(r["a"] == r["b"] for r in rows.select("a", briefs.base_group(F.col("base")).alias("b")).collect())


def test_a_selected_feature_is_read_once(spark):
    made = lambda t: requests.selected_feature(t, t, F.lit("number"), F.lit("in"), F.array(F.lit("equals")), t)
    assert _regexes(spark, made) < 60 and _regexes(spark, lambda t: briefs.selected_sizes(made(t))) < 80
    for name, unit, raw, want in (("Depth", "in", "1 to 2", ["Depth: at least 1 in", "Depth: under 2 in"]), ("Width", "", "under 7", ["Width: under 7 in"]), ("Cord length", "ft", "5", ["Cord length: 5 ft"]), ("Height", "in", "5", []), ("Colour", None, "red", [])):
        f = requests.selected_feature(F.lit("k"), F.lit(name), F.lit("number"), F.lit(unit), F.array(F.lit("equals")), F.col("t"))
        assert one(spark, raw, lambda t, f=f: F.transform(briefs.selected_sizes(f), lambda s: s["label"])) == want


def test_patterns_of_specifications_are_literals(spark):
    plan = spark.createDataFrame([("x",)], "t string").select(specs.spec_array(F.col("t")).alias("o"))._jdf.queryExecution().optimizedPlan().toString()
    assert "matcher" not in plan and "around" not in plan
    got = one(spark, "must 300 cfm, under 9 lbs", lambda t: F.transform(specs.spec_array(t), lambda s: F.concat_ws(":", s["id"], s["strictness"])))
    assert got == ["spec-cfm-min-300:hard", "spec-weightLb-max-9:hard"]
