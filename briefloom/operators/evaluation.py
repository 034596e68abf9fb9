"""Evaluation of search runs: identities of displayed products, losses of references, metrics and their breakdown.

Relations, one row each:

- runs (case_id, status, duration_ms, and counters that are summed), cases (case_id, category, search_type, hard_requirements)
- references (case_id, ord, ref_id, brand, model, aliases, grade): a case's references in order
- products (case_id, pos, name, url, price, image): what a run displayed, from position 1 on
- judgments (case_id, product_name, seq, relevance_grade, violations, unknowns, identity_issue, family_duplicate, page, price, availability, image, evidence): the last by seq counts
- funnel (case_id, stage, name): candidates by stage; or (case_id, stages, name), with the list of a candidate's stages
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.titles import evaluated
from . import quality, shortlist
from .stored import stored, stored_by

# Stages of the funnel in order, and what not reaching each is called.
STAGES = (
    ("discovered", "never_discovered"), ("deduplicated", "candidate_deduplication"), ("prefiltered", "prefilter_rejection"), ("marketCompatible", "merchant_or_market_filter"),
    ("ranked", "candidate_truncation_or_ranking"), ("verified", "page_or_commerce_verification"), ("returned", "final_selection_crowd_out"),
)
#: Grade from which a reference or a result is strong.
STRONG = 2


def case_references(cases: DataFrame, registry: DataFrame) -> DataFrame:
    """References (case_id, ord, and the registry's columns) of cases (case_id, reference_ids); ids that the registry lacks are left out."""
    listed = cases.select("case_id", F.posexplode("reference_ids").alias("ord", "ref_id"))
    return listed.join(registry, "ref_id").select("case_id", "ord", "ref_id", *[c for c in registry.columns if c != "ref_id"])


def _tight(c: Column) -> Column:
    return F.replace(c, F.lit(" "), F.lit(""))


def _named(names: DataFrame) -> DataFrame:
    own = names.withColumn("_name", evaluated(F.coalesce("name", F.lit(""))))
    return own.withColumn("_tight", _tight(F.col("_name")))


def _stating(references: DataFrame) -> DataFrame:
    """References with what states them: ``_brand``, and ``_as`` for each model or alias. Those that nothing states have no ``_as``."""
    every = F.concat(F.array("model"), F.coalesce("aliases", F.array().cast("array<string>")))
    forms = F.filter(F.transform(every, lambda a: evaluated(F.coalesce(a, F.lit("")))), lambda a: a != "")
    return references.withColumn("_brand", evaluated(F.coalesce("brand", F.lit("")))).withColumn("_as", F.transform(forms, lambda a: F.struct(a.alias("words"), _tight(a).alias("tight"))))


def _states(name: Column, tight: Column, brand: Column, forms: Column) -> Column:
    return F.contains(name, brand) & F.exists(forms, lambda a: F.contains(name, a["words"]) | F.contains(tight, a["tight"]))


def identified(names: DataFrame, references: DataFrame) -> DataFrame:
    """``names`` (case_id, name, ...) joined to each reference of the case that the name states: its brand, and its model or an alias, as words or run together.

    Adds ord, ref_id, brand, grade. An equi join by case with a residual condition; cases are short.
    """
    stated = _stating(references).select("case_id", "ord", "ref_id", "brand", "grade", "_brand", "_as")
    hits = _named(names).join(stated, "case_id").where(_states(*map(F.col, ("_name", "_tight", "_brand", "_as"))))
    return hits.drop("_name", "_tight", "_brand", "_as").distinct()


def displayed(products: DataFrame, references: DataFrame, judgments: DataFrame) -> DataFrame:
    """``products`` with ``reference`` (ref_id, brand, grade: the first that the name states) and ``judgment`` (the last of the case and name); null for none.

    A case's references and judgments meet its products as lists: every join is by case alone, so that relations that
    are dealt by case are not shuffled.
    """
    stated = _stating(references.where("ord is not null")).groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("ord", "ref_id", "brand", "grade", "_brand", "_as"))).alias("_references"))
    last = shortlist.latest(judgments, ["case_id", "product_name"], "seq")
    last = last.groupBy("case_id").agg(F.collect_list(F.struct("product_name", F.struct(*[c for c in last.columns if c not in ("case_id", "product_name")]).alias("judgment"))).alias("_judgments"))
    rows = _named(products).join(stated, "case_id", "left").join(last, "case_id", "left")
    first = F.get(F.filter("_references", lambda r: _states(F.col("_name"), F.col("_tight"), r["_brand"], r["_as"])), F.lit(0))
    judged = F.get(F.filter("_judgments", lambda j: j["product_name"] == F.col("name")), F.lit(0))
    out = rows.withColumn("_first", first).select(*products.columns, F.when(F.col("_first").isNotNull(), F.struct(*[F.col("_first")[c].alias(c) for c in ("ref_id", "brand", "grade")])).alias("reference"), judged["judgment"].alias("judgment"))
    return out


def losses(references: DataFrame, funnel: DataFrame) -> DataFrame:
    """(case_id, ord, ref_id, loss) of strong references: the first stage whose candidates don't name it, else ``returned``.

    A case's candidates meet its references as a list, joined by case alone. A funnel may hold a candidate's stages as a
    list, in a column ``stages`` in place of ``stage``.
    """
    strong = _stating(references.where(F.col("grade") >= STRONG))
    names = funnel if "stages" in funnel.columns else funnel.groupBy("case_id", "name").agg(F.collect_set("stage").alias("stages"))
    names = _named(names).groupBy("case_id").agg(F.collect_list(F.struct("_name", "_tight", "stages")).alias("_names"))
    hits = F.filter("_names", lambda n: _states(n["_name"], n["_tight"], F.col("_brand"), F.col("_as")))
    seen = strong.join(names, "case_id", "left").withColumn("_seen", F.array_distinct(F.flatten(F.transform(hits, lambda n: n["stages"]))))
    loss = quality.loss_stage([(F.array_contains("_seen", s), name) for s, name in STAGES])
    return seen.select("case_id", "ord", "ref_id", loss.alias("loss"))


def loss_counts(lost: DataFrame) -> DataFrame:
    """(loss, n), most frequent first; ties in the order of the first case and reference that has them."""
    counts = lost.groupBy("loss").agg(F.count("*").alias("n"), F.min(F.struct("case_id", "ord")).alias("first"))
    return counts.orderBy(F.desc("n"), "first").select("loss", "n")


def _grades() -> tuple[Column, Column]:
    return F.col("reference.grade"), F.col("judgment.relevance_grade")


def per_case(runs: DataFrame, cases: DataFrame, shown: DataFrame, lost: DataFrame, references: DataFrame) -> DataFrame:
    """One row per run of a known case: category, search_type, duration_ms, ndcg, and counts of products and references."""
    given, judged = _grades()
    graded = shown.withColumn("grade", F.coalesce(given, judged))
    ndcg = quality.ndcg(graded, ["case_id"], "pos", "grade", references, "grade")
    counted = graded.groupBy("case_id").agg(F.count("*").alias("displayed"), F.count_if(F.col("grade") >= STRONG).alias("strong"))
    found = lost.groupBy("case_id").agg(F.count("*").alias("references"), F.count_if(F.col("loss") == "returned").alias("returned"), F.count_if(F.col("loss") != STAGES[0][1]).alias("discovered"))
    rows = runs.join(cases.select("case_id", "category", "search_type"), "case_id").select("case_id", "category", "search_type", "status", "duration_ms")
    rows = rows.join(counted, "case_id", "left").join(found, "case_id", "left").join(ndcg, "case_id", "left")
    return rows.na.fill(0, ["displayed", "strong", "references", "returned", "discovered"])


def case_breakdown(rows: DataFrame, by: str) -> DataFrame:
    """``per_case`` rows by a column: cases, displayed and empty results, recalls, precision, mean NDCG and latency percentiles."""
    r = quality.ratio
    out = rows.groupBy(by).agg(
        F.count("*").alias("cases"), F.sum("displayed").alias("displayed"), F.count_if(F.col("displayed") == 0).alias("empty"), r(F.sum("returned"), F.sum("references")).alias("final_recall"),
        r(F.sum("discovered"), F.sum("references")).alias("discovery_recall"), r(F.sum("strong"), F.sum("displayed")).alias("precision"), F.round(F.avg("ndcg"), 4).alias("ndcg"),
    )
    timed = quality.nearest_ranks(rows, [by], "duration_ms", {"p50": 0.5, "p95": 0.95})
    return out.join(timed.withColumnRenamed(by, "_by"), F.col(by).eqNullSafe(F.col("_by")), "left").drop("_by").na.fill(0, ["p50", "p95"])


def _metric(name: str, num: Column, den: Column) -> Column:
    return F.struct(F.lit(name).alias("metric"), num.cast("long").alias("numerator"), den.cast("long").alias("denominator"), quality.ratio(num, den).alias("rate"))


def _count(shown: DataFrame, field: str) -> Column:
    """A judgment's number of violations or unknowns, which may be listed by name or counted."""
    c = F.col(f"judgment.{field}")
    listed = isinstance(shown.schema["judgment"].dataType[field].dataType, T.ArrayType)
    return F.greatest(F.coalesce(F.size(c) if listed else c, F.lit(0)), F.lit(0))


def case_lines(rows: DataFrame, shown: DataFrame, lost: DataFrame) -> DataFrame:
    """``per_case`` rows with losses ("stage:n, ...") and issues ("#position issue, ..."), "none" where there are none."""
    counted = lost.where("loss <> 'returned'").groupBy("case_id", "loss").agg(F.count("*").alias("n"), F.min("ord").alias("first"))
    told = counted.groupBy("case_id").agg(F.sort_array(F.collect_list(F.struct("first", F.concat_ws(":", "loss", "n").alias("said")))).alias("_losses"))
    j = lambda c: F.col(f"judgment.{c}")
    names = F.array_join(j("violations"), "+") if isinstance(shown.schema["judgment"].dataType["violations"].dataType, T.ArrayType) else j("violations").cast("string")
    found = [F.when(~j("identity_issue").isin("none", "unknown", ""), j("identity_issue")), F.when(j("family_duplicate") != "", F.lit("family_duplicate")), F.when(_count(shown, "violations") > 0, F.concat(F.lit("hard_fail:"), names))]
    found += [F.when(j(c) == "incorrect", F.lit(f"bad_{c}")) for c in ("price", "page", "image")]
    each = shown.select("case_id", "pos", F.transform(F.array_compact(F.array(*found)), lambda x: F.concat(F.lit("#"), F.col("pos").cast("string"), F.lit(" "), x)).alias("said")).where(F.size("said") > 0)
    issues = each.groupBy("case_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("pos", "said"))), lambda x: x["said"])).alias("_issues"))
    out = rows.join(told, "case_id", "left").join(issues, "case_id", "left")
    none = F.lit("none")
    return out.select(*rows.columns, F.coalesce(F.array_join("_losses.said", ", "), none).alias("losses"), F.coalesce(F.array_join("_issues", ", "), none).alias("issues"))


def evidence_urls(references: DataFrame, most: int = 4) -> DataFrame:
    """(case_id, urls): the first distinct links of a case's references (case_id, ord, urls), in order."""
    every = references.groupBy("case_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("ord", "urls"))), lambda x: x["urls"])).alias("urls"))
    return every.select("case_id", F.slice(F.array_distinct(F.filter("urls", lambda u: u.isNotNull())), 1, most).alias("urls"))


def product_metrics(shown: DataFrame, cases: DataFrame) -> DataFrame:
    """(metric, numerator, denominator, rate) of displayed products, from one aggregation."""
    given, judged = _grades()
    has, j = F.col("judgment").isNotNull(), lambda c: F.col(f"judgment.{c}")
    told = F.coalesce(given.isin(1) | (given >= STRONG), F.lit(False))
    strong = F.coalesce(given >= STRONG, F.lit(False)) | (~told & F.coalesce(judged >= STRONG, F.lit(False)))
    issue = has & ~F.coalesce(j("identity_issue").isin("none", "unknown"), F.lit(False))
    rows = shown.join(cases.select("case_id", "search_type", "hard_requirements"), "case_id")
    asked = F.sum(F.when(has, F.col("hard_requirements")).otherwise(0))
    violated, unknown = (F.sum(F.when(has, _count(shown, c)).otherwise(0)) for c in ("violations", "unknowns"))
    known = lambda c: has & ~(F.coalesce(j(c), F.lit("")) == "unknown")
    right = lambda c: has & F.coalesce(j(c) == "correct", F.lit(False))
    n, broad, matched = F.count_if, F.col("search_type") == "broad", F.col("reference").isNotNull()
    counts = {"shown": F.count("*"), "judged": n(told | judged.isNotNull()), "strong": n(strong), "wrong": n(issue), "family": n(has & F.coalesce(j("family_duplicate") != "", F.lit(False))), "asked": asked, "violated": violated, "unknown": unknown}
    for c in ("page", "price", "availability"):
        counts |= {f"{c}_known": n(known(c)), f"{c}_right": n(right(c))}
    pictured = F.coalesce(F.col("image") != "", F.lit(False))
    counts |= {"image_known": n(pictured & known("image")), "image_right": n(pictured & right("image"))}
    counts |= {"broad_strong": n(broad & (matched | F.coalesce(judged >= STRONG, F.lit(False)))), "broad_judged": n(broad & (matched | judged.isNotNull()))}
    one = rows.agg(*[F.coalesce(x, F.lit(0)).alias(name) for name, x in counts.items()])
    c = F.col
    found = [
        _metric("wrong_product_leakage", c("wrong"), c("shown")), _metric("family_duplicate_leakage", c("family"), c("shown")), _metric("top_result_precision", c("strong"), c("judged")),
        _metric("hard_requirement_violations", c("violated"), c("asked")), _metric("hard_requirement_unknowns", c("unknown"), c("asked")),
        _metric("hard_requirement_accuracy", F.greatest(F.lit(0), c("asked") - c("violated") - c("unknown")), c("asked")),
        *[_metric(f"{x}_accuracy", c(f"{x}_right"), c(f"{x}_known")) for x in ("page", "price", "availability", "image")],
        _metric("broad_precision", c("broad_strong"), c("broad_judged")),
    ]
    return one.select(F.inline(F.array(*found)))


def exact_duplicates(shown: DataFrame) -> DataFrame:
    """The metric of products that repeat a name and link within their case."""
    per = shown.groupBy("case_id").agg(F.count("*").alias("n"), F.count_distinct(F.concat_ws("|", *[evaluated(F.coalesce(c, F.lit(""))) for c in ("name", "url")])).alias("k"))
    return per.agg(F.coalesce(F.sum(F.col("n") - F.col("k")), F.lit(0)).alias("again"), F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(F.inline(F.array(_metric("exact_duplicate_leakage", F.col("again"), F.col("n")))))


def recall_metrics(lost: DataFrame, cases: DataFrame) -> DataFrame:
    """Final and discovery recall of strong references, over all cases and over broad ones."""
    rows, broad = lost.join(cases.select("case_id", "search_type"), "case_id"), F.col("search_type") == "broad"
    kept, met = F.col("loss") == "returned", F.col("loss") != STAGES[0][1]
    n = F.count_if
    one = rows.agg(F.count("*").alias("all"), n(kept).alias("kept"), n(met).alias("met"), n(broad).alias("broad"), n(broad & kept).alias("broad_kept"), n(broad & met).alias("broad_met"))
    c = F.col
    return one.select(F.inline(F.array(_metric("final_recall", c("kept"), c("all")), _metric("discovery_recall", c("met"), c("all")), _metric("broad_final_recall", c("broad_kept"), c("broad")), _metric("broad_discovery_recall", c("broad_met"), c("broad")))))


def brand_coverage(runs: DataFrame, cases: DataFrame, shown: DataFrame, references: DataFrame) -> DataFrame:
    """Over broad cases that ran: distinct brands of strong references, and those of them that a product's first reference has."""
    broad = runs.select("case_id").join(cases.where("search_type = 'broad'").select("case_id"), "case_id", "left_semi")
    named = lambda rows, brand, grade: rows.join(broad, "case_id", "left_semi").where(F.col(grade) >= STRONG).agg(F.count_distinct(evaluated(F.coalesce(brand, F.lit("")))).alias("n"))
    # one row each
    both = named(shown, "reference.brand", "reference.grade").withColumnRenamed("n", "back").crossJoin(named(references, "brand", "grade"))
    return both.select(F.inline(F.array(_metric("broad_brand_coverage", F.col("back"), F.col("n")))))


def inversion_pairs(shown: DataFrame, cases: DataFrame) -> DataFrame:
    """(case_id, inverted, pairs) of cases with a budget: cheaper and weaker products that stand ahead, and all pairs of unlike strength."""
    given, judged = _grades()
    rows = shown.join(cases.where("search_type = 'broad_budget'").select("case_id"), "case_id", "left_semi").withColumn("grade", F.coalesce(given, judged))
    return quality.inversions(rows, ["case_id"], "pos", "price", "grade")


def budget_metrics(pairs: DataFrame) -> DataFrame:
    """The metric of inversions, with the cases that have one (inversion_cases)."""
    one = pairs.agg(F.coalesce(F.sum("inverted"), F.lit(0)).alias("inverted"), F.coalesce(F.sum("pairs"), F.lit(0)).alias("pairs"), F.count_if(F.col("inverted") > 0).alias("cases"))
    return one.select(F.inline(F.array(_metric("price_inversions", F.col("inverted"), F.col("pairs")), _metric("inversion_cases", F.col("cases"), F.lit(0)))))


def run_metrics(runs: DataFrame) -> DataFrame:
    one = runs.agg(F.count_if(F.col("status") == 200).alias("good"), F.count("*").alias("n"))
    return one.select(F.inline(F.array(_metric("request_success", F.col("good"), F.col("n")))))


def metrics(runs: DataFrame, cases: DataFrame, references: DataFrame, products: DataFrame, funnel: DataFrame, judgments: DataFrame, buckets: int | None = None) -> DataFrame:
    """All metrics as (metric, numerator, denominator, rate), rates with four decimals, null over nothing. Runs of unknown cases count as runs alone.

    buckets: the number of parts that the relations are dealt to by case_id, if they are; what is stored here then is too.
    """
    known = runs.join(cases.select("case_id"), "case_id", "left_semi")
    here = lambda df: df.join(known.select("case_id"), "case_id", "left_semi")
    keep = lambda df: stored_by(df, "case_id", buckets) if buckets else stored(df)
    # every metric reads them
    shown, lost = keep(displayed(here(products), references, judgments)), keep(losses(here(references), funnel))
    parts = [product_metrics(shown, cases), exact_duplicates(shown), recall_metrics(lost, cases), brand_coverage(known, cases, shown, references), budget_metrics(inversion_pairs(shown, cases)), run_metrics(runs)]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def finite(c: Column) -> Column:
    """A number, or 0 if there is none."""
    c = c.cast("double")
    return F.when(c.isNull() | F.isnan(c) | F.abs(c).eqNullSafe(F.lit(float("inf"))), 0.0).otherwise(c)


def totals(runs: DataFrame, counters: Sequence[str]) -> DataFrame:
    """One row: sums of the counters over successful runs; missing ones are 0."""
    return runs.where("status = 200").agg(*[F.coalesce(F.sum(finite(F.col(c))), F.lit(0.0)).alias(c) for c in counters])


def bound_to(given: Column, text: Column) -> Column:
    """Whether a digest is the SHA-256 of a text, in lowercase hexadecimal digits."""
    return given.eqNullSafe(F.sha2(text.cast("binary"), 256))


def methodology(runs: DataFrame, cases: DataFrame, shown: DataFrame, judgments: DataFrame, bound: bool | None = None) -> DataFrame:
    """One row (attempts, unadjudicated, debatable, blockers, status): what forbids to call a report valid, in order.

    bound: whether the judgments name the digest of these runs (``bound_to``); None where there are no judgments to bind.
    """
    given, judged = _grades()
    told = F.coalesce(given.isin(1) | (given >= STRONG), F.lit(False)) | judged.isNotNull()
    one = runs.agg(F.count("*").alias("attempts")).crossJoin(cases.agg(F.count("*").alias("planned")))
    one = one.crossJoin(shown.agg(F.count("*").alias("displayed"), F.count_if(~told).alias("unadjudicated")))
    one = one.crossJoin(judgments.agg(F.count("relevance_grade").alias("complete"), F.count_if(F.col("evidence") > 0).alias("evidenced"), F.count_if(F.col("relevance_grade") == 1).alias("debatable")))
    tests = [
        (F.col("attempts") != F.col("planned"), "run_count_mismatch"), (F.col("complete") != F.col("displayed"), "displayed_product_adjudication_incomplete"),
        (F.col("evidenced") != F.col("displayed"), "displayed_product_evidence_binding_incomplete"), (F.lit(bound is False), "adjudication_run_binding_mismatch"),
    ]
    blockers = F.filter(F.array(*[F.when(t, F.lit(name)) for t, name in tests]), lambda b: b.isNotNull())
    return one.select("attempts", "unadjudicated", "debatable", blockers.alias("blockers"), F.when(F.size(blockers) == 0, "VALID").otherwise("INVALID").alias("status"))
