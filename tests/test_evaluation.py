import re
import unicodedata

from pyspark.sql import functions as F

from briefloom.functions import titles
from briefloom.operators import evaluation
from briefloom.operators.stored import stored_by


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_relations_dealt_by_case_are_not_shuffled(spark):
    """Products, their references, judgments and losses meet by case: none of them is shuffled again, or goes through Python."""
    ids = spark.range(40).selectExpr("id % 8 AS case_id", "cast(id div 8 AS int) AS pos", "id")
    dealt = lambda df: stored_by(df.repartition(4, "case_id"), "case_id", 4)
    products = dealt(ids.selectExpr("case_id", "pos", "concat('Acme XQ-', id) AS name"))
    references = dealt(ids.selectExpr("case_id", "pos AS ord", "id AS ref_id", "'ACME' AS brand", "concat('xq', id) AS model", "cast(null AS array<string>) AS aliases", "3 AS grade"))
    judgments = dealt(ids.selectExpr("case_id", "concat('Acme XQ-', id) AS product_name", "pos AS seq", "pos AS relevance_grade"))
    funnel = dealt(ids.where("pos < 4").selectExpr("case_id", "array('discovered', 'deduplicated') AS stages", "concat('acme xq', id) AS name"))
    shown, lost = evaluation.displayed(products, references, judgments), evaluation.losses(references, funnel)
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for df in (shown, lost):
            assert "Exchange" not in plan(df) and "EvalPython" not in plan(df)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    # xq1 is also stated by XQ-17, XQ-33 and so on: the first reference counts
    rows = shown.select("case_id", "pos", "reference.ref_id", "judgment.relevance_grade").collect()
    assert len(rows) == 40 and {(r["case_id"], r["pos"]): r["relevance_grade"] for r in rows} == {(i % 8, i // 8): i // 8 for i in range(40)}
    assert all(r["ref_id"] == min(i for i in range(r["case_id"], 40, 8) if f"xq{i}" in f"xq{r['pos'] * 8 + r['case_id']}") for r in rows)
    assert {r["ref_id"]: r["loss"] for r in lost.collect()} == {i: "prefilter_rejection" if i < 32 else "never_discovered" for i in range(40)}


def test_stages_may_be_rows_or_lists(spark):
    references = spark.createDataFrame([(1, 0, 10, "A", "x1", None, 2), (1, 1, 11, "A", "x2", ["y2"], 2), (2, 0, 12, "A", "x3", None, 2)], "case_id long, ord int, ref_id long, brand string, model string, aliases array<string>, grade int")
    funnel = spark.createDataFrame([(1, "discovered", "a x1"), (1, "discovered", "A X1"), (1, "deduplicated", "a x-1"), (1, "discovered", "a y2"), (1, "discovered", None)], "case_id long, stage string, name string")
    lists = funnel.groupBy("case_id", "name").agg(F.collect_list("stage").alias("stages"))
    want = {10: "prefilter_rejection", 11: "candidate_deduplication", 12: "never_discovered"}
    for given in (funnel, lists):
        assert {r["ref_id"]: r["loss"] for r in evaluation.losses(references, given).collect()} == want
    hits = evaluation.identified(funnel.select("case_id", "name"), references).collect()
    assert sorted((r["name"], r["ref_id"]) for r in hits) == [("A X1", 10), ("a x-1", 10), ("a x1", 10), ("a y2", 11)]


def test_references_of_a_registry(spark):
    registry = spark.createDataFrame([(1, "A", 2), (2, "B", 3)], "ref_id long, brand string, grade int")
    cases = spark.createDataFrame([(7, [2, 9, 1])], "case_id long, reference_ids array<long>")
    rows = evaluation.case_references(cases, registry).collect()
    assert sorted((r["case_id"], r["ord"], r["ref_id"], r["brand"]) for r in rows) == [(7, 0, 2, "B"), (7, 2, 1, "A")]


def test_names_are_folded_as_by_decomposition(spark):
    """Every fold of Spark's own functions against Unicode's decomposition."""
    said = ["Café™ X", "ﬁne ½ ㎏", "Ａ１ ①⑽ ²", "éa ẚ Å K", "漢字 x", "ǅ ŉ …a", "", "plain - ascii.1", "𝐀𝟙 x", "ạ́b"]
    said += [f"a{chr(c)}b{chr(c)}1" for c in (*range(0x80, 0x250), *range(0x1E00, 0x1F00), *range(0x2000, 0x2200), *range(0x3200, 0x3400), *range(0xFB00, 0xFB07), *range(0xFF00, 0xFF60))]
    rows = spark.createDataFrame([(s,) for s in said], "t string").select("t", titles.evaluated(F.col("t")).alias("e")).collect()
    for r in rows:
        assert r["e"] == re.sub("[^a-z0-9]+", " ", unicodedata.normalize("NFKD", r["t"]).lower()).strip(" "), r["t"]
