import json

import pytest
from pyspark.sql import functions as F

from briefloom.operators import adjudication, evaluation, quality
from briefloom.sources import json_documents, reports


def test_documents_are_read_by_schema(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.json").write_text(json.dumps({"version": f"v{i}", "cases": [{"id": f"c{i}{j}", "extra": 1} for j in range(2)], "other": True}, indent=1))
    rows = json_documents.read_documents(spark, str(tmp_path), "version string, cases array<struct<id:string>>").select("version", F.explode("cases.id").alias("id"))
    assert sorted(map(tuple, rows.collect())) == [(f"v{i}", f"c{i}{j}") for i in range(3) for j in range(2)]


def test_reports_are_never_overwritten(spark, tmp_path):
    path, df = str(tmp_path / "report"), spark.createDataFrame([(1, "a")], "n int, s string")
    reports.write_new(df, path)
    assert spark.read.json(path).select("n", "s").collect() == df.collect()
    with pytest.raises(Exception, match="(?i)already exists"):
        reports.write_new(df, path)


def test_body_problems(spark):
    bodies = [(b'{"a":1}', "7"), (b'{"a":1}', "x"), (b"{}", "99"), (b"[" + b" " * 50 + b"]", None), (b"\xff{}", None), (b"{", "1"), (None, None)]
    rows = spark.createDataFrame(bodies, "raw binary, n string").select(json_documents.body_problem(F.col("raw"), F.col("n"), 40)).collect()
    assert [r[0] for r in rows][:6] == [None, "invalid_content_length", "too_large", "too_large", "invalid_encoding", "invalid_json"]


def test_markdown(spark):
    df = spark.createDataFrame([("b", 0.5), ("a", None)], "name string, rate double")
    lines = reports.markdown_rows(df.withColumn("rate", reports.percent(F.col("rate"))), ["name", "rate"], ["name"]).collect()
    assert [r["line"] for r in lines] == ["| a | n/a |", "| b | 50.0% |"]


def test_published_ratios(spark):
    """Ratios that are published as counts and as rates."""
    published = [(62, 142, 0.4366), (77, 142, 0.5423), (7, 142, 0.0493), (10, 142, 0.0704), (50, 102, 0.4902), (24, 77, 0.3117), (163, 172, 0.9477), (118, 118, 1.0), (6, 102, 0.0588), (0, 77, 0.0), (1, 0, None)]
    rows = spark.createDataFrame([p[:2] for p in published], "n long, d long").select(quality.ratio(F.col("n"), F.col("d"))).collect()
    assert [r[0] for r in rows] == [p[2] for p in published]


def test_nearest_ranks_against_sorting(spark):
    import math
    import random

    rng = random.Random(4)
    values = [(rng.choice(["a", "b", None]), rng.choice([0.0, -1.5, 3.0, 3.0, rng.uniform(-1e6, 1e6), 1e300, None])) for _ in range(600)] + [("one", 7.0), ("none", None)]
    got = {r["g"]: (r["p50"], r["p95"], r["p0"]) for r in quality.nearest_ranks(spark.createDataFrame(values, "g string, v double"), ["g"], "v", {"p50": 0.5, "p95": 0.95, "p0": 0.0}).collect()}
    for g in ("a", "b", None, "one"):
        own = sorted(v for k, v in values if k == g and v is not None)
        assert got[g] == tuple(own[max(0, math.ceil(len(own) * p) - 1)] for p in (0.5, 0.95, 0.0))
    assert len(got) == 4


def test_evaluation_of_odd_rows(spark):
    """Names without letters, references without aliases, judgments that repeat, runs that no case knows."""
    frame = lambda rows, schema: spark.createDataFrame(rows, schema)
    runs = frame([(1, 200, 5.0), (2, 500, None), (9, 200, 1.0)], "case_id long, status int, duration_ms double")
    cases = frame([(1, "tv", "broad", 2), (2, "tv", "broad_budget", 0)], "case_id long, category string, search_type string, hard_requirements int")
    references = frame([(1, 0, 10, "Café", "X-1", None, 3), (1, 1, 11, "", "Y2", ["y two"], 1), (2, 0, 12, None, None, [None, ""], 2)], "case_id long, ord int, ref_id long, brand string, model string, aliases array<string>, grade int")
    products = frame([(1, 1, "Café X 1 (new)", "u", 5.0, None), (1, 2, "the y-two", None, None, ""), (1, 3, None, None, None, None), (2, 1, "!!", "u", 1.0, "i"), (9, 1, "Café X1", "u", 1.0, "i")], "case_id long, pos int, name string, url string, price double, image string")
    judged = "case_id long, product_name string, seq int, relevance_grade int, violations int, unknowns int, identity_issue string, family_duplicate string, page string, price string, availability string, image string, evidence int"
    judgments = frame([(2, "!!", 1, 0, 1, 1, "none", None, "correct", None, "unknown", "correct", 1), (2, "!!", 2, 3, None, None, None, "x", "wrong", "correct", "unknown", "unknown", 0)], judged)
    funnel = frame([(1, "discovered", "CAFÉ x1"), (1, "deduplicated", "Café X1"), (1, "ranked", "Café X1")], "case_id long, stage string, name string")
    found = {r["metric"]: (r["numerator"], r["denominator"]) for r in evaluation.metrics(runs, cases, references, products, funnel, judgments).collect()}
    assert found["top_result_precision"] == (2, 3) and found["wrong_product_leakage"] == (1, 4) and found["family_duplicate_leakage"] == (1, 4)
    assert found["page_accuracy"] == (0, 1) and found["price_accuracy"] == (1, 1) and found["image_accuracy"] == (0, 0)
    assert found["discovery_recall"] == (1, 2) and found["final_recall"] == (0, 2) and found["request_success"] == (2, 3)
    lost = {r["ref_id"]: r["loss"] for r in evaluation.losses(references, funnel).collect()}
    assert lost == {10: "prefilter_rejection", 12: "never_discovered"}
    told = evaluation.methodology(runs, cases, evaluation.displayed(products, references, judgments), judgments).first()
    assert told["status"] == "INVALID" and told["blockers"][0] == "run_count_mismatch"
    text = frame([("run",)], "t string").select(evaluation.bound_to(F.sha2("t", 256), F.col("t")), evaluation.bound_to(F.lit(None).cast("string"), F.col("t"))).first()
    assert tuple(text) == (True, False)


def test_reports_are_compared_for_the_same_cases(spark):
    frame = lambda ids: spark.createDataFrame(list(enumerate(ids)), "pos int, case_id string")
    assert quality.same_cases(frame("abc"), frame("abc")).count() == 3
    for other in ("acb", "ab", "abcd"):
        with pytest.raises(Exception, match="case ids"):
            quality.same_cases(frame("abc"), frame(other)).collect()
    report = spark.createDataFrame([('{"a":{"b":{"rate":0.5}},"n":3,"s":"x"}',)], "r string")
    assert tuple(report.select(*[quality.measure(F.col("r"), p) for p in ("a.b", "n", "s", "none")]).first()) == (0.5, 3.0, None, None)


def test_evidence_is_capped(spark):
    rows = spark.createDataFrame([(1, 1, ["c", "a", None]), (1, 0, ["a", "b"]), (1, 2, ["d", "e"]), (2, 0, None)], "case_id long, ord int, urls array<string>")
    assert {r["case_id"]: r["urls"] for r in evaluation.evidence_urls(rows).collect()}[1] == ["a", "b", "c", "d"]


def test_files_with_digests_and_broken_ones(spark, tmp_path):
    import hashlib

    good, other = b'{"id": "r1", "runs": [1, 2]}\n', '{"id": "ü", "more": 1}'.encode()
    for name, content in (("a.json", good), ("deep/b.json", other), ("c.json", b"{"), ("d.json", b"\xff\xfe"), ("e.json", b""), ("f.json", b" " * 400)):
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_bytes(content)
    files = json_documents.read_files(spark, str(tmp_path / "in"), "id string, runs array<int>", max_bytes=300)
    rows = {r["path"].rpartition("/")[2]: r for r in files.collect()}
    assert {k: r["problem"] for k, r in rows.items()} == {"a.json": None, "b.json": None, "c.json": "invalid_json", "d.json": "invalid_encoding", "f.json": "too_large"}
    assert rows["a.json"]["sha256"] == hashlib.sha256(good).hexdigest() and rows["a.json"]["document"]["runs"] == [1, 2] and rows["b.json"]["document"]["id"] == "ü"
    assert rows["f.json"]["sha256"] is None and rows["c.json"]["document"] is None and rows["f.json"]["length"] == 400
    plan = files._jdf.queryExecution().executedPlan().toString()
    assert "LessThanOrEqual(length,300)" in plan
    decisions = spark.createDataFrame([(1, hashlib.sha256(good).hexdigest().upper()), (2, "0" * 64), (3, None)], "n int, run string")
    bound = adjudication.with_binding(decisions, files, "run").collect()
    assert sorted((r["n"], r["bound"], (r["path"] or "").rpartition("/")[2]) for r in bound) == [(1, True, "a.json"), (2, False, ""), (3, False, "")]
    assert adjudication.of_bound_runs(decisions.where("n = 1"), files, "run").count() == 1
    with pytest.raises(Exception, match="not bound to a run"):
        adjudication.of_bound_runs(decisions, files, "run").count()


def test_unknown_cases_fail(spark):
    runs, cases = spark.createDataFrame([("a", 1), ("b", 2)], "case_id string, n int"), spark.createDataFrame([("a",), ("b",), ("b",)], "case_id string")
    assert adjudication.of_known_cases(runs, cases, "case_id").count() == 2
    with pytest.raises(Exception, match="unknown case: b"):
        adjudication.of_known_cases(runs, cases.where("case_id = 'a'"), "case_id").select("n").collect()


def test_staged_reports(spark, tmp_path):
    path, df = str(tmp_path / "report"), spark.createDataFrame([(1, "a")], "n int, s string")
    reports.write_staged(df, path)
    with pytest.raises(Exception, match="broken"):
        reports.write_staged(df.withColumn("s", F.raise_error(F.lit("broken"))), path)
    assert spark.read.json(path).select("n", "s").collect() == df.collect() and [p.name for p in tmp_path.iterdir() if "crc" not in p.name] == ["report"]
    reports.write_staged(df.withColumn("n", F.lit(2)), path)
    assert spark.read.json(path).first()["n"] == 2
    for bad in (".env.local", "tests/fixtures/review-radar-live/x", "Tests\\fixtures\\Review-Radar-Live\\x", ".ENV.local/"):
        with pytest.raises(ValueError, match="protected"):
            reports.write_staged(df, f"{tmp_path}/{bad}")


def test_body_is_one_json_value(spark):
    texts = ["12 apples", "true x", '"a" b', "{} x", "[1] y", "1]", "1}", "1,2", '1,"b":2', "", "[1] ", "12", '{"a": [1]}', " null ", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = [r[0] for r in rows.orderBy("i").select(json_documents.is_json(F.col("t"))).collect()]
    assert got == [False] * 10 + [True] * 4 + [None]
    assert [r[0] for r in rows.orderBy("i").select(json_documents.body_problem(F.col("t"))).collect()] == ["invalid_json"] * 10 + [None] * 4 + ["invalid_json"]


def test_body_problems_of_texts_that_begin_like_json(spark, tmp_path):
    import oracle

    from briefloom.plans import queries

    texts = ["12 apples", None, "12", "true to size " * 200, "[1, 2]", "[1]" + " " * 3000, "prose"]
    spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    con = oracle.duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert not oracle.differences(queries.queries()["body_problems"](spark, str(tmp_path)), con, queries.oracle_sql()["body_problems"])
