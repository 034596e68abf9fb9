import corpus_pipeline
import oracle
import pytest

from briefloom.llm import oracles, queries

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(oracles.oracle_sql()))
def test_query_against_sql(spark, name):
    assert not oracle.differences(queries.queries()[name](spark, SF), oracle.connect(SF), oracles.oracle_sql()[name])


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_duplicates", "substrings", "mix", "pack"]
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, SF).cache()
        if i < 4:
            assert out.schema.names == docs.schema.names and [f.dataType for f in out.schema] == [f.dataType for f in docs.schema], name
        if i < 3:
            assert 0 < out.count() <= docs.count() and out.select("doc_id").distinct().count() == out.count()
            assert out.join(docs, "doc_id", "left_anti").count() == 0
        docs = out
    ends = docs.groupBy("sequence_id").sum("length").collect()
    assert max(r[1] for r in ends) <= 2048
    assert corpus_pipeline.STAGES[0][1](spark, spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 0"), SF).count() == 0


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and extra columns with names that stages use."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, piece int, spans string, size long"
    long = " ".join(f"w{i % 7919}" for i in range(60_000))
    text = "a plain document of some words that say what they say in a sentence or two"
    rows = [(1, text, "en", "a", 74), (1, text, "en", "a", 74), (2, None, "en", "a", None), (3, "", None, None, 0), (None, "no key but words", "en", "b", 16), (5, long, "de", None, len(long)), (6, long + " end", "de", "b", None), (7, "x", None, "b", 1), (8, None, None, None, None)]
    labels = [(1, 1, 0), (2, None, None), (None, 0, 1), (5, 1, None), (99, 0, 1)]
    pages = [(1, "http://a.com/en/1", None), (2, None, None), (None, "https://b.org/de/5", ""), (4, "no url", "")]
    sf = str(tmp_path)
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{sf}/pages.parquet")
    docs = spark.createDataFrame([(*r, 1, "s", 2) for r in rows], schema)
    kept = []
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, sf).cache()
        kept.append(docs.count())
        if i < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"], name
    assert kept[0] == 9 and kept[1] == 8  # the longer text has a near copy
    assert docs.where("length > 2048 or offset + length > 2048").count() == 0
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, sf)
        assert empty.count() == 0
