"""Plans: what is shuffled, and what reaches the scan."""

import pytest

from scriptorium.llm import p1_pages, p4_sources, p6_encoding, p7_leaks, p8_abuse


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def documents(spark, data, tmp_path_factory):
    """The documents in as many files as a scan needs to keep all cores busy."""
    target = str(tmp_path_factory.mktemp("docs") / "documents")
    spark.read.parquet(f"{data}/documents.parquet").repartition(16).write.parquet(target)
    spark.conf.set("spark.sql.files.openCostInBytes", "64m")
    yield spark.read.parquet(target)
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_narrow_operators_shuffle_nothing(spark, documents):
    model = {"bias": -8.0, "words": {}, "pairs": {}, "signals": {}}
    for df in (p1_pages.found(documents), p6_encoding.encode_corpus(documents), p8_abuse.score_documents(documents, model), p4_sources.judged_files(documents)):
        assert "Exchange" not in plan(df)


def test_only_needed_columns_are_read(spark, documents):
    schema = plan(p6_encoding.encode_corpus(documents)).split("ReadSchema: ")[1].split("\n")[0]
    assert "raw_content" not in schema and "text" in schema
    assert "StringContains" in plan(p4_sources.judged_files(documents)) or "RLIKE" in plan(p4_sources.judged_files(documents)) or "rlike" in plan(p4_sources.judged_files(documents)).lower()


def test_leak_matches_read_the_corpus_once(spark, documents, data):
    """What follows the meeting works on the written documents that met an item; the corpus is not read or shuffled again."""
    text = plan(p7_leaks.leak_matches(documents, spark.read.parquet(f"{data}/eval_items.parquet")))
    assert "raw_content" not in text and "/docs" not in text and "table-" in text
