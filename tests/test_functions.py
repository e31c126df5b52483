import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.functions import analysis, vectors
from scriptorium.functions import text as T


def apply(spark, value, function):
    return spark.createDataFrame([(value,)], "x string").select(function(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize("value", ["", "one", "a b  c", " lead and trail ", "no break　space", "line\nends\r\nhere", "tab\tand separator", None])
def test_token_estimate_is_python_split(spark, value):
    assert apply(spark, value, T.token_estimate) == (None if value is None else len(value.split()) * 4 // 3)


@pytest.mark.parametrize("value", ["First. Second.", "No period here", ". starts", "Line one.\nLine two. More", "x" * 500, "", "a.\nb"])
def test_first_sentence(spark, value):
    def expected(t):
        for mark in (". ", ".\n"):
            at = t.find(mark)
            if at > 0:
                return t[: at + 1]
        return t[:200]

    assert apply(spark, value, T.first_sentence) == expected(value)


@pytest.mark.parametrize("value", ["  x ", "　y\n", "", "a b"])
def test_strip(spark, value):
    assert apply(spark, value, T.strip) == value.strip()


def test_urls(spark):
    assert apply(spark, "HTTPS://User@Docs.Example:80/Classes/x#part", T.url_host) == "docs.example"
    assert apply(spark, "https://docs.example/a/Classes/x", T.url_kind) == "class_ref"
    assert apply(spark, "https://docs.example/getting_started/x", T.url_kind) == "tutorial"
    assert apply(spark, "src/a.py", T.url_host) is None
    assert apply(spark, "https://a.example/b/#c", T.normal_url) == "https://a.example/b"


def test_paths(spark):
    assert apply(spark, "a/node_modules/b.ts", lambda p: T.outside_directories(p, ["node_modules"])) is False
    assert apply(spark, "a/b/node_modules", lambda p: T.outside_directories(p, ["node_modules"])) is True
    assert apply(spark, "docs/x.md", lambda p: T.included(p, [r"\.md$"], ["docs"])) is False
    assert apply(spark, "Ärger/of:names?.md", T.safe_filename) == "Ärger_of_names_.md"
    assert apply(spark, "src/My.File.py", T.path_suffix) == "py"


def test_titles(spark):
    rows = [("text\n## Real title\nmore", "a.md"), ("plain first line\nmore", "a.md"), ("", "docs/some_file-name.md"), ("#### deep only", "x/y_z.md")]
    got = spark.createDataFrame(rows, "t string, p string").select(T.title_of(F.col("t"), F.col("p")).alias("y")).collect()
    assert [r["y"] for r in got] == ["Real title", "plain first line", "Some File Name", "Y Z"]


def test_vectors(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.standard_normal(8)], [float(x) for x in rng.standard_normal(8)]) for i in range(20)]
    df = spark.createDataFrame(rows, "i int, a array<float>, b array<float>")
    for r in df.select("a", "b", vectors.cosine(F.col("a"), F.col("b")).alias("c")).collect():
        a, b = np.array(r["a"]), np.array(r["b"])
        assert abs(r["c"] - a @ b / np.linalg.norm(a) / np.linalg.norm(b)) < 1e-9
    odd = spark.createDataFrame([([0.0, 0.0],), ([1.0, float("nan")],), ([1.0],), (None,), ([1.0, 2.0],)], "a array<float>")
    assert [r["u"] for r in odd.select(vectors.usable(F.col("a"), 2).alias("u")).collect()] == [False, False, False, False, True]
    fitted = odd.select(vectors.fit(F.col("a"), 3).alias("f")).collect()
    assert fitted[2]["f"] == [1.0, 0.0, 0.0] and fitted[3]["f"] is None
    assert np.isnan(odd.where(F.size("a") == 2).limit(1).select(vectors.cosine(F.col("a"), vectors.literal([1, 2])).alias("c")).first()["c"])


@pytest.mark.parametrize("word", ["queries", "caches", "buffers", "class", "bus", "gas", "shoes", "lies", "is", "trees", "eyes"])
def test_stemmer_is_the_same_on_both_sides(spark, word):
    assert apply(spark, word, lambda x: F.concat_ws(",", analysis.terms(x))) == ("" if word in analysis.STOP_WORDS else analysis.stem_text(word))
