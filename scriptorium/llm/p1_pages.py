"""Problem 1: the main body of crawled pages, without the site's furniture.

A page is a sequence of flat text blocks (its non-blank lines). Each block is described by its word count, link density and
shape and by the word count and link density of its neighbours (``page_text``); a decision tree trained on a small labelled table
of other sites (``page_labels``) says whether it belongs to the site around the article. The densities of the labelled lines come
from the other labelled pages, as those of new pages do. Pages are classified one by one in Arrow batches: one narrow pass, no
shuffle, so neither a hot site nor the number of pages matters. The tree and the words' odds are broadcast; their size is bounded
by the labelled table. They are fitted once per application.

Defined cases: null, empty and blank pages have no blocks and an empty article; a path that is no http or https URL (in any
letter case) or null is no page; lines are counted from 0 and end at a line feed; a line of white space only is blank;
a document that stands in several rows gives the lines and the article of every row.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.ml.classification import DecisionTreeClassifier
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import spread
from .page_labels import labelled_pages
from .page_text import FEATURES, learn_anchors, page_features

#: Production parameters.
MAX_DEPTH, LEAST = 9, 4

_models: dict[str, tuple] = {}


def labelled_blocks(spark: SparkSession, pages: list | None = None) -> DataFrame:
    """``page``, ``label`` and ``features`` of every block of the labelled pages; a page's densities are learned from the others."""
    pages = pages or labelled_pages()
    rows = []
    for i, (text, labels) in enumerate(pages):
        anchors = learn_anchors(pages[:i] + pages[i + 1 :])
        rows += [(i, float(label), Vectors.dense(f)) for label, f in zip(labels, page_features(text, anchors)[1], strict=True)]
    return spark.createDataFrame(rows, ["page", "label", "features"]).coalesce(1)


def train_tree(blocks: DataFrame, max_depth: int = MAX_DEPTH, least: int = LEAST) -> tuple:
    """The decision tree as nested tuples: (feature, threshold, left, right) or (share of furniture,)."""
    model = DecisionTreeClassifier(impurity="entropy", maxDepth=max_depth, minInstancesPerNode=least, maxBins=512, seed=1).fit(blocks)

    def read(node) -> tuple:
        if node.numDescendants() == 0:
            counts = list(node.impurityStats().stats())
            return (counts[1] / max(1e-9, sum(counts)),)
        return node.split().featureIndex(), node.split().threshold(), read(node.leftChild()), read(node.rightChild())

    return read(model._java_obj.rootNode())


def trained(spark: SparkSession) -> tuple[tuple, dict[str, float]]:
    """Tree and odds of words, fitted once per application."""
    name = spark.sparkContext.applicationId
    if name not in _models:
        _models[name] = train_tree(labelled_blocks(spark)), learn_anchors(labelled_pages())
    return _models[name]


def heldout_report(spark: SparkSession, parts: int = 5) -> DataFrame:
    """Per part of the labelled pages: blocks, precision and recall of a tree trained on the other parts."""
    pages = labelled_pages()
    out = []
    for part in range(parts):
        kept = [page for i, page in enumerate(pages) if i % parts != part]
        tree, anchors = train_tree(labelled_blocks(spark, kept)), learn_anchors(kept)
        said = [(leaf(tree, f) >= 0.5, label) for i, (text, labels) in enumerate(pages) if i % parts == part for label, f in zip(labels, page_features(text, anchors)[1])]
        both, hits, true = sum(h and bool(t) for h, t in said), sum(h for h, _ in said), sum(t for _, t in said)
        out.append((part, len(said), both / max(1, hits), both / max(1, true)))
    return spark.createDataFrame(out, "part int, n_blocks int, precision double, recall double")


def leaf(tree: tuple, features: tuple[float, ...]) -> float:
    while len(tree) > 1:
        tree = tree[2] if features[tree[0]] <= tree[1] else tree[3]
    return tree[0]


def describe(tree: tuple, indent: str = "") -> str:
    """The tree as text, for reading."""
    if len(tree) == 1:
        return f"{indent}{tree[0]:.2f}\n"
    return f"{indent}{FEATURES[tree[0]]} <= {tree[1]:g}\n{describe(tree[2], indent + '  ')}{indent}else\n{describe(tree[3], indent + '  ')}"


def is_page(path: Column) -> Column:
    return path.rlike("(?i)^https?://")


def classified_lines(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``line_no``, ``furniture`` (share at the tree's leaf) of every non-blank line of every page."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(trained(spark))
    pages = documents.where(is_page(F.col("path"))).select("doc_id", F.col("raw_content").cast("string").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, anchors = shared.value
        for batch in batches:
            keys, numbers, shares = [], [], []
            for row, page in enumerate(batch.column(1).to_pylist()):
                lines, features = page_features(page or "", anchors)
                keys += [row] * len(lines)
                numbers += lines
                shares += [leaf(tree, f) for f in features]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), pa.array(numbers, pa.int64()), pa.array(shares, pa.float64())], names=["doc_id", "line_no", "furniture"])

    return spread(pages).mapInArrow(run, "doc_id long, line_no long, furniture double")


def found(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id`` and ``line_no`` of the lines that belong to the site around the article; doc_id is the key of a page."""
    return classified_lines(documents).where(F.col("furniture") >= threshold).select("doc_id", "line_no")


def articles(documents: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``doc_id``, ``article`` (kept lines, with single blank lines between parts), ``kept`` and ``dropped`` lines of every page."""
    spark = documents.sparkSession
    shared = spark.sparkContext.broadcast(trained(spark))
    pages = documents.where(is_page(F.col("path"))).select("doc_id", F.col("raw_content").cast("string").alias("page"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, anchors = shared.value
        for batch in batches:
            texts, kept, dropped = [], [], []
            for page in batch.column(1).to_pylist():
                numbers, features = page_features(page or "", anchors)
                lines = (page or "").split("\n")
                body = [number for number, f in zip(numbers, features) if leaf(tree, f) < threshold]
                parts, last = [], None
                for number in body:
                    if last is not None and number > last + 1:
                        parts.append("")
                    parts.append(lines[number].rstrip("\r").lstrip("﻿"))
                    last = number
                texts.append("\n".join(parts))
                kept.append(len(body))
                dropped.append(len(numbers) - len(body))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(kept, pa.int64()), pa.array(dropped, pa.int64())], names=["doc_id", "article", "kept", "dropped"])

    return spread(pages).mapInArrow(run, "doc_id long, article string, kept long, dropped long")
