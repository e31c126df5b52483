"""Problem 4: source files that nobody wrote by hand for their project.

Vendored edits are found by exact containment: known third-party files are cut into normalised lines, and a source file that holds
at least ``contained`` of one known file's lines is a copy of it, whatever was changed, added or moved around. Known are the files of
the upstream table and, across repositories, those files of the corpus that their place or text marks as third-party: an unmarked
copy of such a file in another source is found through them (``cross_contained``, a little stricter). The index holds each known
file's rarest lines: as many as a file must miss before it can fall below the wanted containment, so no copy is lost, however many
packages ship the same lines. Candidates are then counted exactly over all lines. The remaining files are judged one by one by
markers and token composition (see ``source_text``): generated, minified or bundled, data, vendored by place or text.

Scale: lines are normalised, hashed and made distinct per file where they are read; known files with the same lines form one class.
Rarity is counted over all known classes, so hot lines stand in the index only for classes with nothing rarer. Spark broadcasts the
index when its measured size allows, and else shuffles both sides on the hash behind a runtime Bloom filter.

Defined cases: null paths and paths without a source suffix are no source files; null and empty contents are judged by place
only; lines without a letter or digit don't count, and known files with fewer than ``least`` other lines have no copies; repeated
rows give their own result rows; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed, spread
from .source_text import SUFFIXES, reasons

#: Production parameters.
CONTAINED, CROSS_CONTAINED, LEAST = 0.5, 0.8, 5


def is_source_file(path: Column) -> Column:
    """Path with a source suffix that is not an http or https URL."""
    return path.rlike(rf"(?i)\.({'|'.join(SUFFIXES)})$") & ~path.rlike("(?i)^https?://")


def line_hashes(content: Column) -> Column:
    """Distinct hashes of the lines of a text that hold a letter or digit, white space made uniform."""
    lines = F.transform(F.split(content, "\n"), lambda line: F.trim(F.regexp_replace(line, r"\s+", " ")))
    return F.array_distinct(F.transform(F.filter(lines, lambda line: line.rlike(r"[\p{L}\p{N}]")), lambda line: F.xxhash64(line)))


def known_classes(files: DataFrame, least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """Classes of known files with the same lines (``class``, ``lines``) and the members of each (``class`` and the files' other columns).

    ``files`` has ``lines``, distinct hashes of the file.
    """
    hashed = files.where(F.size("lines") >= least).withColumn("class", F.xxhash64(F.array_sort("lines")))
    return hashed.groupBy("class").agg(F.first("lines").alias("lines")), hashed.drop("lines")


def rare_line_index(classes: DataFrame, contained: float) -> DataFrame:
    """``line`` and ``class``: of every class of n lines the n - ceil(contained * n) + 1 rarest, ties by hash.

    A file that shares ceil(contained * n) lines with the class shares one of these.
    """
    lines = classes.select("class", F.size("lines").alias("n"), F.explode("lines").alias("line"))
    seen = lines.groupBy("line").agg(F.count("*").alias("seen"))
    place = F.row_number().over(Window.partitionBy("class").orderBy("seen", "line"))
    return lines.join(seen, "line").withColumn("place", place).where(F.col("place") <= F.col("n") - F.ceil(F.col("n") * contained) + 1).select("line", "class")


def contained_files(files: DataFrame, classes: DataFrame, contained: float) -> DataFrame:
    """``doc_id``, ``class`` and ``containment`` of every class that a file (``doc_id``, ``lines``) holds for the most part.

    Candidates come from the index; their containment is counted over all lines of the class, in the JVM.
    """
    met = files.select("doc_id", F.explode("lines").alias("line")).join(rare_line_index(classes, contained), "line").select("doc_id", "class").distinct()
    pairs = met.join(classes.withColumnRenamed("lines", "wanted"), "class").join(files, "doc_id")
    share = F.size(F.array_intersect("wanted", "lines")) / F.size("wanted")
    return pairs.select("doc_id", "class", share.alias("containment")).where(F.col("containment") >= contained).groupBy("doc_id", "class").agg(F.max("containment").alias("containment"))


def source_lines(documents: DataFrame) -> DataFrame:
    """``doc_id``, ``source`` and ``lines`` of every source file."""
    return documents.where(is_source_file(F.col("path"))).select("doc_id", F.col("source").cast("string").alias("source"), line_hashes(F.col("raw_content").cast("string")).alias("lines"))


def upstream_copies(documents: DataFrame, upstream: DataFrame, contained: float = CONTAINED) -> DataFrame:
    """``doc_id``, ``file_id`` and ``containment`` of every known file that a source file holds for the most part."""
    files = upstream.where(F.col("file_id").isNotNull()).select("file_id", line_hashes(F.col("content").cast("string")).alias("lines"))
    classes, members = known_classes(files)
    found = contained_files(source_lines(documents).select("doc_id", "lines"), classes, contained)
    return found.join(members, "class").select("doc_id", "file_id", "containment").distinct()


def repository_copies(documents: DataFrame, judged: DataFrame, contained: float = CROSS_CONTAINED) -> DataFrame:
    """``doc_id``, ``class``, ``n_sources`` (that mark a file of the class) and ``containment`` of source files that hold a file which
    another source marks as third-party.

    ``judged`` are the files' own reasons. One row for each file and class of equal marked files.
    """
    files = checkpointed(source_lines(documents))
    marked = judged.where(F.array_contains("reasons", "vendored")).select("doc_id").distinct()
    classes, members = known_classes(files.join(marked, "doc_id", "left_semi"))
    owners = members.groupBy("class").agg(F.count_distinct("source").alias("n_sources"), F.min("source").alias("one"))
    held = contained_files(files.select("doc_id", "lines"), classes, contained).join(files.select("doc_id", "source").distinct(), "doc_id").join(owners, "class")
    # a class that only the file's own source marks says nothing about it
    elsewhere = (F.col("n_sources") > 1) | ~F.col("one").eqNullSafe(F.col("source"))
    return held.where(elsewhere).select("doc_id", "class", "n_sources", "containment").distinct()


def judged_files(documents: DataFrame) -> DataFrame:
    """``doc_id`` and ``reasons`` (maybe empty) of every source file by markers and token composition."""
    rows = documents.where(is_source_file(F.col("path"))).select("doc_id", "path", F.col("raw_content").alias("content"), F.col("source").cast("string").alias("source"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            judged = [reasons(*row) for row in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3)))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(judged, pa.list_(pa.string()))], names=["doc_id", "reasons"])

    return spread(rows).mapInArrow(run, "doc_id long, reasons array<string>")


def foreign_files(documents: DataFrame, upstream: DataFrame, **options) -> DataFrame:
    """``doc_id`` and ``reason`` (one row for each) of source files that were not written by hand."""
    judged = checkpointed(judged_files(documents))
    own = judged.select("doc_id", F.explode("reasons").alias("reason"))
    copies = upstream_copies(documents, upstream, **options).select("doc_id", F.lit("copy").alias("reason"))
    across = repository_copies(documents, judged).select("doc_id", F.lit("copy").alias("reason"))
    return own.unionByName(copies).unionByName(across).distinct()


def found(documents: DataFrame, upstream: DataFrame, **options) -> DataFrame:
    return foreign_files(documents, upstream, **options).select("doc_id").distinct()


def handwritten_report(documents: DataFrame, upstream: DataFrame, **options) -> DataFrame:
    """Source files per source: how many there are and how many remain as hand-written."""
    files = documents.where(is_source_file(F.col("path"))).select("doc_id", "source")
    foreign = found(documents, upstream, **options).withColumn("foreign", F.lit(1))
    return files.join(foreign, "doc_id", "left").groupBy("source").agg(F.count("*").alias("n_files"), F.count(F.when(F.col("foreign").isNull(), 1)).alias("n_handwritten"))
