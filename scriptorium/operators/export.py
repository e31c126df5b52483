"""Tiered markdown: an index per source, an overview per parent and a page per parent, produced as ordered lines.

Lines are rows, so a parent with very many chunks is sorted and written by Spark and never gathered in memory.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T

CLASS_TYPES = ("class_overview", "method", "property")
#: Sections of a class page in order.
PAGE_SECTIONS = (("class_overview", "Overview"), ("property", "Properties"), ("method", "Methods"), ("signal", "Signals"), ("constant", "Constants"), ("enum", "Enums"), ("shader_entry_point", "Entry points"), ("tutorial_section", "Sections"))
OF = ("source_name", "source_version", "parent_name")


def parents(chunks: DataFrame) -> DataFrame:
    """Per source, version and parent: ``kind`` (``class`` if any chunk is of a class type, else ``tutorial``), ``n_chunks`` and ``summary``.

    The summary is that of the first overview for a class and of the first chunk for a tutorial.
    """
    order = F.struct("chunk_index", "id")
    is_class = F.col("chunk_type").isin(*CLASS_TYPES)
    grouped = chunks.where(F.col("parent_name").isNotNull()).groupBy(*OF).agg(
        F.bool_or(is_class).alias("is_class"),
        F.count("*").alias("n_chunks"),
        F.min_by(F.struct(F.col("summary").alias("s")), F.when(F.col("chunk_type") == "class_overview", order)).alias("overview"),
        F.min_by(F.struct(F.col("summary").alias("s")), order).alias("first"),
    )
    summary = F.when(F.col("is_class"), F.coalesce(F.col("overview.s"), F.lit(""))).otherwise(F.coalesce(F.col("first.s"), F.lit("")))
    return grouped.select(*OF, F.when(F.col("is_class"), "class").otherwise("tutorial").alias("kind"), "n_chunks", T.first_line(summary).alias("summary"))


def index_lines(chunks: DataFrame) -> DataFrame:
    """Lines of each source's index: classes first, then tutorials, each by name."""
    line = F.concat(F.lit("- **"), "parent_name", F.lit("**"), F.when(F.col("summary") != "", F.concat(F.lit(" — "), "summary")).otherwise(""))
    place = Window.partitionBy("source_name", "source_version").orderBy("kind", "parent_name")
    return parents(chunks).select("source_name", "source_version", F.row_number().over(place).alias("line_no"), "kind", line.alias("line"))


def page_lines(chunks: DataFrame) -> DataFrame:
    """Parts of each parent's page in order: ``file`` (sanitised), ``section``, ``place`` and ``text``."""
    section, rank = F.lit(None).cast("string"), F.lit(len(PAGE_SECTIONS))
    for i, (kind, title) in enumerate(PAGE_SECTIONS):
        section = F.when(F.col("chunk_type") == kind, title).otherwise(section)
        rank = F.when(F.col("chunk_type") == kind, i).otherwise(rank)
    rows = chunks.where(F.col("parent_name").isNotNull()).withColumn("section", section).withColumn("section_rank", rank)
    place = Window.partitionBy(*OF).orderBy("section_rank", "chunk_index", "id")
    heading = F.when(F.coalesce("heading", F.lit("")) != "", F.concat(F.lit("### "), "heading", F.lit("\n\n"))).otherwise("")
    return rows.select(*OF, T.safe_filename(F.col("parent_name")).alias("file"), F.coalesce("section", F.lit("Other")).alias("section"), F.row_number().over(place).alias("place"), F.concat(heading, F.coalesce("content", F.lit(""))).alias("text"))


def headed(lines: DataFrame) -> DataFrame:
    """Page parts with the page's title above the first and the section's name above the first of each section."""
    before = F.lag("section").over(Window.partitionBy(*OF).orderBy("place"))
    title = F.when(F.col("place") == 1, F.concat(F.lit("# "), "parent_name", F.lit("\n\n"))).otherwise("")
    section = F.when(before.isNull() | (before != F.col("section")), F.concat(F.lit("## "), "section", F.lit("\n\n"))).otherwise("")
    return lines.withColumn("text", F.concat(title, section, "text"))


def class_lines(chunks: DataFrame) -> DataFrame:
    """Index of the members of each class: ``file``, ``section``, ``place`` and a line ``text`` with name and summary for each."""
    pages = chunks.where(F.col("parent_name").isNotNull()).join(parents(chunks).where("kind = 'class'").select(*[F.col(c).alias(f"_{c}") for c in OF]), [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in OF], "left_semi")
    name = F.coalesce(F.substring_index("qualified_name", ".", -1), "heading", F.lit(""))
    summary = T.first_line(F.coalesce("summary", F.lit("")))
    line = F.concat(F.lit("- **"), name, F.lit("**"), F.when(summary != "", F.concat(F.lit(" — "), summary)).otherwise(""))
    return page_lines(pages.where("chunk_type <> 'class_overview'").withColumn("content", line).withColumn("heading", F.lit("")))


def write_pages(lines: DataFrame, target: str) -> None:
    """Write page parts with their headings as text, one folder per source, version and page, in order within each."""
    ordered = headed(lines).repartition("source_name", "source_version", "file").sortWithinPartitions("source_name", "source_version", "file", "place")
    ordered.select("source_name", "source_version", "file", F.col("text").alias("value")).write.mode("overwrite").partitionBy("source_name", "source_version", "file").text(target)
