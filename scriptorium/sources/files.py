"""Scans of folders: prose and source files as document rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from .markup import rst_to_markdown

# Suffixes and folders of the scans.
PROSE_SUFFIXES = ("md", "rst", "txt")
CODE_SUFFIXES = ("py", "gd", "ts", "tsx", "js", "jsx", "rs", "go", "cpp", "cc", "cxx", "c", "h", "hpp", "hlsl", "usf", "ush", "glsl", "frag", "vert", "comp", "geom", "tesc", "tese", "gdshader", "shader", "fx")
SKIPPED_FOLDERS = (".git", ".svn", ".hg", "node_modules", "__pycache__", ".venv", "venv", "dist", "build", "target", ".idea", ".vscode")
MIN_CHARACTERS, MIN_TOCTREE_LINES = 50, 30


def read_texts(spark: SparkSession, root: str, suffixes: Sequence[str]) -> DataFrame:
    """``path`` (relative to the root) and ``raw_content`` of every file with one of the suffixes; undecodable bytes are replaced.

    ``valid`` tells whether the bytes were UTF-8 as they stood. Files are listed and read by Spark, whole, one row each.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(suffixes) + "}").load(root)
    base = spark._jvm.org.apache.hadoop.fs.Path(root).getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(spark._jvm.org.apache.hadoop.fs.Path(root)).toUri().getPath()
    plain = F.regexp_replace("path", r"^\w+:(?://[^/]*)?", "")
    content = F.col("content").cast("string")
    return files.select(F.substring(plain, F.lit(len(base.rstrip("/")) + 2), F.length(plain)).alias("path"), F.is_valid_utf8(content).alias("valid"), F.make_valid_utf8(content).alias("raw_content"))


def prose_documents(files: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), skipped: Sequence[str] = SKIPPED_FOLDERS) -> DataFrame:
    """Document rows of prose files (``path``, ``raw_content``): blank, very short and table-of-contents-only files are left out."""
    lines = F.size(F.split("raw_content", "\n"))
    is_rst = F.col("path").endswith(".rst")
    only_toc = F.col("path").rlike(r"(^|/)index\.rst$") & F.col("raw_content").contains("toctree") & (lines < MIN_TOCTREE_LINES)
    kept = files.where(T.included(F.col("path"), include, exclude) & T.outside_directories(F.col("path"), skipped) & T.path_suffix(F.col("path")).isin(*PROSE_SUFFIXES))
    kept = kept.where(F.col("raw_content").isNotNull() & (F.length(T.strip(F.col("raw_content"))) >= MIN_CHARACTERS) & ~only_toc)
    converted = kept.withColumn("raw_content", F.when(is_rst, rst_to_markdown(F.col("raw_content"))).otherwise(F.col("raw_content")))
    kind = F.when(F.lower("path").contains("tutorial") | F.lower("path").contains("getting_started"), "tutorial").otherwise("guide")
    return converted.select("path", T.title_of(F.col("raw_content"), F.col("path")).alias("title"), kind.alias("doc_type"), "raw_content", T.content_hash(F.col("raw_content")).alias("content_hash"))


def scan_prose(spark: SparkSession, root: str, **options) -> DataFrame:
    """Prose files below a folder; files that are no UTF-8 are skipped."""
    return prose_documents(read_texts(spark, root, PROSE_SUFFIXES).where("valid"), **options)


def code_documents(files: DataFrame, suffixes: Sequence[str] = CODE_SUFFIXES, skipped: Sequence[str] = SKIPPED_FOLDERS, exclude_parts: Sequence[str] = ()) -> DataFrame:
    """Document rows of source files; ``exclude_parts`` are substrings of the path. Package markers and blank files are left out."""
    kept = files.where(T.path_suffix(F.col("path")).isin(*suffixes) & T.outside_directories(F.col("path"), skipped) & ~F.col("path").rlike(r"(^|/)__init__\.py$"))
    for part in exclude_parts:
        kept = kept.where(~F.col("path").contains(part))
    kept = kept.where(F.coalesce(T.strip(F.col("raw_content")), F.lit("")) != "")
    return kept.select("path", F.col("path").alias("title"), F.lit("class_ref").alias("doc_type"), "raw_content", T.content_hash(F.col("raw_content")).alias("content_hash"))


def scan_code(spark: SparkSession, root: str, suffixes: Sequence[str] = CODE_SUFFIXES, **options) -> DataFrame:
    return code_documents(read_texts(spark, root, suffixes), suffixes, **options)
