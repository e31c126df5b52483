"""Counts over the tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def table_counts(**tables: DataFrame) -> DataFrame:
    """``table_name`` and ``n_rows`` of each given table."""
    counted = [df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows") for name, df in tables.items()]
    return reduce(DataFrame.unionByName, counted)


def type_counts(chunks: DataFrame) -> DataFrame:
    """Chunks per type, most first, ties by type."""
    return chunks.groupBy("chunk_type").agg(F.count("*").alias("n_chunks")).orderBy(F.desc("n_chunks"), "chunk_type")


def source_counts(sources: DataFrame, documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Distinct documents and chunks of every source, zero counts kept.

    Each side is counted on its own key before the join, so documents and chunks of a source never multiply.
    """
    d = documents.groupBy("source_id").agg(F.count_distinct("id").alias("n_documents"))
    c = chunks.groupBy("source_name", "source_version").agg(F.count_distinct("id").alias("n_chunks"))
    s = sources.select(F.col("id").alias("source_id"), "name", "version", "source_type", "origin")
    joined = s.join(d, "source_id", "left").join(c, (s["name"] == c["source_name"]) & (s["version"] == c["source_version"]), "left")
    return joined.select("name", "version", "source_type", "origin", F.coalesce("n_documents", F.lit(0)).alias("n_documents"), F.coalesce("n_chunks", F.lit(0)).alias("n_chunks")).orderBy("name", "version")


def content_audit(documents: DataFrame, content: str = "raw_content") -> DataFrame:
    """Per source: documents, those whose stored hash is missing or wrong, and distinct contents."""
    right = F.md5(F.col(content)).eqNullSafe(F.col("content_hash"))
    return documents.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum((~right).cast("long")).alias("n_wrong_hash"), F.count_distinct(F.md5(F.col(content))).alias("n_contents"))


def repeated_contents(documents: DataFrame) -> DataFrame:
    """Contents that stand under more than one path, with their number of rows and paths; nothing is removed."""
    hashed = documents.where(F.col("raw_content").isNotNull()).select(F.md5("raw_content").alias("hash"), "path")
    return hashed.groupBy("hash").agg(F.count("*").alias("n_rows"), F.count_distinct("path").alias("n_paths")).where("n_rows > 1")


def metadata_keys(chunks: DataFrame, column: str = "metadata") -> DataFrame:
    """How often each key occurs in a JSON column; unreadable or null metadata counts as empty."""
    keys = F.coalesce(F.json_object_keys(F.col(column)), F.array().cast("array<string>"))
    return chunks.select("chunk_type", F.explode(keys).alias("key")).groupBy("chunk_type", "key").agg(F.count("*").alias("n_rows"))
