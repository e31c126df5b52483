"""Ingest, search and export as whole plans over a store of snapshots."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import export, search
from ..operators.chunking import chunk_text, overview_chunks
from ..operators.store import Snapshots, detect_changes, replace_chunks, upsert
from ..operators.symbols import language_of, source_chunks
from ..runtime import checkpointed, spread
from ..sources import api


def document_rows(scanned: DataFrame, source_name: str, source_version: str) -> DataFrame:
    """Scanned documents under deterministic ids: the same source, version and path always give the same id."""
    source_id = F.md5(F.concat_ws("\n", F.lit(source_name), F.lit(source_version)))
    return scanned.select(
        F.md5(F.concat_ws("\n", source_id, "path")).alias("id"), source_id.alias("source_id"), F.lit(source_name).alias("source"), F.lit(source_version).alias("source_version"),
        "path", "title", "doc_type", "raw_content", "content_hash", F.current_timestamp().alias("updated_at"),
    )


CHUNK = ["doc_id", "chunk_index", "chunk_type", "parent_name", "qualified_name", "heading", "summary", "content", "token_count"]


def route_chunks(documents: DataFrame) -> DataFrame:
    """Chunks of every document by its kind: ``doc_id``, ``path``, ``title``, ``doc_type`` and ``raw_content`` to the columns of ``CHUNK``.

    Class references go by their path: source files to their declarations, XML and JSON descriptions to their parts, all others (pages) to
    one overview, as do files in which nothing is declared or described. Everything else is prose.
    """
    text = F.col("raw_content")
    is_class, suffix = F.coalesce(F.col("doc_type") == "class_ref", F.lit(False)), F.when(~T.is_url(F.col("path")), T.path_suffix(F.col("path")))
    kind = F.when(~is_class, "prose").when(F.when(suffix != "", language_of(F.col("path"))).isNotNull(), "source").when(suffix.isin("xml", "json"), suffix).otherwise("page")
    known = spread(documents.select("doc_id", "path", "title", "raw_content", kind.alias("kind")))
    of = lambda name: known.where(F.col("kind") == name)
    prose = chunk_text(of("prose")).withColumn("chunk_type", F.lit("tutorial_section")).select(*CHUNK)
    sources = source_chunks(of("source")).select(*CHUNK)
    # Descriptions are read once and written, since every kind of part is a pass of its own over them.
    described = checkpointed(known.where(F.col("kind").isin("xml", "json")))
    parts = _described(api.xml_chunks(described.where("kind = 'xml'").select("doc_id", F.from_xml(text, api.CLASS_XML, {"rowTag": "class", "valueTag": "inner_text"}).alias("c")).select("doc_id", "c.*"), ["doc_id"]))
    parts = parts.unionByName(_described(api.json_chunks(described.where("kind = 'json'").select("doc_id", F.from_json(text, api.API_JSON).alias("c")).select("doc_id", "c.*"), ["doc_id"])))
    undescribed = described.join(parts.select("doc_id").distinct(), "doc_id", "left_anti")
    overviews = overview_chunks(of("page").unionByName(undescribed.select(*known.columns)))
    return prose.unionByName(sources).unionByName(parts).unionByName(overviews.select(*CHUNK))


def _described(parts: DataFrame) -> DataFrame:
    """API chunks under a running index per document: overviews first, then by kind and name."""
    order = Window.partitionBy("doc_id").orderBy(F.col("chunk_type") != "class_overview", "chunk_type", "qualified_name", "content")
    return parts.withColumn("chunk_index", F.row_number().over(order) - 1).withColumn("heading", F.substring_index("qualified_name", ".", -1)).select(*CHUNK)


def source_row(spark: SparkSession, name: str, version: str, source_type: str, origin: str | None) -> DataFrame:
    """The row of one source under its deterministic id."""
    row = spark.createDataFrame([(name, version, source_type, origin)], "name string, version string, source_type string, origin string")
    return row.select(F.md5(F.concat_ws("\n", "name", "version")).alias("id"), "*", F.current_timestamp().alias("created_at"), F.current_timestamp().alias("updated_at"))


def run_ingest(
    spark: SparkSession, store: str, scanned: DataFrame, source_name: str, source_version: str = "latest", source_type: str = "docs", origin: str | None = None,
    embed: Callable[[Column], Column] | None = None, paths: DataFrame | None = None,
) -> dict[str, int]:
    """Merge scanned documents into the store and re-chunk those that are new or changed; returns counts.

    The source's row is kept up to date. ``embed`` makes the ``embedding`` column from the chunks' text (any column expression, such as a
    Pandas UDF that asks a service). ``paths`` (a column ``path``) restricts the run to some files.
    """
    snapshots = Snapshots(spark, store)
    if paths is not None:
        scanned = scanned.join(paths.select("path").distinct(), "path", "left_semi")
    source, sources = source_row(spark, source_name, source_version, source_type, origin), snapshots.read("sources")
    snapshots.write("sources", source if sources is None else upsert(sources, source, ["name", "version"], ["source_type", "origin", "updated_at"]))
    incoming = document_rows(scanned, source_name, source_version)
    stored, chunks = snapshots.read("documents"), snapshots.read("chunks")
    changed = incoming if stored is None else detect_changes(stored, incoming).where("change <> 'same'").drop("change")
    changed = changed.persist()
    n_changed = changed.count()
    if n_changed:
        fresh = route_chunks(changed.withColumnRenamed("id", "doc_id")).withColumnRenamed("doc_id", "document_id")
        fresh = fresh.join(changed.select(F.col("id").alias("document_id"), F.col("source").alias("source_name"), "source_version"), "document_id")
        fresh = fresh.withColumn("id", F.md5(F.concat_ws("\n", "document_id", F.col("chunk_index").cast("string"))))
        if embed:
            fresh = fresh.withColumn("embedding", embed(F.concat_ws("\n", "qualified_name", "summary", "content")))
        snapshots.write("chunks", fresh if chunks is None else replace_chunks(chunks, changed.select(F.col("id").alias("document_id")), fresh))
        snapshots.write("documents", incoming if stored is None else upsert(stored, changed, ["id"], [c for c in changed.columns if c != "id"]))
    out = {"documents": incoming.count(), "changed": n_changed, "chunks": snapshots.read("chunks").count() if snapshots.current("chunks") else 0}
    changed.unpersist()
    return out


def run_search(spark: SparkSession, store: str, query: str, vector: Sequence[float] | None = None, k: int = 10, rerank: bool = False, **filters) -> DataFrame:
    """Two-stage search when asked for and a vector is there, else hybrid search."""
    chunks = search.matching(Snapshots(spark, store).read("chunks"), **filters)
    if rerank and vector is not None:
        return search.two_stage(chunks, query, vector, k)
    if vector is None or "embedding" not in chunks.columns:
        return search.text_search(chunks, query, k)
    return search.hybrid(chunks, query, vector, k).join(chunks, "id")


def run_export(spark: SparkSession, store: str, target: str, **filters) -> None:
    """Write every page of the matching chunks, an index of the members of each class and an index of the parents."""
    chunks = search.matching(Snapshots(spark, store).read("chunks"), **filters)
    export.write_pages(export.page_lines(chunks), f"{target}/pages")
    export.write_pages(export.class_lines(chunks), f"{target}/classes")
    index = export.index_lines(chunks).repartition("source_name", "source_version").sortWithinPartitions("source_name", "source_version", "line_no")
    index.select("source_name", "source_version", F.col("line").alias("value")).write.mode("overwrite").partitionBy("source_name", "source_version").text(f"{target}/index")
