"""Problem 5: functions paired with their documentation.

Every function row is read once in Arrow batches (signature, overload, code, own documentation). The rows form a symbol table
keyed by source, qualified name and normalised signature. Declarations are joined to definitions under the same key: by the full
name, with the module, and where a header has another name than its module by type and name, if one module alone declares and one
alone defines it in the source. Only then are they filtered: documentation must say something beyond the signatures of both, and a
definition without documentation of its own takes its declaration's. Keys with different documentations are ambiguous and give
nothing, as do declarations (or definitions) of different signatures under one key. Rows without useful documentation are dropped.

The first reading already leaves out what says nothing beyond the row's own signature; joined signatures can only leave out more.
The table is narrow: keys and signatures of all functions are shuffled, documentation and code only of definitions without one
and documented declarations. ``found`` asks for rows with documentation of their own, after the join.

Defined cases: a row repeated under one key counts once (the latest created_at, then the largest content); null names,
contents and summaries read as empty; rows of other chunk types are no functions; nameless rows have no counterpart; a document
that isn't given is a source of its own; empty tables give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import path_stem
from ..operators.store import latest_of_repeated
from ..runtime import broadcast_if_small, checkpointed, spread
from .function_text import beyond_counterpart, read_function

FUNCTION_TYPES = ("method", "shader_entry_point")
READ = "table_name string, row_key string, owner string, symbol string, signature string, overload string, code string, has_body boolean, documentation string, further string, own boolean"


def function_rows(chunks: DataFrame, symbols: DataFrame) -> DataFrame:
    """Function rows of both tables, once per key: ``table_name``, ``row_key``, ``owner`` (document id or doc_id), ``symbol``, ``content``, ``summary``."""
    c = chunks.where(F.col("chunk_type").isin(*FUNCTION_TYPES) & F.col("id").isNotNull()).select(
        F.lit("chunks").alias("table_name"), F.col("id").alias("row_key"), F.col("document_id").alias("owner"), F.col("qualified_name").alias("symbol"), "content", "summary", "created_at"
    )
    s = symbols.where(F.col("chunk_type").isin(*FUNCTION_TYPES) & F.col("symbol_id").isNotNull()).select(
        F.lit("symbols").alias("table_name"), F.col("symbol_id").cast("string").alias("row_key"), F.col("doc_id").cast("string").alias("owner"), F.concat_ws(".", "parent", "name").alias("symbol"), "content", "summary", F.lit(None).cast("timestamp").alias("created_at")
    )
    order = ["created_at", "content", "summary", "owner", "symbol"]
    return latest_of_repeated(spread(c), ["table_name", "row_key"], order).unionByName(latest_of_repeated(spread(s), ["table_name", "row_key"], order)).drop("created_at")


def read_functions(rows: DataFrame) -> DataFrame:
    """Signature, overload, code, own documentation (``further``: the summary's, where both say something) and ``own`` (it says something beyond the row's own signature) of each function row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            symbols = batch.column(3).to_pylist()
            read = [read_function((symbol or "").rpartition(".")[2], content, summary) for symbol, content, summary in zip(symbols, batch.column(4).to_pylist(), batch.column(5).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), batch.column(2), batch.column(3),
                    pa.array([f.signature for f in read], pa.string()), pa.array([f.overload for f in read], pa.string()), pa.array([f.code for f in read], pa.string()),
                    pa.array([f.has_body for f in read], pa.bool_()), pa.array([f.documentation for f in read], pa.string()), pa.array([f.further for f in read], pa.string()), pa.array([f.says_something for f in read], pa.bool_()),
                ],
                names=["table_name", "row_key", "owner", "symbol", "signature", "overload", "code", "has_body", "documentation", "further", "own"],
            )

    return rows.select("table_name", "row_key", "owner", "symbol", "content", "summary").mapInArrow(run, READ)


PAIR = ["table_name", "row_key", "symbol", "signature", "code", "documentation"]


def symbol_table(rows: DataFrame, documents: DataFrame | None) -> DataFrame:
    """``rows`` of functions with ``scope`` (their source), ``full_name`` (with the module) and ``short_name`` (type and name)."""
    of = lambda name, key: documents.where(F.col(key).isNotNull()).groupBy(F.col(key).cast("string").alias("owner")).agg(F.min("source").alias("scope"), F.min(path_stem(F.col("path"))).alias("module")).withColumn("table_name", F.lit(name))
    if documents is None:
        placed = rows.withColumns({"scope": F.lit(None).cast("string"), "module": F.lit(None).cast("string")})
    else:
        placed = rows.join(of("chunks", "id").unionByName(of("symbols", "doc_id")), ["table_name", "owner"], "left")
    full = F.when(F.col("table_name") == "symbols", F.concat_ws(".", "module", "symbol")).otherwise(F.col("symbol"))
    return placed.select(*rows.columns, F.coalesce("scope", F.concat(F.lit("?"), "owner")).alias("scope"), full.alias("full_name"), F.substring_index(full, ".", -2).alias("short_name"))


def counterparts(table: DataFrame) -> DataFrame:
    """``table_name``, ``row_key`` and ``counterpart``: the signature of a definition's declaration, or of a declaration's definition, where it isn't the row's own.

    Each side of a key is reduced to one row before the join, so a key of very many rows is no more work than its rows.
    """
    key, short = ["scope", "full_name", "overload"], ["scope", "short_name", "overload"]
    named = table.where("scope IS NOT NULL AND symbol <> '' AND signature <> ''")
    declared, defined = F.when(~F.col("has_body"), F.col("signature")), F.when(F.col("has_body"), F.col("signature"))
    only = lambda side: F.when(F.min(side) == F.max(side), F.min(side))
    sides = named.groupBy(*key, "short_name").agg(only(declared).alias("declared"), only(defined).alias("defined"), F.bool_or(~F.col("has_body")).alias("declares"), F.bool_or("has_body").alias("defines"))
    alone = sides.groupBy(*short).agg(F.max("declared").alias("by_short_declared"), F.max("defined").alias("by_short_defined"), F.count_if("declares").alias("n_declares"), F.count_if("defines").alias("n_defines"))
    linked = sides.join(alone.where("n_declares = 1 AND n_defines = 1"), short, "left").where("(declares AND defines) OR n_declares = 1")
    both = linked.select(*key, F.when(F.col("declares"), F.col("declared")).otherwise(F.col("by_short_declared")).alias("declared"), F.when(F.col("defines"), F.col("defined")).otherwise(F.col("by_short_defined")).alias("defined"))
    joined = named.where("own").join(both.where("NOT (declared <=> defined)"), key).withColumn("counterpart", F.when(F.col("has_body"), F.col("declared")).otherwise(F.col("defined")))
    return joined.where("counterpart <> signature").select("table_name", "row_key", "counterpart")


def judged(read: DataFrame, documents: DataFrame | None) -> DataFrame:
    """``read`` with ``own`` and ``documentation`` judged after the join: also beyond the signature of the row's declaration or definition."""
    narrow = read.select("table_name", "row_key", "owner", "symbol", "signature", "overload", "has_body", "own")
    joined = broadcast_if_small(counterparts(symbol_table(narrow, documents)))
    columns = read.columns
    name, signature, documentation, further, own = (columns.index(c) for c in ("symbol", "signature", "documentation", "further", "own"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = zip(*(batch.column(i).to_pylist() for i in (name, signature, len(columns), documentation, further)))
            left = [[*beyond_counterpart((symbol or "").rpartition(".")[2], *more), "", ""] for symbol, *more in texts]
            arrays = list(batch.columns[: len(columns)])
            arrays[documentation], arrays[further], arrays[own] = pa.array([k[0] for k in left], pa.string()), pa.array([k[1] for k in left], pa.string()), pa.array([bool(k[0]) for k in left], pa.bool_())
            yield pa.RecordBatch.from_arrays(arrays, names=columns)

    again = read.join(joined, ["table_name", "row_key"]).select(*columns, "counterpart").mapInArrow(run, read.schema)
    return read.join(joined, ["table_name", "row_key"], "left_anti").select(*columns).unionByName(again)


def documented_rows(read: DataFrame) -> DataFrame:
    """Functions with documentation of their own."""
    return read.where("own").select(*PAIR, F.lit("own").alias("doc_from"))


def declared_rows(read: DataFrame, documents: DataFrame) -> DataFrame:
    """Definitions without documentation of their own that take their declaration's."""
    wanted = read.where((F.col("own") & ~F.col("has_body")) | (~F.col("own") & F.col("has_body")))
    table = symbol_table(wanted.select(*PAIR, "owner", "overload", "own"), documents)
    declarations, definitions = table.where("own"), table.where("NOT own")

    def unambiguous(name: str, *more: Column) -> DataFrame:
        docs = declarations.groupBy("scope", name, "overload").agg(F.min("documentation").alias(f"by_{name}"), F.count_distinct("documentation").alias("n_docs"), *more)
        return docs.where("n_docs = 1").drop("n_docs")

    alone = definitions.groupBy("scope", "short_name", "overload").agg(F.count_distinct("full_name").alias("n")).where("n = 1").drop("n")
    short = unambiguous("short_name", F.count_distinct("full_name").alias("n")).where("n = 1").drop("n").join(alone, ["scope", "short_name", "overload"], "left_semi")
    resolved = definitions.join(unambiguous("full_name"), ["scope", "full_name", "overload"], "left").join(short, ["scope", "short_name", "overload"], "left")
    taken = resolved.withColumn("documentation", F.coalesce("by_full_name", "by_short_name")).where(F.col("documentation").isNotNull())
    return taken.select(*PAIR, F.lit("declaration").alias("doc_from"))


def function_pairs(chunks: DataFrame, symbols: DataFrame, documents: DataFrame) -> DataFrame:
    """``table_name``, ``row_key``, ``symbol``, ``signature``, ``code``, ``documentation`` and ``doc_from`` (``own`` or ``declaration``)."""
    read = judged(checkpointed(read_functions(function_rows(chunks, symbols))), documents)
    return documented_rows(read).unionByName(declared_rows(read, documents))


def found(chunks: DataFrame, symbols: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Function rows whose own content or summary holds documentation that says something, judged after the join as in ``function_pairs``."""
    return judged(checkpointed(read_functions(function_rows(chunks, symbols)).drop("code")), documents).where("own").select("table_name", "row_key")
