"""Problem 2: token budget per source, version, language and domain.

The tokenizer is described by its pre-splitting and by the lengths that need no merging: a piece that is itself a vocabulary
entry is one token. Those pieces are summed where the document is read. Every other distinct piece is tokenized exactly
once (distinct over the whole corpus), and its length is joined back to the documents' piece frequencies, so totals are
exact. Frequencies are counted per document before anything is shuffled. Pieces that very many documents have are joined by a
broadcast (there are at most ``HOT_PIECES`` of them, by their threshold), all others by a shuffle, so no piece makes a hot key.

The project's own estimate (``WORDS``) is the limiting case: after splitting at Unicode white space every piece has length
one, so no distinct piece is left to tokenize and the join is empty; the count stays in the JVM.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import token_estimate, url_host
from ..runtime import checkpointed, spread
from .bpe import SPLIT, TOKENIZERS, load_ranks, merge_piece

WORDS = "words"
#: Most pieces that are joined by a broadcast, the fewest documents that such a piece has, and its most characters.
HOT_PIECES, HOT_ROWS, HOT_CHARACTERS = 50_000, 1000, 128

#: Spellings of languages besides two-letter codes.
LANGUAGES = {"english": "en", "eng": "en", "german": "de", "deutsch": "de", "deu": "de", "ger": "de", "spanish": "es", "español": "es", "spa": "es", "french": "fr", "français": "fr", "fra": "fr", "fre": "fr", "chinese": "zh", "中文": "zh", "zho": "zh", "chi": "zh", "cn": "zh"}


def clean_language(lang: Column) -> Column:
    """Two-letter code in lower case; null, unclear or unknown notations become ``und``."""
    head = F.regexp_extract(F.lower(F.trim(lang)), r"^(\p{L}+)", 1)
    named = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])[head]
    return F.coalesce(named, F.when(head.rlike("^[a-z]{2}$"), head), F.lit("und"))


def document_tokens(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``n_tokens`` for every distinct key; null and empty texts have 0 tokens.

    Of rows repeated under one key the texts are taken once each, so a repeated row does not add up.
    """
    source = documents.select(F.col(key).alias("doc_key"), F.col(text).cast("string").alias("doc_text"))
    if tokenizer == WORDS:
        return source.select(F.col("doc_key").alias(key), F.coalesce(token_estimate(F.col("doc_text")), F.lit(0)).cast("long").alias("n_tokens")).groupBy(key).agg(F.max("n_tokens").alias("n_tokens"))
    ranks = source.sparkSession.sparkContext.broadcast(load_ranks(tokenizer, folder))
    kind = source.schema["doc_key"].dataType.simpleString()

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        pieces, known = regex.compile(SPLIT).findall, {}
        vocabulary = ranks.value
        for batch in batches:
            sums, rest = [], []
            for value in batch.column(1).to_pylist():
                total, open_pieces = 0, []
                for piece, n in Counter(pieces(value or "")).items():
                    one = known.get(piece)
                    if one is None:
                        one = known[piece] = piece.encode() in vocabulary
                        if len(known) > 400_000:
                            known.clear()
                    if one:
                        total += n
                    else:
                        open_pieces.append({"piece": piece, "n": n})
                sums.append(total)
                rest.append(open_pieces)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(sums, pa.int64()), pa.array(rest, pa.list_(pa.struct([("piece", pa.string()), ("n", pa.int64())])))], names=["doc_key", "text_hash", "known", "open"])

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = ranks.value
        for batch in batches:
            lengths = [len(merge_piece(piece.encode(), vocabulary)) for piece in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(lengths, pa.int32())], names=["piece", "n_rows", "length"])

    # Read twice below (distinct pieces, then frequencies), so the splitting is written once.
    hashed = spread(source).withColumn("text_hash", F.xxhash64("doc_text"))
    read = hashed.mapInArrow(split, f"doc_key {kind}, text_hash long, known long, open array<struct<piece:string,n:long>>")
    counted = checkpointed(read.dropDuplicates(["doc_key", "text_hash"]).drop("text_hash"))
    open_pieces = counted.select("doc_key", F.explode("open").alias("o")).select("doc_key", "o.piece", "o.n")
    lengths = checkpointed(open_pieces.groupBy("piece").agg(F.count("*").alias("n_rows")).mapInArrow(measure, "piece string, n_rows long, length int"))
    # n pieces of at least total / HOT_PIECES rows each have no more rows than there are, so n <= HOT_PIECES.
    least = max(HOT_ROWS, -(-(lengths.agg(F.sum("n_rows")).first()[0] or 0) // HOT_PIECES))
    hot = (F.col("n_rows") >= least) & (F.length("piece") <= HOT_CHARACTERS)
    tried = open_pieces.join(F.broadcast(lengths.where(hot).select("piece", F.col("length").alias("hot_length"))), "piece", "left")
    cold = tried.where(F.col("hot_length").isNull()).join(lengths.where(~hot), "piece").select("doc_key", (F.col("n") * F.col("length")).alias("merged"))
    counted_pieces = tried.where(F.col("hot_length").isNotNull()).select("doc_key", (F.col("n") * F.col("hot_length")).alias("merged")).unionByName(cold)
    merged = counted_pieces.groupBy("doc_key").agg(F.sum("merged").alias("merged"))
    return counted.groupBy("doc_key").agg(F.sum("known").alias("known")).join(merged, "doc_key", "left").select(F.col("doc_key").alias(key), (F.col("known") + F.coalesce("merged", F.lit(0))).alias("n_tokens"))


def true_attribution(documents: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per document id with the name and version of the sources row it belongs to.

    A document that came back under another doc_id shares its id and source; the smallest source_id decides should they differ.
    """
    owned = documents.where(F.col("id").isNotNull()).groupBy("id").agg(F.min("source_id").alias("source_id"))
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("true_name"), F.col("version").alias("true_version"))
    return owned.join(names, "source_id", "left").select(F.col("id").alias("document_id"), "true_name", "true_version")


def audit_chunks(chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """Every distinct chunk id with its measured tokens, its true source and a flag for each field that would falsify totals.

    Texts are measured where they are read, so only ids, short fields and counts are shuffled. Of rows repeated under one
    id the latest created_at counts (then the largest stored values, so ties are defined). Null ids are left out. A chunk
    whose document is unknown is judged on token_count only.
    """
    stored = F.struct("created_at", "document_id", "source_name", "source_version", "token_count", "n_tokens")
    measured = chunks.where(F.col("id").isNotNull()).select(
        "id", "document_id", "source_name", "source_version", "token_count", "created_at", F.coalesce(token_estimate(F.col("content")), F.lit(0)).alias("n_tokens")
    )
    latest = measured.groupBy("id").agg(F.max(stored).alias("c")).select("id", "c.*")
    joined = latest.join(true_attribution(documents, sources).withColumn("known", F.lit(True)), "document_id", "left")
    known = F.coalesce("known", F.lit(False))
    return joined.select(
        "id", "document_id", "n_tokens", "true_name", "true_version",
        (~F.col("token_count").eqNullSafe(F.col("n_tokens"))).alias("bad_token_count"),
        (known & (F.col("source_name").isNull() | ~F.col("source_name").eqNullSafe(F.col("true_name")))).alias("bad_source_name"),
        (known & (F.col("source_version").isNull() | ~F.col("source_version").eqNullSafe(F.col("true_version")))).alias("bad_source_version"),
    )


def falsifying_fields(chunks: DataFrame, documents: DataFrame, sources: DataFrame) -> DataFrame:
    """``id`` and ``field_name`` of every field that the audit rejects."""
    fields = ("token_count", "source_name", "source_version")
    bad = F.filter(F.array(*[F.when(F.col(f"bad_{name}"), F.lit(name)) for name in fields]), lambda x: x.isNotNull())
    return audit_chunks(chunks, documents, sources).select("id", F.explode(bad).alias("field_name"))


def token_budget(documents: DataFrame, sources: DataFrame, **options) -> DataFrame:
    """Exact token totals by source, version, language and domain; a document that was ingested again counts once (its latest row)."""
    facts = documents.select("doc_id", "id", "source_id", clean_language(F.col("lang")).alias("lang"), url_host(F.col("path")).alias("domain"), "created_at")
    latest = facts.groupBy(F.coalesce("id", F.col("doc_id").cast("string")).alias("doc")).agg(F.max_by(F.struct("doc_id", "source_id", "lang", "domain"), F.struct("created_at", "doc_id")).alias("d")).select("d.*")
    names = sources.select(F.col("id").alias("source_id"), F.col("name").alias("source"), "version")
    return (
        latest.join(document_tokens(documents, **options), "doc_id")
        .join(names, "source_id", "left")
        .groupBy("source", "version", "lang", "domain")
        .agg(F.count("*").alias("n_documents"), F.sum("n_tokens").alias("n_tokens"))
    )
