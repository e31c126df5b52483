"""Problem 6: the whole corpus as token ids of a public tokenizer.

One narrow pass: documents are scanned with two columns, encoded in Arrow batches and written; no shuffle. Defined cases:
null and empty texts give an empty list; strings that look like special tokens are plain text; repeated rows stay repeated
(one result row per input row); an empty table gives no rows; other columns of the input are never read.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import spread
from .bpe import TOKENIZERS, Decoder, Encoder, load_ranks

_encoders: dict = {}


def worker_encoder(name: tuple[str, str], broadcast) -> Encoder:
    """The encoder of this Python worker for vocabulary ``name``, kept with its memo across tasks."""
    if name not in _encoders:
        _encoders[name] = Encoder(broadcast.value)
    return _encoders[name]


def encode_corpus(documents: DataFrame, key: str = "doc_id", text: str = "text", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS, rows_per_batch: int = 500) -> DataFrame:
    """``key`` and ``ids`` (list of int) for every row of ``documents``."""
    spark = documents.sparkSession
    ranks = spark.sparkContext.broadcast(load_ranks(tokenizer, folder))
    source = documents.select(F.col(key).alias("doc_key"), F.col(text).cast("string").alias("doc_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = worker_encoder((tokenizer, folder), ranks).encode
        for whole in batches:
            for at in range(0, whole.num_rows, rows_per_batch):
                batch = whole.slice(at, rows_per_batch)
                flat, ends = array("i"), [0]
                for value in batch.column(1).to_pylist():
                    flat.extend(encode(value))
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(np.array(ends, np.int32)), pa.array(np.frombuffer(flat, np.int32) if flat else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_key", "ids"])

    kind = source.schema["doc_key"].dataType.simpleString()
    return spread(source).mapInArrow(run, f"doc_key {kind}, ids array<int>").withColumnRenamed("doc_key", key)


def decode_corpus(encoded: DataFrame, key: str = "doc_id", tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key`` and ``text`` restored from ``ids``; a null list gives a null text."""
    words = encoded.sparkSession.sparkContext.broadcast(load_ranks(tokenizer, folder))
    source = encoded.select(F.col(key).alias("doc_key"), "ids")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = Decoder(words.value).decode
        for batch in batches:
            texts = [None if ids is None else decode(ids) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["doc_key", "text"])

    kind = source.schema["doc_key"].dataType.simpleString()
    return source.mapInArrow(run, f"doc_key {kind}, text string").withColumnRenamed("doc_key", key)


def roundtrip(documents: DataFrame, tokenizer: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``doc_id``, ``n_tokens`` and whether decoding the ids gives the text back exactly (null counts as empty)."""
    ranks = documents.sparkSession.sparkContext.broadcast(load_ranks(tokenizer, folder))
    source = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, decode = worker_encoder((tokenizer, folder), ranks).encode, Decoder(ranks.value).decode
        for batch in batches:
            ids = [encode(text) for text in batch.column(1).to_pylist()]
            same = [decode(i) == (text or "") for i, text in zip(ids, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) for i in ids], pa.int64()), pa.array(same, pa.bool_())], names=["doc_id", "n_tokens", "exact"])

    return spread(source).mapInArrow(run, "doc_id long, n_tokens long, exact boolean")
