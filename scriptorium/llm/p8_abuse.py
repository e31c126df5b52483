"""Problem 8: abusive, hateful or sexual content, scored by multiple-instance learning.

A document is a bag of sentences. A linear sentence model gives each sentence a probability, noisy-or combines them into the
document's: ``p = 1 - prod(1 - p_sentence)``. The weights of words, pairs of neighbouring words and signals of seed words are
trained from document labels alone, so the same model then locates the offending sentences. Seed words (``abuse_text``) only say
where the weights start: without labels they find little more than half of what the trained model finds (``heldout_report``).

Training reads at most ``MAX_LABELLED`` labelled documents with at most ``MAX_BYTES`` bytes of text, documents with a positive vote
first for half of each, in hash order; these bounds make collecting their sentence features and broadcasting the weights safe.
The texts are reached through a semi-join on their ids. Scoring covers every document in one narrow pass without a shuffle.

Defined cases: null, empty and blank texts score 0; repeated label rows of one rater count once; null votes are ignored; raters
who disagree give a soft label; without any label the seeds score; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import checkpointed, spread
from .abuse_text import BIAS, PRIOR, Words, features, lexical, signals

#: Production parameters.
MAX_LABELLED, MAX_BYTES = 8000, 32 * 1024 * 1024
THRESHOLD = 0.5

Model = dict


def votes(labels: DataFrame) -> DataFrame:
    """``doc_id``, ``n`` raters and their share ``y`` of positive votes; of one rater the latest vote counts."""
    said = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    latest = said.groupBy("doc_id", "rater").agg(F.max(F.struct("labelled_at", "toxic")).alias("l"))
    return latest.groupBy("doc_id").agg(F.count("*").alias("n"), F.avg(F.col("l.toxic").cast("double")).alias("y"))


def in_fold(fold: tuple[int, int]):
    return F.pmod(F.xxhash64("doc_id"), F.lit(fold[1])) == fold[0]


def labelled_features(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, max_bytes: int = MAX_BYTES, fold: tuple[int, int] | None = None) -> pa.Table:
    """Sentence features of the labelled documents that the bounds admit: ``n``, ``y``, ``sentences`` (lists of feature names).

    ``fold=(k, parts)`` leaves out every document whose hash falls in part ``k``, for held-out accuracy.
    """
    voted = votes(labels)
    if fold:
        voted = voted.where(~in_fold(fold))
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [voted.where(kind).orderBy(*order).limit(max_labelled // 2) for kind in (F.col("y") > 0, F.col("y") == 0)]
    texts = documents.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id")
    texts = checkpointed(texts)  # at most max_labelled rows
    size = F.sum(F.octet_length("text")).over(Window.partitionBy(F.col("y") > 0).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    kept = texts.withColumn("size", size).where(F.col("size").isNull() | (F.col("size") <= max_bytes // 2))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Words()
        for batch in batches:
            sentences = [[features(s, *reader.words(s)) for s in dict.fromkeys(reader.sentences(text or ""))] for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(2), batch.column(3), pa.array(sentences, pa.list_(pa.list_(pa.string())))], names=["n", "y", "sentences"])

    return kept.select("doc_id", "text", "n", "y").mapInArrow(run, "n long, y double, sentences array<array<string>>").toArrow()


def fit(sample: pa.Table, steps: int = 150, rate: float = 0.2, pull: float = 1.0, signal_pull: float = 0.5, noise: float = 0.1, least: int = 3) -> Model:
    """Weights by gradient steps on the noisy-or likelihood.

    ``pull`` and ``signal_pull`` hold words and signals to where they start (0 and the seeds' prior), words the more the more documents
    they are in; ``noise`` is the share of raters' votes taken to be wrong; words of fewer than ``least`` labelled documents have no
    weight. A document counts by the root of the number of its raters.
    """
    model = {"bias": BIAS, "words": {}, "pairs": {}, "signals": dict(PRIOR)}
    if not sample.num_rows:
        return model
    sentences = sample.column("sentences").combine_chunks()
    n_sentences = np.diff(sentences.offsets.to_numpy())
    inner = sentences.flatten()
    n_features = np.diff(inner.offsets.to_numpy()[: len(inner) + 1])
    coded = inner.flatten().dictionary_encode()
    names, codes = coded.dictionary.to_pylist(), coded.indices.to_numpy()
    owner = np.repeat(np.arange(len(inner)), n_features)
    document = np.repeat(np.arange(len(n_sentences)), n_sentences)
    y, votes_of = sample.column("y").to_numpy(), np.sqrt(sample.column("n").to_numpy())
    # A feature seen in few documents says little about another; signals stay.
    seen = np.unique(np.stack([codes.astype(np.int64), document[owner]]), axis=1)[0]
    spread_of = np.bincount(seen, minlength=len(names))
    signal = np.array([name.startswith("#") for name in names])
    keep = (spread_of >= least) | signal
    used = keep[codes]
    codes, owner = codes[used], owner[used]
    start = np.array([PRIOR.get(name, 0.0) for name in names])
    held = np.where(signal, signal_pull, pull * np.maximum(1, spread_of / (0.01 * len(y))))
    weights, bias = start.copy(), BIAS
    moments = np.zeros((2, len(names)))
    for step in range(1, steps + 1):
        scores = bias + np.bincount(owner, weights[codes], minlength=len(inner))
        mass = np.bincount(document, np.logaddexp(0, scores), minlength=len(y))
        said = noise + (1 - 2 * noise) * -np.expm1(-mass)
        slope = votes_of * (1 - 2 * noise) * (said - y) / (said * (1 - said)) * np.exp(-mass)
        push = slope[document] / (1 + np.exp(-scores))
        gradient = np.bincount(codes, push[owner], minlength=len(names)) + held * (weights - start)
        moments[0] = 0.9 * moments[0] + 0.1 * gradient
        moments[1] = 0.99 * moments[1] + 0.01 * gradient**2
        weights -= rate * (moments[0] / (1 - 0.9**step)) / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-6) * (1 - step / (steps + 1))
    for name, weight in zip(names, weights.tolist()):
        if abs(weight) < 0.03:
            continue
        if name.startswith("#"):
            model["signals"][name] = weight
        elif " " in name:
            first, second = name.split(" ", 1)
            model["pairs"].setdefault(first, {})[second] = weight
        else:
            model["words"][name] = weight
    return model


def sentence_score(model: Model, sentence: str, words: list[str], disguised: bool) -> float:
    """Log-odds that a cleaned sentence is offending; every feature counts once, as in training."""
    single, pairs, total = model["words"], model["pairs"], model["bias"]
    learned = lexical(words)
    for word in set(learned):
        if (weight := single.get(word)) is not None:
            total += weight
    done = set()
    for pair in zip(learned, learned[1:]):
        if (following := pairs.get(pair[0])) is not None and (weight := following.get(pair[1])) is not None and pair not in done:
            total += weight
            done.add(pair)
    if not sentence.isascii():
        han = "".join(c for c in sentence if "㐀" <= c <= "鿿")
        total += sum(single.get(gram, 0.0) for gram in {han[i : i + 2] for i in range(len(han) - 1)})
    for name in set(signals(sentence, words, disguised)):
        total += model["signals"].get(name, 0.0)
    return total


def softplus(x: float) -> float:
    return x + math.log1p(math.exp(-x)) if x > 0 else math.log1p(math.exp(x))


def train(documents: DataFrame, labels: DataFrame, max_labelled: int = MAX_LABELLED, **options) -> Model:
    return fit(labelled_features(documents, labels, max_labelled), **options)


def score_documents(documents: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``source``, ``score`` in [0, 1] and ``worst`` (the highest scoring sentence) of every row."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = shared.value, Words()
        for batch in batches:
            scores, worst = [], []
            for text in batch.column(2).to_pylist():
                mass, top, what = 0.0, -1e9, None
                # Furniture and comments repeat within a text; a sentence is an instance of the bag once.
                for sentence in dict.fromkeys(reader.sentences(text or "")):
                    score = sentence_score(model, sentence, *reader.words(sentence))
                    mass += softplus(score)
                    if score > top:
                        top, what = score, sentence
                scores.append(-math.expm1(-mass))
                worst.append(what)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64()), pa.array(worst, pa.string())], names=["doc_id", "source", "score", "worst"])

    return spread(rows).mapInArrow(run, "doc_id long, source string, score double, worst string")


def heldout_report(documents: DataFrame, labels: DataFrame, parts: int = 5, threshold: float = THRESHOLD) -> DataFrame:
    """Precision and recall of the seeds alone (``prior``) and of the trained model on a part of the labelled documents that training
    did not see, against those documents whose raters (two at least) agree."""
    fold = (0, parts)
    agreed = votes(labels).where((F.col("n") >= 2) & F.col("y").isin(0.0, 1.0) & in_fold(fold)).select("doc_id", "y")
    texts = checkpointed(documents.select("doc_id", "source", "text").join(agreed, "doc_id"))
    models = {"prior": fit(labelled_features(documents.limit(0), labels)), "trained": fit(labelled_features(documents, labels, fold=fold))}
    report = None
    for name, model in models.items():
        scored = score_documents(texts, model).select("doc_id", "score").join(texts.select("doc_id", "y"), "doc_id")
        hit, true = F.col("score") >= threshold, F.col("y") == 1
        part = scored.agg(
            F.lit(name).alias("model"), F.count("*").alias("n_documents"), F.count_if(true).alias("n_offending"),
            (F.count_if(hit & true) / F.nullif(F.count_if(hit), F.lit(0))).alias("precision"), (F.count_if(hit & true) / F.nullif(F.count_if(true), F.lit(0))).alias("recall"),
        )
        report = part if report is None else report.unionByName(part)
    return report


def offending_sentences(documents: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``sentence_no`` (order within the text), ``sentence`` and ``score`` of every sentence at or above the threshold."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    rows = documents.select("doc_id", F.col("text").cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, reader = shared.value, Words()
        for batch in batches:
            out = {"doc_id": [], "sentence_no": [], "sentence": [], "score": []}
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for i, sentence in enumerate(reader.sentences(text or "")):
                    p = 1 / (1 + math.exp(-sentence_score(model, sentence, *reader.words(sentence))))
                    if p >= threshold:
                        for name, value in zip(out, (key, i, sentence, p)):
                            out[name].append(value)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("doc_id", pa.int64()), ("sentence_no", pa.int64()), ("sentence", pa.string()), ("score", pa.float64())]))

    return spread(rows).mapInArrow(run, "doc_id long, sentence_no long, sentence string, score double")


def found(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """``doc_id`` of every document at or above the threshold, once each."""
    return score_documents(documents, train(documents, labels, **options)).where(F.col("score") >= threshold).select("doc_id").distinct()


def rates(documents: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Documents, offending documents and their rate per source; a null source is a source of its own."""
    scored = score_documents(documents, train(documents, labels, **options))
    return scored.groupBy("source").agg(F.count("*").alias("n_documents"), F.sum((F.col("score") >= threshold).cast("long")).alias("n_offending"), F.avg((F.col("score") >= threshold).cast("double")).alias("rate"), F.avg("score").alias("mean_score"))
