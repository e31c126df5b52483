"""Exact lookups, vector and full-text search, rank fusion and two-stage search."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import analysis, vectors

#: Weights of the searched fields and the constant of reciprocal-rank fusion.
FIELD_WEIGHTS = {"qualified_name": 1.0, "heading": 1.0, "summary": 0.4, "content": 0.2}
RRF_CONSTANT = 60


def matching(rows: DataFrame, source_name: str | None = None, source_version: str | None = None, chunk_types: Sequence[str] | None = None, parent_name: str | None = None) -> DataFrame:
    """Conjunction of the predicates that are given; empty ones are left out. All reach the scan."""
    for column, value in (("source_name", source_name), ("source_version", source_version), ("parent_name", parent_name)):
        if value:
            rows = rows.where(F.col(column) == value)
    return rows.where(F.col("chunk_type").isin(*chunk_types)) if chunk_types else rows


def lookup(chunks: DataFrame, qualified_name: str | None = None) -> DataFrame:
    """The first chunk of each (or one) qualified name by source, version, index and id."""
    rows = chunks.where(F.col("qualified_name") == qualified_name) if qualified_name else chunks.where(F.col("qualified_name").isNotNull())
    order = F.struct(F.coalesce("source_name", F.lit("")), F.coalesce("source_version", F.lit("")), F.coalesce("chunk_index", F.lit(-1)), "id")
    return rows.groupBy("qualified_name").agg(F.min_by(F.struct("id", "source_name", "source_version", "chunk_type", "chunk_index"), order).alias("c")).select("qualified_name", "c.*")


def context(chunks: DataFrame, **filters) -> DataFrame:
    """Chunks of a parent (or of all) in order of type and index, as rows."""
    rows = matching(chunks, **filters)
    place = Window.partitionBy("source_name", "source_version", "parent_name").orderBy("chunk_type", "chunk_index", "id")
    return rows.select("source_name", "source_version", "parent_name", F.row_number().over(place).alias("place"), "chunk_type", "qualified_name", "id")


def nearest(rows: DataFrame, query: Sequence[float], k: int = 10, key: str = "id", embedding: str = "embedding") -> DataFrame:
    """The k rows most similar to one vector by cosine; rows without a usable vector are left out, ties go to the smaller key."""
    ready = rows.where(vectors.usable(F.col(embedding), len(query)))
    scored = ready.withColumn("similarity", F.round(vectors.cosine(F.col(embedding), vectors.literal(query)), 9))
    return scored.orderBy(F.desc("similarity"), key).limit(k)


def read_query(text: str) -> list[list[tuple[bool, list[str]]]]:
    """Web-search wording as alternatives of conditions (wanted, terms in order): words are joined by and, ``or`` separates
    alternatives, quotes make a phrase, a hyphen in front excludes."""
    alternatives: list[list[tuple[bool, list[str]]]] = [[]]
    for minus, phrase, word in re.findall(r'(-?)(?:"([^"]*)"|(\S+))', text):
        if word.lower() == "or" and not minus:
            alternatives.append([])
            continue
        found = [analysis.stem_text(t) for t in re.split("[^a-z0-9]+", (phrase or word).lower()) if t and t not in analysis.STOP_WORDS]
        if found:
            alternatives[-1].append((not minus, found))
    return [a for a in alternatives if a]


def may_match(text: Column, alternatives: list[list[tuple[bool, list[str]]]]) -> Column:
    """A cheap condition that every row which matches fulfils: its text holds the beginnings of an alternative's wanted terms.

    A stem is the beginning of its words, but for a final y, which stands for ``ies``.
    """
    held = lambda term: text.contains(term[:-1] if term.endswith("y") else term)
    sides = [reduce(lambda a, b: a & b, [held(term) for keep, phrase in alternative if keep for term in phrase] or [F.lit(True)]) for alternative in alternatives]
    return reduce(lambda a, b: a | b, sides)


def text_search(rows: DataFrame, query: str, k: int = 10, key: str = "id", weights: dict[str, float] = FIELD_WEIGHTS) -> DataFrame:
    """The k rows that match a web-search query, by weighted and saturated term frequency; ties go to the smaller key.

    The words of a row's fields count as one text for matching. A query without a searchable word matches nothing.
    """
    alternatives = read_query(query)
    fields = {name: F.col(f"_t_{name}") for name in weights}
    if alternatives:  # the analysis is dear, so only rows that can match are analysed
        rows = rows.where(may_match(F.lower(F.concat_ws("\n", *weights)), alternatives))
    # A generator keeps the optimizer from copying the analysis into every condition and term that reads it.
    analysed = rows.select("*", F.inline(F.array(F.struct(*[analysis.terms(F.col(name)).alias(f"_t_{name}") for name in weights]))))
    if not alternatives:
        return analysed.drop(*[f"_t_{n}" for n in weights]).withColumn("rank", F.lit(0.0)).limit(0)

    def condition(wanted: bool, phrase: list[str]) -> Column:
        hit = reduce(lambda a, b: a | b, [analysis.has_phrase(words, phrase) for words in fields.values()])
        return hit if wanted else ~hit

    match = reduce(lambda a, b: a | b, [reduce(lambda a, b: a & b, [condition(*c) for c in alternative]) for alternative in alternatives])
    wanted = sorted({t for alternative in alternatives for keep, phrase in alternative if keep for t in phrase})
    rank = F.lit(0.0)
    for name, words in fields.items():
        for term in wanted:
            tf = analysis.occurrences(words, term)
            rank = rank + F.lit(weights[name]) * tf / (tf + F.lit(1.0))
    ranked = analysed.where(match).withColumn("rank", F.round(rank, 9)).drop(*[f"_t_{n}" for n in weights])
    return ranked.orderBy(F.desc("rank"), key).limit(k)


def postings(rows: DataFrame, key: str = "id", field: str = "content") -> DataFrame:
    """Inverted index of a field: ``term``, ``key``, ``tf``; counted per row before the shuffle."""
    words = rows.select(key, F.explode(analysis.terms(F.col(field))).alias("term"))
    return words.groupBy("term", key).agg(F.count("*").alias("tf"))


def fuse(keyword: DataFrame, semantic: DataFrame, k: int = 10, key: str = "id", constant: int = RRF_CONSTANT) -> DataFrame:
    """Reciprocal-rank fusion of two ranked lists (columns ``key`` and ``place`` from 1).

    ``score`` is the sum of 1 / (constant + place), ``retrieval`` tells where a row came from; ties keep keyword order first.
    """
    a = keyword.select(key, F.col("place").alias("keyword_place"))
    b = semantic.select(key, F.col("place").alias("semantic_place"))
    part = lambda c: F.coalesce(1.0 / (constant + F.col(c)), F.lit(0.0))
    tag = F.when(F.col("semantic_place").isNull(), "keyword").when(F.col("keyword_place").isNull(), "semantic").otherwise("hybrid")
    both = a.join(b, key, "full_outer").withColumn("score", F.round(part("keyword_place") + part("semantic_place"), 9)).withColumn("retrieval", tag)
    return both.orderBy(F.desc("score"), F.col("keyword_place").asc_nulls_last(), F.col("semantic_place").asc_nulls_last()).limit(k)


def placed(ranked: DataFrame, order: Sequence[Column]) -> DataFrame:
    """Adds ``place`` from 1 to a top-k list (its size is bounded by k)."""
    return ranked.withColumn("place", F.row_number().over(Window.orderBy(*order)))


def hybrid(rows: DataFrame, query: str, vector: Sequence[float] | None, k: int = 10, key: str = "id", widen: int = 3) -> DataFrame:
    """Text and vector search with ``widen`` times the wanted rows each, fused; without a vector only text search takes part."""
    keyword = placed(text_search(rows, query, k * widen, key).select(key, "rank"), [F.desc("rank"), F.col(key)])
    near = nearest(rows, vector, k * widen, key).select(key, "similarity") if vector is not None else rows.select(key, F.lit(0.0).alias("similarity")).limit(0)
    return fuse(keyword, placed(near, [F.desc("similarity"), F.col(key)]), k, key)


def lexical_score(query: str, content: Column) -> Column:
    """A deterministic reranker: share of the query's terms that the content holds."""
    wanted = sorted({t for alternative in read_query(query) for keep, phrase in alternative if keep for t in phrase})
    words = analysis.terms(content)
    hits = reduce(lambda a, b: a + b, [F.array_contains(words, t).cast("int") for t in wanted]) if wanted else F.lit(0)
    return F.round(hits / float(max(1, len(wanted))), 9)


def two_stage(rows: DataFrame, query: str, vector: Sequence[float], k: int = 10, candidates: int = 50, key: str = "id", score: Callable[[str, Column], Column] = lexical_score) -> DataFrame:
    """Vector candidates, rescored by ``score(query, content)``; ties go to the more similar, then the smaller key."""
    near = nearest(rows, vector, max(k, candidates), key)
    return near.withColumn("rerank_score", score(query, F.col("content"))).orderBy(F.desc("rerank_score"), F.desc("similarity"), key).limit(k)


def batches(rows: DataFrame, size: int = 5, group: str = "document_id", order: Sequence[str] = ("chunk_index", "id")) -> DataFrame:
    """Consecutive batches of ``size`` rows within each group, the last one short: adds ``batch_no`` from 0."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return rows.withColumn("batch_no", F.floor((place - 1) / size).cast("long"))
