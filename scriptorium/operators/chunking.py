"""Documents to chunks without leaving the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T

MAX_CHARACTERS = 2000


def split_oversize(body: Column, most: int = MAX_CHARACTERS) -> Column:
    """Paragraphs packed greedily into parts of at most ``most`` characters; one longer paragraph stays whole; parts are stripped."""
    start = F.struct(F.array().cast("array<string>").alias("parts"), F.lit("").alias("current"))

    def pack(state: Column, paragraph: Column) -> Column:
        current = state["current"]
        full = (current != "") & (F.length(current) + F.length(paragraph) + 2 > most)
        return F.struct(
            F.when(full, F.concat(state["parts"], F.array(T.strip(current)))).otherwise(state["parts"]).alias("parts"),
            F.when(full | (current == ""), paragraph).otherwise(F.concat(current, F.lit("\n\n"), paragraph)).alias("current"),
        )

    def close(state: Column) -> Column:
        last = T.strip(state["current"])
        return F.when(last != "", F.concat(state["parts"], F.array(last))).otherwise(state["parts"])

    return F.when(F.length(body) <= most, F.array(T.strip(body))).otherwise(F.aggregate(F.split(body, "\n\n"), start, pack, close))


def sections(documents: DataFrame, key: str = "doc_id", content: str = "raw_content", keep: Sequence[str] = ()) -> DataFrame:
    """``key``, ``section_no``, ``heading`` and ``body`` split at headings of level 1 to 3.

    ``keep`` names further columns to carry along. Text before the first heading is section 0 with an empty heading if it is there; blank sections are dropped but keep their number.
    """
    plain = T.uniform_lines(F.col(content))
    # Outer generators: for others the optimizer computes the array once more to filter on its size.
    parts = F.filter(F.split(plain, r"(?m)(?=^#{1,3}[ \t]+\S)"), lambda p: p != "")
    split = documents.select(key, *keep, F.posexplode_outer(parts).alias("section_no", "part"))
    heading = r"^#{1,3}[ \t]+([^\n]*)\n?"
    named = split.select(key, *keep, "section_no", T.strip(F.regexp_extract("part", heading, 1)).alias("heading"), T.strip(F.regexp_replace("part", heading, "")).alias("body"))
    return named.where(F.col("body") != "")


def overview_chunks(documents: DataFrame, content: str = "raw_content") -> DataFrame:
    """One ``class_overview`` chunk with the whole text for every document that has one."""
    text, title = T.uniform_lines(F.col(content)), F.coalesce("title", T.title_of(F.col(content), F.col("path")))
    kept = documents.select("doc_id", title.alias("heading"), text.alias("content")).where(T.strip(F.col("content")) != "")
    return kept.select(
        "doc_id", F.lit(0).alias("chunk_index"), F.lit("class_overview").alias("chunk_type"), F.col("heading").alias("parent_name"), F.col("heading").alias("qualified_name"), "heading",
        T.first_sentence(F.col("content")).alias("summary"), "content", T.token_estimate(F.col("content")).alias("token_count"),
    )


def chunk_text(documents: DataFrame, content: str = "raw_content", most: int = MAX_CHARACTERS) -> DataFrame:
    """Chunks of prose documents: one per section, more where a section is too long.

    ``doc_id``, ``chunk_index`` (100 per section), ``parent_name`` (the title), ``qualified_name``, ``heading``, ``summary``, ``content``, ``token_count``.
    """
    titled = documents.withColumn("doc_title", F.coalesce("title", T.title_of(F.col(content), F.col("path"))))
    parts = sections(titled.select("doc_id", "doc_title", content), content=content, keep=["doc_title"]).withColumn("parts", split_oversize(F.col("body"), most))
    named = parts.select("doc_id", "doc_title", "section_no", "heading", F.size("parts").alias("n_parts"), F.posexplode_outer("parts").alias("part_no", "content"))
    label = F.when(F.col("heading") == "", F.col("doc_title")).otherwise(F.col("heading"))
    return named.select(
        "doc_id",
        (F.col("section_no") * 100 + F.col("part_no")).alias("chunk_index"),
        F.col("doc_title").alias("parent_name"),
        F.concat_ws(".", "doc_title", label, F.when(F.col("n_parts") > 1, F.col("part_no").cast("string"))).alias("qualified_name"),
        label.alias("heading"),
        T.first_sentence(F.col("content")).alias("summary"),
        "content",
        T.token_estimate(F.col("content")).alias("token_count"),
    )
