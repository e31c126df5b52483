"""Breadth-first levels over a link table, one join per level."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..runtime import checkpointed


def site_edges(documents: DataFrame) -> DataFrame:
    """``source_url`` -> ``target_url`` from every folder of a page's URL to the next one below, distinct."""
    url = T.normal_url(F.regexp_replace(F.col("path"), r"\?.*$", ""))
    parts = F.split(F.regexp_replace(url, "(?i)^https?://", ""), "/")
    pages = documents.where(T.is_url(F.col("path"))).select(parts.alias("parts")).distinct()
    step = F.explode(F.sequence(F.lit(1), F.size("parts") - 1)).alias("n")
    steps = pages.where(F.size("parts") > 1).select("parts", step)
    prefix = lambda n: F.array_join(F.slice("parts", F.lit(1), n), "/")
    return steps.select(prefix(F.col("n")).alias("source_url"), prefix(F.col("n") + 1).alias("target_url")).distinct()


def levels(edges: DataFrame, seeds: DataFrame, include: Sequence[str] = (), exclude: Sequence[str] = (), same_host: bool = False) -> DataFrame:
    """``url`` and the smallest number of steps from a seed; each level joins the frontier and drops what was visited.

    The walk ends when nothing new is found, however deep. Links to follow can be limited by patterns of their target (``include``,
    ``exclude``) and to the host they stand on; seeds are always there.

    The visited set is cut by a checkpoint per level, so the plan stays short and a lost executor costs one level.
    """
    if include or exclude:
        edges = edges.where(T.included(F.col("target_url"), include, exclude))
    if same_host:
        host = lambda url: F.lower(F.substring_index(F.regexp_replace(url, "(?i)^https?://", ""), "/", 1))
        edges = edges.where(host("source_url") == host("target_url"))
    visited = checkpointed(seeds.select("url").distinct().withColumn("level", F.lit(0)))
    frontier = visited
    for level in count(1):
        found = edges.join(frontier, edges["source_url"] == frontier["url"], "left_semi").select(F.col("target_url").alias("url")).distinct()
        frontier = checkpointed(found.join(visited, "url", "left_anti").withColumn("level", F.lit(level)))
        if frontier.isEmpty():
            break
        visited = visited.unionByName(frontier)
        if level % 8 == 0:  # one table again, so that deep walks don't read ever more of them
            visited = checkpointed(visited)
    return visited
