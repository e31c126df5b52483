"""The knowledge base's tables: keyed merges, change detection, replacement of chunks, and numbered snapshots.

Parquet has no MERGE, so a merge is a full outer join on the key followed by a new snapshot. A snapshot counts once its mark stands
beside it; marks are only ever added, so a job lost at any point leaves the old snapshot in place.
"""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import broadcast_if_small


def latest_by(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the largest by ``order`` (nulls first, then later columns decide), limited before the shuffle."""
    ranked = Window.partitionBy(*keys).orderBy(*[F.col(c).desc_nulls_last() for c in order])
    return rows.withColumn("_rank", F.row_number().over(ranked)).where("_rank = 1").drop("_rank")


def latest_of_repeated(rows: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """As ``latest_by`` for wide rows with few repeats: only the keys, and the rows of repeated keys, are shuffled.

    The repeated keys are counted first: a small set is broadcast, a large one is joined by a shuffle.
    """
    repeated = broadcast_if_small(rows.groupBy(*keys).agg(F.count("*").alias("_n")).where("_n > 1").select(*keys))
    again = latest_by(rows.join(repeated, list(keys), "left_semi"), keys, order)
    return rows.join(repeated, list(keys), "left_anti").select(*rows.columns).unionByName(again.select(*rows.columns))


def detect_changes(stored: DataFrame, incoming: DataFrame, keys: Sequence[str] = ("source_id", "path"), content_hash: str = "content_hash") -> DataFrame:
    """``incoming`` with ``change``: ``new``, ``changed`` or ``same`` against the stored hash (a null hash never counts as same)."""
    old = stored.select(*keys, F.col(content_hash).alias("_old"), F.lit(True).alias("_known"))
    matched = [incoming[k].eqNullSafe(old[k]) for k in keys]
    joined = incoming.join(old, reduce(lambda a, b: a & b, matched), "left").select(incoming["*"], "_old", "_known")
    change = F.when(F.col("_known").isNull(), "new").when(F.col("_old") == F.col(content_hash), "same").otherwise("changed")
    return joined.withColumn("change", change).drop("_old", "_known")


def upsert(stored: DataFrame, incoming: DataFrame, keys: Sequence[str], update: Sequence[str]) -> DataFrame:
    """Stored rows with ``update`` columns taken from matching incoming rows, plus new incoming rows; other columns are kept.

    ``incoming`` must hold each key once.
    """
    new = incoming.select(*[F.col(c).alias(f"_new_{c}") for c in incoming.columns], F.lit(True).alias("_in"))
    on = reduce(lambda a, b: a & b, [stored[k].eqNullSafe(new[f"_new_{k}"]) for k in keys])
    both = stored.withColumn("_st", F.lit(True)).join(new, on, "full_outer")
    columns = []
    for c in stored.columns:
        fresh = F.col(f"_new_{c}") if c in incoming.columns else F.lit(None)
        columns.append((F.when(F.col("_in").isNotNull() & (F.lit(c in update) | F.col("_st").isNull()), fresh).otherwise(F.col(c))).alias(c))
    return both.select(*columns)


def replace_chunks(chunks: DataFrame, changed_documents: DataFrame, new_chunks: DataFrame, document: str = "document_id") -> DataFrame:
    """Chunks of changed documents removed, the new ones added."""
    kept = chunks.join(changed_documents.select(document).distinct(), document, "left_anti")
    return kept.unionByName(new_chunks, allowMissingColumns=True)


def dedupe_ids(rows: DataFrame, key: str = "id", order: Sequence[str] = ("created_at",)) -> DataFrame:
    """Of rows repeated under one key the latest."""
    return latest_by(rows.where(F.col(key).isNotNull()), [key], order)


class Snapshots:
    """Tables as numbered parquet snapshots below a root, each with a mark of its own once it is whole."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def current(self, name: str) -> int:
        """Number of the newest whole snapshot, 0 when there is none."""
        folder = self.path(f"{self.root}/{name}")
        if not self.files.exists(folder):
            return 0
        marks = [re.fullmatch(r"v(\d+)\.done", file.getPath().getName()) for file in self.files.listStatus(folder)]
        return max((int(m[1]) for m in marks if m), default=0)

    def read(self, name: str) -> DataFrame | None:
        n = self.current(name)
        return self.spark.read.parquet(f"{self.root}/{name}/v{n}") if n else None

    def write(self, name: str, rows: DataFrame) -> int:
        """Write the next snapshot, then its mark; the previous snapshot stays readable. What a lost job left is written over."""
        n = self.current(name) + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}/v{n}")
        self._mark(name, n)
        return n

    def _mark(self, name: str, n: int) -> None:
        self.files.create(self.path(f"{self.root}/{name}/v{n}.done"), True).close()
