"""Session settings, table access and lineage cuts shared by every operator."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Most bytes that a side may have to be broadcast.
BROADCAST_BYTES = 32 * 1024 * 1024

_shipped: set[str] = set()


def build_session(app: str = "scriptorium", master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on; on a cluster leave ``master`` to spark-submit."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    for key, value in (settings | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def ship_package(spark: SparkSession) -> None:
    """Send this package's modules to the executors' Python workers, once per application, so that it need not be installed there."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parent
    target = Path(tempfile.mkdtemp(prefix="spark-package-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for module in sorted(root.rglob("*.py")):
            archive.write(module, module.relative_to(root.parent).as_posix())
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def table(spark: SparkSession, root: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``root``."""
    ship_package(spark)
    return spark.read.parquet(f"{root}/{name}.parquet")


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder the cluster names in ``spark.checkpoint.dir``; a temporary one only where it is unset."""
    sc = spark.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpointed(df: DataFrame) -> DataFrame:
    """``df`` computed once and written as a table in the shared checkpoint folder, so later stages neither recompute nor lose it.

    The table goes when the application ends.
    """
    spark = df.sparkSession
    target = f"{ensure_checkpoint_dir(spark)}/table-{uuid.uuid4().hex}"
    path = spark._jvm.org.apache.hadoop.fs.Path(target)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(path)
    df.write.parquet(target)
    return spark.read.schema(df.schema).parquet(target)


def measured_bytes(df: DataFrame) -> int:
    """Bytes of the values of all rows: the length of texts and binaries, 16 for any other column, and 32 for the row."""
    wide = [F.coalesce(F.octet_length(f.name), F.lit(0)) for f in df.schema if f.dataType.simpleString() in ("string", "binary")]
    row = sum(wide, F.lit(32 + 16 * len(df.schema)))
    return df.agg(F.sum(row.cast("long")).alias("n")).first()["n"] or 0


def broadcast_if_small(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` (flat columns) computed once and marked for broadcasting if its measured bytes stay under the bound, else as it is for a
    shuffled join.

    Adaptive execution finds a small side only after the large side's shuffle was started; measuring first spares that shuffle.
    """
    kept = checkpointed(df)
    return F.broadcast(kept) if measured_bytes(kept) <= most else kept


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Give CPU-heavy work behind a scan enough tasks: repartition only when the scan has fewer splits than two per core.

    For scans with filters and projections only: counting the partitions of a plan with shuffles would run them.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * cores:
        return df
    return df.repartition(4 * cores, *keys)
