"""Session defaults and the shared folder intermediate tables are written to."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_local_folders: dict[str, str] = {}


def build_session(master: str | None = None, app_name: str = "duelframe", **conf: object) -> SparkSession:
    """Session with adaptive execution on; anything in ``conf`` overrides the defaults.

    Partition counts are left to adaptive coalescing: a cluster sets a high
    ``spark.sql.shuffle.partitions`` and small inputs shrink back at run time.
    """
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.ui.showConsoleProgress": "false",
        # Recording the Python call site of every column costs more than small queries do.
        "spark.python.sql.dataFrameDebugging.enabled": "false",
    }
    settings.update({key: str(value) for key, value in conf.items()})
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder every executor can reach, as named by ``spark.checkpoint.dir``.

    Only a local master may run without the setting; it then gets one temporary
    folder per application.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_folders:
        _local_folders[context.applicationId] = tempfile.mkdtemp(prefix="duelframe-")
    return _local_folders[context.applicationId]


def scratch_path(spark: SparkSession, label: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialize(df: DataFrame, label: str, release: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    The result no longer depends on executor-local shuffle files, and values that
    depend on the physical layout (such as partition numbers) are fixed. With ``release``
    these shuffle files go when it is written, not when the driver collects its garbage.
    """
    spark = df.sparkSession
    path = scratch_path(spark, label)
    if release:
        before = spark.conf.get(_CLEANUP)
        spark.conf.set(_CLEANUP, "true")
        try:
            df.select("*").write.parquet(path)
        finally:
            spark.conf.set(_CLEANUP, before)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


# Rows a checked broadcast may have: a few narrow columns stay far below 100 MB.
BROADCAST_ROWS = 1_000_000


def small_side(df: DataFrame, label: str, max_rows: int = BROADCAST_ROWS) -> DataFrame:
    """Write a narrow table that is expected to be small and mark it for broadcast.

    The rows are counted from the written files; a table beyond ``max_rows`` is
    returned unmarked and joins by shuffle.
    """
    stored = materialize(df, label)
    return F.broadcast(stored) if stored.count() <= max_rows else stored


def spread(df: DataFrame) -> DataFrame:
    """Redistribute a table scan that has fewer splits than the session has task slots.

    Meant in front of work that costs far more than reading. A scan with enough splits,
    as any large table has, is returned unchanged.
    """
    slots = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(slots) if df.rdd.getNumPartitions() < slots else df
