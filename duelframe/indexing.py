"""Row positions and running totals that never pass through a single task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.columns import quotient
from duelframe.session import materialize

# Ids per bucket in a running total: bounds the rows one window group can hold.
BUCKET_WIDTH = 4096
# monotonically_increasing_id keeps the row's position in its partition in the low 33 bits.
_POSITION_BITS = (1 << 33) - 1


def index_rows(df: DataFrame, order_cols: list[str | Column], index_col: str = "row_idx") -> DataFrame:
    """Add a dense 0-based long position in the order of ``order_cols``.

    ``order_cols`` must identify a row. One range shuffle sorts the rows, the sorted
    table is written once so the partition layout is fixed, and each partition's
    start is added from a table with one row per partition.
    """
    ordered = (
        df.repartitionByRange(*order_cols)
        .sortWithinPartitions(*order_cols)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_local", F.monotonically_increasing_id().bitwiseAND(F.lit(_POSITION_BITS)))
    )
    stored = materialize(ordered, "indexed")
    by_part = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = (
        stored.groupBy("_part")
        .agg(F.count(F.lit(1)).alias("_rows"))
        .select("_part", F.coalesce(F.sum("_rows").over(by_part), F.lit(0)).alias("_start"))
    )
    # One row per shuffle partition, so its size is fixed by the session settings.
    return (
        stored.join(F.broadcast(starts), "_part")
        .withColumn(index_col, F.col("_start") + F.col("_local"))
        .drop("_part", "_local", "_start")
    )


def running_total_before(df: DataFrame, id_col: str, value: Column, out: str) -> DataFrame:
    """Add the sum of ``value`` over all rows with a smaller ``id_col``.

    ``id_col`` holds unique non-negative longs. Totals are taken over three levels
    of ``BUCKET_WIDTH``-wide id ranges, so every window group has at most that many
    rows and the last level has one row per ``BUCKET_WIDTH ** 2`` ids. ``df`` is read
    twice, so it should be narrow and stored.
    """
    before = (Window.unboundedPreceding, -1)
    leveled = (
        df.withColumn("_value", value)
        .withColumn("_bucket", quotient(F.col(id_col), BUCKET_WIDTH))
    )
    buckets = materialize(
        leveled.groupBy("_bucket")
        .agg(F.sum("_value").alias("_bucket_total"))
        .withColumn("_block", quotient(F.col("_bucket"), BUCKET_WIDTH)),
        "buckets",
    )
    blocks = buckets.groupBy("_block").agg(F.sum("_bucket_total").alias("_block_total"))
    block_starts = blocks.select(
        "_block",
        F.coalesce(
            F.sum("_block_total").over(Window.orderBy("_block").rowsBetween(*before)), F.lit(0)
        ).alias("_block_start"),
    )
    bucket_starts = buckets.join(block_starts, "_block").select(
        "_bucket",
        (
            F.col("_block_start")
            + F.coalesce(
                F.sum("_bucket_total").over(
                    Window.partitionBy("_block").orderBy("_bucket").rowsBetween(*before)
                ),
                F.lit(0),
            )
        ).alias("_bucket_start"),
    )
    within = F.sum("_value").over(
        Window.partitionBy("_bucket").orderBy(id_col).rowsBetween(*before)
    )
    return (
        leveled.join(bucket_starts, "_bucket")
        .withColumn(out, F.col("_bucket_start") + F.coalesce(within, F.lit(0)))
        .drop("_bucket", "_value", "_bucket_start")
    )
