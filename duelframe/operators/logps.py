"""Token and sequence log-probabilities from logits tables ``(seq_id, pos, logits, label)``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.operators.tokens import IGNORE_LABEL


def log_softmax_at(logits: Column, label: Column) -> Column:
    """Log-softmax of ``logits`` at position ``label``, shifted by the maximum."""
    values = logits.cast("array<double>")
    top = F.array_max(values)
    spread = F.aggregate(values, F.lit(0.0), lambda total, x: total + F.exp(x - top))
    return F.get(values, label) - top - F.log(spread)


def token_logps(df: DataFrame) -> DataFrame:
    """Add ``logp``; ignored positions get 0."""
    return df.withColumn(
        "logp",
        F.when(F.col("label") == IGNORE_LABEL, F.lit(0.0)).otherwise(
            log_softmax_at(F.col("logits"), F.col("label"))
        ),
    )


def next_token_shift(df: DataFrame) -> DataFrame:
    """Give every position the label of the next one; the last position is dropped.

    A join on ``(seq_id, pos)`` instead of a window: one very long sequence spreads
    over all tasks.
    """
    following = df.select("seq_id", (F.col("pos") - 1).alias("pos"), "label")
    return df.drop("label").join(following, ["seq_id", "pos"])


def sequence_logps(df: DataFrame) -> DataFrame:
    """Sum ``total`` and ``mean`` of ``logp`` over the positions of a sequence with a label.

    A sequence without any such position sums to 0; its mean is NaN.
    """
    counted = F.col("label") != IGNORE_LABEL
    return (
        df.groupBy("seq_id")
        .agg(F.sum(F.when(counted, F.col("logp"))).alias("_sum"), F.count_if(counted).alias("_n"))
        .select(
            "seq_id",
            F.coalesce("_sum", F.lit(0.0)).alias("total"),
            F.when(F.col("_n") == 0, F.lit(float("nan"))).otherwise(F.col("_sum") / F.col("_n")).alias("mean"),
        )
    )


def sequence_logp(df: DataFrame, average: bool = False) -> DataFrame:
    """``(seq_id, logp)``: the sum, or the mean, over the positions with a label."""
    return sequence_logps(df).select("seq_id", F.col("mean" if average else "total").alias("logp"))


def completion_logps(df: DataFrame, context_length: int) -> DataFrame:
    """Log-probabilities after the context; positions with mask 0 get 0."""
    return (
        token_logps(df.filter(F.col("pos") >= context_length))
        .withColumn("logp", F.when(F.col("mask") == 0, F.lit(0.0)).otherwise(F.col("logp")))
    )
