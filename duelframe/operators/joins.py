"""Columns attached from another table by key, with every row accounted for."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.functions.columns import checked, named_key

REFERENCE_LOGPS = (
    "reference_chosen_logps",
    "reference_rejected_logps",
    "last_iterate_chosen_logps",
    "last_iterate_rejected_logps",
)


def attach_columns(
    left: DataFrame, right: DataFrame, keys: Sequence[str], columns: Sequence[str]
) -> DataFrame:
    """Add ``columns`` of ``right`` to ``left``.

    A left row without a match stops the job, and so does one whose key ``right`` repeats:
    either would change which rows there are. Keys are counted in the aggregation that
    brings ``right`` to one row per key, before the join.
    """
    addition = right.groupBy(*keys).agg(*[F.first(name).alias(name) for name in columns], F.count(F.lit(1)).alias("_matches"))
    joined = left.join(addition, list(keys), "left")
    found = checked(joined, F.col("_matches").isNotNull(), named_key("no row to attach for", *keys))
    once = checked(found, F.col("_matches") == 1, named_key("several rows to attach for", *keys))
    return once.drop("_matches")


def add_reference_response(
    df: DataFrame, reference: DataFrame, loss_type: str, key: str = "prompt_idx"
) -> DataFrame:
    """Attach ``reference_response`` where the loss is the plain forward one."""
    needed = "forward" in loss_type and "importance" not in loss_type and "reverse" not in loss_type
    return attach_columns(df, reference, [key], ["reference_response"]) if needed else df


def attach_ref_logps(
    pairs: DataFrame,
    logps: DataFrame,
    keys: Sequence[str] = ("pair_id",),
    columns: Sequence[str] = REFERENCE_LOGPS,
) -> DataFrame:
    """Attach precomputed log-probabilities: all four columns, or the two reference ones
    (``REFERENCE_LOGPS[:2]``) of unregularized training."""
    return attach_columns(pairs, logps, keys, columns)
