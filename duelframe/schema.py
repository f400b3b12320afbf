"""Column names shared by several modules and the column presence check."""

from __future__ import annotations

from pyspark.sql import DataFrame

PROBABILITY_COLUMNS = ("chosen_probs", "chosen_probs_win", "chosen_probs_lose")


def require_columns(df: DataFrame, *names: str) -> DataFrame:
    """Return ``df``, or raise when one of ``names`` is missing."""
    missing = [name for name in names if name not in df.columns]
    if missing:
        raise ValueError(f"missing columns {missing}; found {df.columns}")
    return df
