"""Dialogue operators on turn rows ``(conv_id, turn, role, content)``.

These give the same messages as the array forms without gathering a dialogue into
one row, so a dialogue of any length stays spread over tasks.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.operators.chat import TEMPLATES, render_turn


def mark_last_turn(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Add ``is_last``; the last turn number per dialogue is combined before the shuffle."""
    last = turns.groupBy(key).agg(F.max("turn").alias("_last"))
    return (
        turns.join(last, key).withColumn("is_last", F.col("turn") == F.col("_last")).drop("_last")
    )


def prompt_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """All turns but the last of every dialogue."""
    return mark_last_turn(turns, key).filter(~F.col("is_last")).drop("is_last")


def ensure_system_turn(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Put an empty system turn, numbered -1, in front of dialogues that start otherwise."""
    opening = turns.groupBy(key).agg(F.min_by("role", "turn").alias("_first_role"))
    added = opening.filter(~F.col("_first_role").eqNullSafe("system")).select(
        key,
        F.lit(-1).cast(turns.schema["turn"].dataType).alias("turn"),
        F.lit("system").alias("role"),
        F.lit("").alias("content"),
    )
    return turns.select(key, "turn", "role", "content").unionByName(added)


def render_turns(turns: DataFrame, template: str = "default") -> DataFrame:
    """Add ``piece``, the text each turn contributes to the rendered dialogue."""
    form = TEMPLATES[template]
    return turns.withColumn("piece", render_turn(F.col("role"), F.col("content"), form))
