"""The two main table paths: one offline round, and pairs to training rows."""

from __future__ import annotations

from pyspark.sql import DataFrame

from duelframe.operators.candidates import build_pairs, pair_statistics, score_arrays
from duelframe.operators.chat import format_pairs, prune_and_rename
from duelframe.operators.tokens import Encode, Limits, tokenize_pairs, word_ids


def offline_round(prompts: DataFrame, responses: DataFrame, scores: DataFrame, k: int, partial: bool = False) -> DataFrame:
    """Prompts, sampled responses and their scores to preference pairs.

    Scores are reduced to one narrow row per prompt before they meet the texts. With ``partial``
    a prompt may lack samples.
    """
    return build_pairs(prompts, responses, pair_statistics(score_arrays(scores, k, partial)))


def training_rows(
    pairs: DataFrame,
    bos: int,
    eos: int,
    template: str = "default",
    limits: Limits = Limits(),
    encode: Encode = word_ids,
) -> DataFrame:
    """Preference pairs to tokenized training rows, row by row without a shuffle."""
    formatted = prune_and_rename(format_pairs(pairs, template))
    return tokenize_pairs(formatted, bos, eos, limits, encode)
