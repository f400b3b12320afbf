"""Scorers, judges, win rates, progress reports and result series."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.columns import hash_order, quotient
from duelframe.indexing import running_total_before
from duelframe.session import materialize


def score_candidates(
    df: DataFrame,
    make_scorer: Callable[[], Callable[[pd.DataFrame], Sequence[float]]],
    keys: Sequence[str] = ("prompt_idx", "sample_id"),
    inputs: Sequence[str] = ("prompt", "response"),
    output: str = "score",
) -> DataFrame:
    """Keyed scores from a caller's model.

    ``make_scorer`` runs once per task (to load a model); the scorer gets the input
    columns of an Arrow batch and returns one number per row.
    """
    kinds = [f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = make_scorer()
        for batch in batches:
            scored = batch[list(keys)].copy()
            scored[output] = [float(x) for x in scorer(batch[list(inputs)])]
            yield scored

    return df.select(*keys, *inputs).mapInPandas(run, ", ".join([*kinds, f"`{output}` double"]))


def rank_to_prob(rank: Column) -> Column:
    """Judge verdict to win probability of the first response: 0 won, 1 lost, else even."""
    return F.when(rank == 0, 1.0).when(rank == 1, 0.0).otherwise(0.5)


def order_is_swapped(seed: int, keys: Sequence[str]) -> Column:
    """Whether a request is shown with its two responses in opposite order: a repeatable coin toss."""
    return F.substring(hash_order(seed, *keys), 1, 1) < "8"


def regroup_judgements(
    requests: DataFrame,
    make_judge: Callable[[], Callable[[pd.DataFrame], Sequence[float]]],
    keys: Sequence[str] = ("worker_id", "prompt_idx"),
    inputs: Sequence[str] = ("prompt", "first", "second"),
    shuffle_seed: int | None = None,
    return_scores: bool = False,
) -> DataFrame:
    """Judge the requests of all workers; the key brings every verdict back to its sender.

    Gives the keys, ``rank`` and ``prob``, the win probability of the response that is first in
    the request. A judge gives ranks, or with ``return_scores`` that probability for the response
    it sees first; then there is no ``rank``. With a ``shuffle_seed`` the judge sees the last two
    inputs of about every second request in opposite order, named by the column ``swapped``, and
    its verdicts are turned round, so that a preference for a place cancels out.
    """
    told = [*keys]
    if shuffle_seed is not None:
        *_, first, second = inputs
        told.append("swapped")
        requests = requests.withColumn("swapped", order_is_swapped(shuffle_seed, keys)).withColumns(
            {
                first: F.when(F.col("swapped"), F.col(second)).otherwise(F.col(first)),
                second: F.when(F.col("swapped"), F.col(first)).otherwise(F.col(second)),
            }
        )
    judged = score_candidates(requests, make_judge, told, inputs, "_verdict")
    swapped = F.col("swapped") if shuffle_seed is not None else F.lit(False)
    verdict = F.col("_verdict")
    if return_scores:
        return judged.withColumn("prob", F.when(swapped, 1 - verdict).otherwise(verdict)).drop("_verdict")
    rank = F.when(swapped & verdict.isin(0, 1), 1 - verdict).otherwise(verdict).cast("int")
    return judged.withColumn("rank", rank).withColumn("prob", rank_to_prob(F.col("rank"))).drop("_verdict")


def win_rate(judged: DataFrame, by: str = "generator") -> DataFrame:
    """Mean and spread of ``prob`` and mean output length per generator."""
    return judged.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_judged"),
        F.avg("prob").alias("win_rate"),
        F.stddev("prob").alias("win_stddev"),
        F.avg("output_length").alias("mean_length"),
    )


def generation_summary(log: DataFrame, by: str = "generator") -> DataFrame:
    """Outputs, mean length and time per generator from rows ``(generator, length, seconds)``."""
    return log.groupBy(by).agg(
        F.count(F.lit(1)).alias("n_outputs"),
        F.avg("length").alias("mean_length"),
        F.sum("seconds").alias("total_seconds"),
        F.avg("seconds").alias("seconds_per_item"),
    )


def generation_progress(log: DataFrame, every: int, index_col: str = "row_idx") -> DataFrame:
    """A progress line after every ``every`` outputs and after the last one.

    Rows ``(row_idx, seconds)`` give ``(report, n_done, elapsed, seconds_per_item, eta)``.
    """
    blocks = materialize(
        log.withColumn("report", quotient(F.col(index_col), every))
        .groupBy("report")
        .agg(F.sum("seconds").alias("_seconds"), F.count(F.lit(1)).alias("_rows")),
        "reports",
    )
    # One row per block; blocks may have gaps, so rows are counted as seconds are.
    seconds = running_total_before(blocks, "report", F.col("_seconds"), "_before")
    rows = running_total_before(blocks.select("report", F.col("_rows").alias("_n")), "report", F.col("_n"), "_done")
    running = seconds.join(rows, "report")
    total = blocks.agg(F.coalesce(F.sum("_rows"), F.lit(0))).first()[0]
    per_item = F.col("elapsed") / F.col("n_done")
    return running.select(
        "report",
        (F.col("_done") + F.col("_rows")).alias("n_done"),
        (F.col("_before") + F.col("_seconds")).alias("elapsed"),
    ).withColumns({"seconds_per_item": per_item, "eta": per_item * (F.lit(total) - F.col("n_done"))})


def result_series(judged: DataFrame) -> DataFrame:
    """Rate and length per run and iteration, with the change from the iteration before
    and the run's best iteration (the earliest one on equal rates).

    Rows ``(run, iteration, prob, output_length)`` are aggregated first, so the windows
    see one row per iteration.
    """
    points = judged.groupBy("run", "iteration").agg(
        (F.avg("prob") * 100).alias("rate"),
        (F.count_if(F.col("prob") > 0.5) / F.count(F.lit(1)) * 100).alias("win_share"),
        F.avg("output_length").alias("mean_length"),
    )
    in_order = Window.partitionBy("run").orderBy("iteration")
    whole = Window.partitionBy("run")
    best = F.max_by("iteration", F.struct(F.round("rate", 6), -F.col("iteration")))
    return points.withColumns(
        {
            "rate_change": F.col("rate") - F.lag("rate").over(in_order),
            "best_iteration": best.over(whole),
        }
    )
