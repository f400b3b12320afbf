"""Means of a metric stream: by time window, and between log events."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from duelframe.session import scratch_path


def windowed_means(stream: DataFrame, window: str, delay: str) -> DataFrame:
    """Mean of every ``key`` per tumbling window over rows ``(ts, key, value)``.

    A window closes once the newest timestamp is ``delay`` past its end; rows that come
    for it afterwards are left out. The state holds the open windows only.
    """
    return (
        stream.withWatermark("ts", delay)
        .groupBy(F.window("ts", window).alias("_window"), "key")
        .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_values"))
        .select(
            F.col("_window.start").alias("window_start"),
            F.col("_window.end").alias("window_end"),
            "key",
            "value",
            "n_values",
        )
    )


LOGGED = "run string, split string, step long, key string, value double, n_values long"
_STORED = "step long, keys array<string>, sums array<double>, counts array<long>"


def _means_until_log(group: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Values of one run and split add up in the state; a log event gives their means and clears it."""
    last, *stored = state.get if state.exists else (None, [], [], [])
    stored = pd.DataFrame({"key": stored[0], "sum": stored[1], "count": stored[2]}).assign(event=0)
    events, sums = set(), []
    for batch in batches:  # rows come in no order; one row for each step and key is kept
        logged = batch["key"].isna()
        if last is not None and batch["step"].min() <= last:
            raise ValueError(f"step {batch['step'].min()} of {group} comes after the log event of step {last}")
        events.update(batch["step"][logged].tolist())
        sums.append(batch[~logged].groupby(["step", "key"])["value"].agg(["sum", "count"]).reset_index())
    order = sorted(events)
    found = pd.concat(sums)
    # The number of the event that closes a step; one more than there are for steps still open.
    found["event"] = np.searchsorted(order, found["step"])
    totals = pd.concat([stored, found.drop(columns="step")]).groupby(["event", "key"])[["sum", "count"]].sum().reset_index()
    totals["count"] = totals["count"].astype("int64")
    closed, waiting = totals[totals["event"] < len(order)], totals[totals["event"] == len(order)]
    state.update((order[-1] if order else last, *[waiting[c].tolist() for c in ("key", "sum", "count")]))
    means = {"step": [order[i] for i in closed["event"]], "key": closed["key"], "value": closed["sum"] / closed["count"], "n_values": closed["count"]}
    yield pd.DataFrame(means).assign(run=group[0], split=group[1])[["run", "split", "step", "key", "value", "n_values"]]


def means_at_log_events(stream: DataFrame) -> DataFrame:
    """Mean of the values of every ``key`` since the last log event, at each log event.

    Rows are ``(run, split, step, key, value)``; a row without a key is a log event of its run and split, after the
    values of the same step. Gives ``(run, split, step, key, value, n_values)``, the step being
    that of the event. Keys without a value since the last event give no row, values behind the
    last event wait in the state, which holds a sum and a count for each key. Steps may come
    in any order within a batch, but not in a batch after the event that closes them; such a row
    stops the query.
    """
    return stream.groupBy("run", "split").applyInPandasWithState(_means_until_log, LOGGED, _STORED, "append", GroupStateTimeout.NoTimeout)


def run_to_table(means: DataFrame, path: str | None = None) -> DataFrame:
    """Process everything available now and return the closed windows.

    Output and progress go below ``path``, a folder all executors reach: a run that is
    started again with the same path goes on where the last one stopped and repeats no
    window. Without a path the run is one of its own, in the shared folder. Windows still
    open at the watermark are held back in the state and come out of a later run.
    """
    spark = means.sparkSession
    path = path or scratch_path(spark, "metrics")
    (
        means.writeStream.format("parquet")
        .option("path", f"{path}/rows")
        .option("checkpointLocation", f"{path}/progress")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
        .awaitTermination()
    )
    return spark.read.schema(means.schema).parquet(f"{path}/rows")
