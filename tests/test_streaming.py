import datetime as dt

import pytest
from pyspark.errors import StreamingQueryException

from duelframe.plans.losses import metric_log_mean
from duelframe.streaming.metrics import means_at_log_events, run_to_table, windowed_means

SCHEMA = "ts timestamp, key string, value double"


def _write(spark, path, rows):
    at = dt.datetime(2024, 1, 1)
    table = [(at + dt.timedelta(minutes=m), key, float(v)) for m, key, v in rows]
    spark.createDataFrame(table, SCHEMA).coalesce(1).write.mode("append").parquet(path)


def _run(spark, path, files_per_batch):
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    closed = run_to_table(windowed_means(stream, "10 minutes", "5 minutes"))
    return {(r.window_start.minute, r.key): (r.value, r.n_values) for r in closed.collect()}


def test_closed_windows_come_out_once(spark, tmp_path):
    path = str(tmp_path / "log")
    _write(spark, path, [(1, "a", 1), (2, "a", 3), (3, "b", 5), (12, "a", 7), (14, "a", 9), (27, "a", 0)])
    # The newest time is 27, so windows ending at 22 or before are closed.
    expected = {(0, "a"): (2.0, 2), (0, "b"): (5.0, 1), (10, "a"): (8.0, 2)}
    assert _run(spark, path, 10) == expected


def test_rows_behind_the_watermark_are_left_out(spark, tmp_path):
    path = str(tmp_path / "log")
    # The watermark of a batch filters rows from the batch after next on, so the second
    # batch closes the first window and the third one is too late for it.
    _write(spark, path, [(1, "a", 1), (40, "a", 2)])
    _write(spark, path, [(41, "a", 6)])
    _write(spark, path, [(2, "a", 100), (38, "a", 4), (70, "a", 0)])
    got = _run(spark, path, 1)
    assert got == {(0, "a"): (1.0, 1), (30, "a"): (4.0, 1), (40, "a"): (4.0, 2)}


def test_batch_means_cover_every_window(spark):
    rows = [("r", s, i, "k", float(i)) for s in ("train", "eval") for i in range(1, 6)]
    table = spark.createDataFrame(rows, "run string, split string, step long, key string, value double")
    got = {(r.split, r.log_window): r.value for r in metric_log_mean(table, 2).collect()}
    assert got == {(s, w): v for s in ("train", "eval") for w, v in ((1, 1.5), (2, 3.5), (3, 5.0))}


LOG = "run string, split string, step long, key string, value double"


def _log_rows(steps, every):
    rows = [(run, split, i, key, float(i * len(key))) for run in "ab" for split in ("train", "eval") for i in steps for key in ("loss", "reg/x")]
    return rows + [(run, "train", i, None, None) for run in "ab" for i in steps if i % every == 0]


def _append_and_run(spark, folder, rows, files=1):
    table = spark.createDataFrame(rows, LOG)
    table.repartition(files).write.mode("append").parquet(f"{folder}/log")
    stream = spark.readStream.schema(LOG).parquet(f"{folder}/log")
    return sorted(map(tuple, run_to_table(means_at_log_events(stream), str(folder)).collect()))


def test_log_events_give_means_and_clear_them_across_restarts(spark, tmp_path):
    batch = spark.createDataFrame([r for r in _log_rows(range(1, 13), 4) if r[3]], LOG).filter("split = 'train'")
    expected = {(r.run, r.split, 4 * r.log_window, r.key, r.value, r.n_values) for r in metric_log_mean(batch, 4).collect()}
    _append_and_run(spark, tmp_path, _log_rows(range(1, 6), 4), files=3)
    between = _append_and_run(spark, tmp_path, _log_rows(range(6, 8), 4))
    assert {r[2] for r in between} == {4}  # steps 5 to 7 wait in the state
    found = _append_and_run(spark, tmp_path, _log_rows(range(8, 15), 4), files=2)
    assert len(found) == len(expected) and set(found) == expected  # nothing twice, and nothing of a split that is not logged


def test_a_step_behind_its_log_event_stops_the_stream(spark, tmp_path):
    _append_and_run(spark, tmp_path, _log_rows(range(1, 5), 4))
    with pytest.raises(StreamingQueryException, match="comes after the log event"):
        _append_and_run(spark, tmp_path, [("a", "train", 4, "loss", 1.0)])
