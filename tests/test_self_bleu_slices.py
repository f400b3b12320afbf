"""Self-BLEU counts batches in slices of a bounded number of tokens."""

import random

import pyarrow as pa

from duelframe.operators import diversity

RESPONSES = "prompt_idx long, sample_id int, response string"


def test_slices_hold_a_bounded_number_of_tokens():
    ids = [[[7] * 3, None], [[7] * 4, [7] * 4], [None, None], [[7] * 30, []], [[7], [7]], [[], []]]
    columns = [pa.array([row[i] for row in ids], pa.list_(pa.int64())) for i in range(2)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(6)), *columns], names=["prompt_idx", "_ids0", "_ids1"])
    found = [part.column("prompt_idx").to_pylist() for part in diversity._slices(batch, ["_ids0", "_ids1"], 11)]
    assert found == [[0, 1, 2], [3], [4, 5]]
    assert list(diversity._slices(batch.slice(0, 0), ["_ids0", "_ids1"], 11)) == []


def test_slices_change_no_score(spark, monkeypatch):
    rng = random.Random(4)
    rows = [(p, j, " ".join(rng.choices("abc", k=rng.randint(0, 40)))) for p in range(60) for j in range(3) if rng.random() < 0.9]
    table = spark.createDataFrame(rows, RESPONSES)
    whole = sorted(map(tuple, diversity.self_bleu(table, 3).collect()))
    monkeypatch.setattr(diversity, "SLICE_TOKENS", 50)
    sliced = diversity.self_bleu(table, 3)
    assert sorted(map(tuple, sliced.collect())) == whole and len(whole) == len(rows)
