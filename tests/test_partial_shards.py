"""Response shards in which some samples end before others."""

import json

import pytest
from pyspark.errors import PySparkException

from duelframe.sources import readers, writers

RESPONSES = "prompt_idx long, sample_id int, response string"


def test_only_the_last_shard_may_be_short(spark, tmp_path):
    def shards(name, lengths):
        (tmp_path / name).mkdir()
        for (shard, sample), n in lengths.items():
            (tmp_path / name / f"responses_{shard}_{sample}.json").write_text(json.dumps([f"{shard}{sample}{i}" for i in range(n)]))
        return readers.scan_response_shards(spark, str(tmp_path / name))

    short = shards("short", {(0, 0): 2, (0, 1): 2, (0, 2): 2, (1, 0): 2, (1, 1): 1})
    with pytest.raises(ValueError, match="place 1"):
        readers.combine_shards(short)
    found = sorted(tuple(r) for r in readers.combine_shards(short, short_end=True).collect())
    assert [row[:2] for row in found] == [(0, 0), (0, 1), (0, 2), (1, 0), (1, 1), (1, 2), (2, 0), (2, 1), (3, 0)]
    with pytest.raises(ValueError, match="place 0"):
        readers.combine_shards(shards("inner", {(0, 0): 2, (0, 1): 1, (1, 0): 2, (1, 1): 2}), short_end=True)


@pytest.mark.parametrize("prompts", [[0, 2], [1], [0, 0], [0, 0, 2]])
def test_responses_out_of_place_are_not_written(spark, tmp_path, prompts):
    table = spark.createDataFrame([(p, 0, f"{i}") for i, p in enumerate(prompts)], RESPONSES)
    with pytest.raises(PySparkException, match="repeated or have gaps: shard=0 sample_id=0"):
        writers.write_response_shards(table, str(tmp_path / "out"), 5)
