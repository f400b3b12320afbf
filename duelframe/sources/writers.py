"""Writers for shards, pair splits, probability matrices and evaluation outputs."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions.columns import checked, named_key, quotient
from duelframe.operators.slicing import SHUFFLE_SEED, TEST_ROWS, sample_n


def write_response_shards(responses: DataFrame, path: str, frac_len: int) -> None:
    """One JSON array of responses per (shard, sample), each at most ``frac_len`` long.

    A place in the array is all that is left of a prompt's number, so a sample that lacks a response
    before the end of its shard, or has one twice, stops the job.
    """
    placed = responses.withColumn("shard", quotient(F.col("prompt_idx"), frac_len))
    in_order = F.sort_array(F.collect_list(F.struct("prompt_idx", "response")))
    shards = placed.groupBy("shard", "sample_id").agg(in_order.alias("_rows"))
    in_place = F.transform("_rows", lambda row, i: row["prompt_idx"] - F.col("shard") * frac_len == i)
    problem = named_key("responses of a shard are repeated or have gaps", "shard", "sample_id")
    whole = checked(shards, F.forall(in_place, lambda fits: fits), problem).select(
        "shard", "sample_id", F.to_json(F.transform("_rows", lambda row: row["response"])).alias("value")
    )
    whole.write.partitionBy("shard", "sample_id").text(path)


def write_pairs(
    pairs: DataFrame, folder: str, test_rows: int = TEST_ROWS, seed: int = SHUFFLE_SEED
) -> None:
    """``train.parquet`` with all pairs and ``test.parquet`` with a sample of them.

    The sample repeats training rows, as downstream tools expect a test split to exist;
    it is not fit for evaluation.
    """
    pairs.write.parquet(f"{folder}/train.parquet")
    ensure_test_split(pairs.sparkSession, folder, test_rows, seed)


def ensure_test_split(
    spark: SparkSession, folder: str, test_rows: int = TEST_ROWS, seed: int = SHUFFLE_SEED
) -> DataFrame:
    """The test split of a folder, sampled from its training rows when it is not there."""
    path = f"{folder}/test.parquet"
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    train = spark.read.parquet(f"{folder}/train.parquet")
    sample_n(train, test_rows, ["prompt_idx"], seed).write.parquet(path)
    return spark.read.parquet(path)


def write_eval_outputs(outputs: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines."""
    outputs.select("instruction", "output", "generator").write.json(path)


def write_prob_matrix(matrices: DataFrame, path: str) -> None:
    """``(prompt_idx, probability)`` rows as JSON lines, the matrix as nested arrays."""
    matrices.select("prompt_idx", "probability").write.json(path)


def dataset_name(output_dir: Column) -> Column:
    """Name of the pair dataset: the output name without its first dash-separated token."""
    return F.concat(
        F.lit("synthetic_data_"), F.regexp_replace(output_dir, "^[^-]*-?", ""), F.lit("_score")
    )
