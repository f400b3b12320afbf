"""Queries over readers and writers. Files are derived from the tables by Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import views
from duelframe.catalog import query
from duelframe.catalog.shared import (
    CAND, PAIRS, PROB, PROBABILITIES, pairs, probabilities, r6, s6, score_table, statistics,
)
from duelframe.functions.columns import quotient
from duelframe.operators.candidates import win_prob_matrix
from duelframe.operators.chat import attach_generator
from duelframe.session import scratch_path
from duelframe.sources import readers, writers

SHARD_ROWS = 50
TEST_SAMPLE = 20


@query(
    "scan_prompts",
    "SELECT row_number() OVER (ORDER BY lang, doc_id) - 1 AS prompt_idx, text AS prompt FROM documents",
)
def scan_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = views.load(spark, sf_dir, "documents").withColumnRenamed("text", "prompt")
    return readers.scan_prompts(table.select("lang", "doc_id", "prompt"), ["lang", "doc_id"])


def _stored_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "shards")
    writers.write_response_shards(views.responses(spark, sf_dir), path, SHARD_ROWS)
    return readers.scan_response_shards(spark, path, partitioned=True)


@query(
    "scan_response_shards",
    f"""WITH {CAND}
    SELECT CAST(prompt_idx // {SHARD_ROWS} AS INTEGER) AS shard, sample_id,
           CAST(prompt_idx % {SHARD_ROWS} AS INTEGER) AS pos, response FROM cand""",
)
def scan_response_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _stored_shards(spark, sf_dir)


# Far below the default, so that the files of the test tables are cut as well.
RANGE = 100_000
LONG_SHARD_ROWS = 400


@query("scan_shard_ranges", f"WITH {CAND} SELECT prompt_idx, sample_id, response FROM cand")
def scan_shard_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Longer shards, the files of which are read by several tasks each."""
    path = scratch_path(spark, "long-shards")
    writers.write_response_shards(views.responses(spark, sf_dir), path, LONG_SHARD_ROWS)
    return readers.combine_shards(readers.scan_response_shards(spark, path, partitioned=True, range_bytes=RANGE), short_end=True)


@query("scan_eval_array", "SELECT text AS instruction, item_id FROM benchmark")
def scan_eval_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of array files, read by several tasks each."""
    path = scratch_path(spark, "eval-arrays")
    records = views.load(spark, sf_dir, "benchmark").select(quotient(F.col("item_id"), 1000).alias("part"), F.struct(F.col("text").alias("instruction"), "item_id").alias("record"))
    records.groupBy("part").agg(F.to_json(F.collect_list("record")).alias("value")).write.partitionBy("part").text(path)
    return readers.scan_eval_set(spark, f"{path}/part=*", "instruction string, item_id long", one_array=True, range_bytes=RANGE // 20)


@query("combine_shards", f"WITH {CAND} SELECT prompt_idx, sample_id, response FROM cand")
def combine_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return readers.combine_shards(_stored_shards(spark, sf_dir), short_end=True)


@query("scan_scores", f"WITH {CAND} SELECT prompt_idx, sample_id, {s6('score')} AS score FROM cand")
def scan_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    shards = views.scores(spark, sf_dir).select(
        quotient(F.col("prompt_idx"), SHARD_ROWS).alias("shard_pos"),
        (F.col("prompt_idx") % SHARD_ROWS).alias("pos"),
        "sample_id",
        "score",
    )
    return readers.scan_scores(shards, SHARD_ROWS, n_shards=8).withColumn("score", r6("score"))


def _stored_pairs(spark: SparkSession, sf_dir: str) -> str:
    folder = scratch_path(spark, "pairs")
    statistics(spark, sf_dir).write.parquet(f"{folder}/train.parquet")
    return folder


_STAT_ROWS = f"SELECT prompt_idx, best, worst, {PROBABILITIES} FROM pairs"


@query("read_split", f"WITH {PAIRS} {_STAT_ROWS.replace('FROM pairs', 'FROM stats')}")
def read_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = readers.read_split(spark, _stored_pairs(spark, sf_dir))
    return stored.select("prompt_idx", "best", "worst", *probabilities())


@query("scan_eval_set", "SELECT text AS instruction, item_id FROM benchmark")
def scan_eval_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "eval")
    table = views.load(spark, sf_dir, "benchmark").withColumnRenamed("text", "instruction")
    table.write.json(path)
    return readers.scan_eval_set(spark, path, "instruction string, item_id long")


def _test_sample(table: str) -> str:
    return f"SELECT prompt_idx FROM {table} ORDER BY md5('42:' || prompt_idx), prompt_idx LIMIT {TEST_SAMPLE}"


@query(
    "write_pairs",
    f"""WITH {PAIRS}, test AS ({_test_sample("pairs")})
    SELECT 'train' AS split, prompt_idx, chosen, rejected, {PROBABILITIES} FROM pairs
    UNION ALL
    SELECT 'test' AS split, prompt_idx, chosen, rejected, {PROBABILITIES} FROM pairs
    WHERE prompt_idx IN (SELECT prompt_idx FROM test)""",
)
def write_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch_path(spark, "written-pairs")
    writers.write_pairs(pairs(spark, sf_dir), folder, TEST_SAMPLE)
    splits = [
        readers.read_split(spark, folder, split).withColumn("split", F.lit(split))
        for split in ("train", "test")
    ]
    return splits[0].unionByName(splits[1]).select(
        "split",
        "prompt_idx",
        F.get("chosen", F.lit(1))["content"].alias("chosen"),
        F.get("rejected", F.lit(1))["content"].alias("rejected"),
        *probabilities(),
    )


@query(
    "write_eval_outputs",
    "SELECT lang AS instruction, trim(text, ' ' || chr(9) || chr(10) || chr(13)) AS output, source AS generator FROM documents",
)
def write_eval_outputs(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "outputs")
    outputs = views.load(spark, sf_dir, "documents").select(
        F.col("lang").alias("instruction"), F.col("text").alias("output"), "source"
    )
    writers.write_eval_outputs(attach_generator(outputs, F.col("source")), path)
    return readers.scan_eval_set(spark, path, "instruction string, output string, generator string")


@query(
    "write_prob_matrix",
    f"WITH {PROB} SELECT prompt_idx, i, j, {s6('prob')} AS prob FROM prob",
)
def write_prob_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "matrix")
    matrices = score_table(spark, sf_dir).select(
        "prompt_idx", win_prob_matrix(F.col("scores")).alias("probability")
    )
    writers.write_prob_matrix(matrices, path)
    stored = spark.read.schema("prompt_idx long, probability array<array<double>>").json(path)
    rows = stored.select("prompt_idx", F.posexplode("probability").alias("i", "_row"))
    cells = rows.select("prompt_idx", "i", F.posexplode("_row").alias("j", "prob")).filter(F.col("prob").isNotNull())
    return cells.withColumn("prob", r6("prob"))


@query(
    "ensure_test_split",
    f"""WITH {PAIRS}, test AS ({_test_sample("stats")})
    {_STAT_ROWS.replace('FROM pairs', 'FROM stats')} WHERE prompt_idx IN (SELECT prompt_idx FROM test)""",
)
def ensure_test_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _stored_pairs(spark, sf_dir)
    made = writers.ensure_test_split(spark, folder, TEST_SAMPLE)
    return made.select("prompt_idx", "best", "worst", *probabilities())


@query(
    "dataset_name",
    """SELECT doc_id, 'synthetic_data_' || lang || '-' || source || '_score' AS dataset_name
    FROM documents""",
)
def dataset_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    output_dir = F.concat(F.lit("data-"), F.col("lang"), F.lit("-"), F.col("source"))
    return views.load(spark, sf_dir, "documents").select(
        "doc_id", writers.dataset_name(output_dir).alias("dataset_name")
    )
