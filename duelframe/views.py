"""Stand-in tables: the test tables shaped like the inputs of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe.functions.columns import quotient

CANDIDATES = 5


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _candidate_key(key: str = "doc_id") -> list:
    return [
        quotient(F.col(key), CANDIDATES).alias("prompt_idx"),
        (F.col(key) % CANDIDATES).cast("int").alias("sample_id"),
    ]


def prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One prompt per page address."""
    return load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("prompt_idx"), F.col("url").alias("prompt")
    )


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five consecutive documents are the candidates of one prompt."""
    return load(spark, sf_dir, "documents").select(
        *_candidate_key(), F.col("text").alias("response")
    )


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "documents").select(
        *_candidate_key(), F.log(F.lit(1) + F.col("n_chars")).alias("score")
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return load(spark, sf_dir, "conversations").select(
        "conv_id", "turn", "role", F.col("text").alias("content")
    )


def pair_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines read as log-probabilities of chosen and rejected responses."""
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    d, t = F.col("l_discount"), F.col("l_tax")
    return load(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("pair_id"),
        (F.col("l_orderkey") % 100).alias("batch_id"),
        (-q).alias("pc"),
        (-(q + n)).alias("pr"),
        (-(q + d * 10)).alias("rc"),
        (-(q + n - d * 10)).alias("rr"),
        (-(q + t * 10)).alias("lc"),
        (-(q + n + t * 10)).alias("lr"),
        (d + 0.5).alias("p"),
        (d + 0.5).alias("pw"),
        (F.lit(0.5) - d).alias("pl"),
        d.alias("logits_chosen"),
        t.alias("logits_rejected"),
    )


def token_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eight consecutive vectors are the positions of one sequence; label 0 is masked."""
    return load(spark, sf_dir, "embeddings").select(
        quotient(F.col("vec_id"), 8).alias("seq_id"),
        (F.col("vec_id") % 8).cast("int").alias("pos"),
        F.col("embedding").alias("logits"),
        F.when(F.col("label") == 0, F.lit(-100)).otherwise(F.col("label")).alias("label"),
    )


def judgements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Judged documents: source as generator, quality as the judge's verdict."""
    documents = load(spark, sf_dir, "documents").select(
        "doc_id", "lang", "source", F.length("text").alias("output_length")
    )
    labels = load(spark, sf_dir, "labels").select(
        "doc_id", (F.lit(1) - F.col("quality")).alias("rank")
    )
    return documents.join(labels, "doc_id")
