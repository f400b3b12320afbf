"""Queries over candidates, win probabilities, pairs and attached columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import views
from duelframe.catalog import query
from duelframe.catalog.shared import (
    CAND, K, PAIRS, PROB, PROBABILITIES, STATS, pairs, probabilities, r6, s6, score_table, statistics,
)
from duelframe.operators import candidates, joins


@query(
    "join_prompt_responses",
    f"WITH {CAND} SELECT prompt_idx, sample_id, url AS prompt, response FROM cand JOIN pages ON page_id = prompt_idx",
)
def join_prompt_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.join_prompt_responses(views.prompts(spark, sf_dir), views.responses(spark, sf_dir))


@query(
    "join_prompt_scores",
    f"WITH {CAND} SELECT prompt_idx, sample_id, response, {s6('score')} AS score FROM cand",
)
def join_prompt_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.join_prompt_scores(
        views.responses(spark, sf_dir), views.scores(spark, sf_dir)
    ).withColumn("score", r6("score"))


@query("pairwise_self_join", f"WITH {PROB} SELECT prompt_idx, i, j, {s6('prob')} AS prob FROM prob")
def pairwise_self_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return candidates.candidate_pairs(score_table(spark, sf_dir)).withColumn("prob", r6("prob"))


@query(
    "win_prob_matrix",
    f"""WITH {PROB} SELECT prompt_idx, i, """
    + ", ".join(f"{s6(f'max(prob) FILTER (j = {j})')} AS against_{j}" for j in range(K))
    + " FROM prob GROUP BY prompt_idx, i",
)
def win_prob_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    matrix = score_table(spark, sf_dir).select(
        "prompt_idx", F.posexplode(candidates.win_prob_matrix(F.col("scores"))).alias("i", "_row")
    ).filter(F.get("_row", F.col("i")).isNotNull())
    return matrix.select(
        "prompt_idx", "i", *[r6(F.get("_row", F.lit(j))).alias(f"against_{j}") for j in range(K)]
    )


@query("mean_win_rate", f"WITH {PROB} SELECT prompt_idx, i AS sample_id, {s6('win')} AS win_rate FROM win")
def mean_win_rate(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.col("scores")
    rates = F.transform(scores, lambda own: F.when(own.isNotNull(), candidates.mean_win_rate(own, scores)))
    return (
        score_table(spark, sf_dir)
        .select("prompt_idx", F.posexplode(rates).alias("sample_id", "win_rate"))
        .filter(F.col("win_rate").isNotNull())
        .withColumn("win_rate", r6("win_rate"))
    )


@query("best_worst", f"WITH {STATS} SELECT prompt_idx, best, worst FROM stats")
def best_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    scores = F.col("scores")
    return score_table(spark, sf_dir).select(
        "prompt_idx",
        candidates.best_index(scores).alias("best"),
        candidates.worst_index(scores).alias("worst"),
    )


@query("drop_degenerate_pairs", f"WITH {STATS} SELECT prompt_idx, best, worst FROM stats WHERE best <> worst")
def drop_degenerate_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = candidates.drop_degenerate_pairs(statistics(spark, sf_dir))
    return kept.select("prompt_idx", "best", "worst")


@query(
    "build_pairs",
    f"""WITH {PAIRS} SELECT prompt_idx, prompt, chosen, rejected, best, worst, {PROBABILITIES} FROM pairs""",
)
def build_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).select(
        "prompt_idx",
        F.get("chosen", F.lit(0))["content"].alias("prompt"),
        F.get("chosen", F.lit(1))["content"].alias("chosen"),
        F.get("rejected", F.lit(1))["content"].alias("rejected"),
        "best",
        "worst",
        *probabilities(),
    )


@query(
    "add_reference_response",
    f"""WITH {STATS} SELECT prompt_idx, best, worst, html AS reference_response
    FROM stats JOIN pages ON page_id = prompt_idx""",
)
def add_reference_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    reference = views.load(spark, sf_dir, "pages").select(
        F.col("page_id").alias("prompt_idx"), F.col("html").alias("reference_response")
    )
    attached = joins.add_reference_response(statistics(spark, sf_dir), reference, "sppo_forward")
    return attached.select("prompt_idx", "best", "worst", "reference_response")


_LINE = {
    "reference_chosen_logps": "l_quantity + 10 * l_discount",
    "reference_rejected_logps": "l_quantity + l_linenumber - 10 * l_discount",
    "last_iterate_chosen_logps": "l_quantity + 10 * l_tax",
    "last_iterate_rejected_logps": "l_quantity + l_linenumber + 10 * l_tax",
}


@query(
    "attach_ref_logps",
    "SELECT l_orderkey AS pair_id, count(*) AS n_lines, "
    + ", ".join(f"{s6(f'sum(-({value}))')} AS {name}" for name, value in _LINE.items())
    + " FROM lineitem GROUP BY l_orderkey",
)
def attach_ref_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as pairs; the lines of an order sum to its log-probabilities."""
    lines = views.load(spark, sf_dir, "lineitem").withColumnRenamed("l_orderkey", "pair_id")
    pair_table = lines.groupBy("pair_id").agg(F.count(F.lit(1)).alias("n_lines"))
    logps = lines.groupBy("pair_id").agg(
        *[r6(F.sum(F.expr(f"-({value})"))).alias(name) for name, value in _LINE.items()]
    )
    return joins.attach_ref_logps(pair_table, logps)
