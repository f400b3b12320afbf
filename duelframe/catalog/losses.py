"""Queries over losses, regularizers, rewards and batch metrics."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import views
from duelframe.catalog import query
from duelframe.catalog.shared import r6, s6
from duelframe.functions.columns import quotient
from duelframe.plans import losses
from duelframe.session import materialize, scratch_path, spread
from duelframe.streaming import metrics

BETA = 0.001
REG_COEF = 0.1

LP = """lp AS (
  SELECT l_orderkey AS pair_id, l_orderkey % 100 AS batch_id,
    -l_quantity AS pc, -(l_quantity + l_linenumber) AS pr,
    -(l_quantity + l_discount * 10) AS rc, -(l_quantity + l_linenumber - l_discount * 10) AS rr,
    -(l_quantity + l_tax * 10) AS lc, -(l_quantity + l_linenumber + l_tax * 10) AS lr,
    l_discount + 0.5 AS p, l_discount + 0.5 AS pw, 0.5 - l_discount AS pl,
    l_discount AS logits_chosen, l_tax AS logits_rejected
  FROM lineitem)"""

_DW, _DL = "(pc - rc)", "(pr - rr)"


def _sum_of(form: str) -> str:
    return f"({form.format(d=_DW)} + {form.format(d=_DL)})"


_REVERSE = _sum_of("{d} * {d}")
_FORWARD_10 = _sum_of("exp(least(-{d}, 10.0))")
_FORWARD_5 = _sum_of("exp(least(-{d}, 5.0))")

# loss name -> (what it is read as, SQL of the per-pair value)
REGULARIZERS = {
    "sppo": (("none", None, None), "0.0"),
    "sppo_forwardimportance10": (("forward_importance", 10, None), _FORWARD_10),
    "sppo_reversekl": (("reverse", None, None), _REVERSE),
    "sppo_reverseklnoent": (("cross", None, None), "(-(pc * rc) - (pr * rr))"),
    "sppo_forwardreverse": (("forward_reverse", 10, 1.0), f"({_FORWARD_10} + {_REVERSE})"),
    "sppo_forward1reverse5": (("forward_reverse", 10, 5.0), f"({_FORWARD_10} + 5.0 * {_REVERSE})"),
    "sppo_forward1R5reverse5": (("forward_reverse", 5, 5.0), f"({_FORWARD_5} + 5.0 * {_REVERSE})"),
    "sppo_entropy": (("entropy", None, None), "(pc * pc + pr * pr)"),
    "sppo_chisq10": (("chisq", 10, None), _sum_of("exp(least({d}, 10.0))")),
    "sppo_chisqsm1": (
        ("chisq_smoothed", 10, None),
        _sum_of("exp(least({d}, 10.0)) / (1 + exp(least({d}, 10.0)))"),
    ),
}


def _self_play_sql(beta: float, chosen: str = "lc", rejected: str = "lr") -> str:
    scale = f"(1.0 / CAST({beta} AS DOUBLE))"
    return (
        f"((pow(pc - {chosen} - {scale} * (pw - 0.5), 2)"
        f" + pow(pr - {rejected} - {scale} * (pl - 0.5), 2)) / 2)"
    )


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.pair_logps(spark, sf_dir)


def _row_query(name: str, sql: str, value) -> None:
    """A per-pair value over the whole table."""

    @query(name, f"WITH {LP} SELECT pair_id, {s6(sql)} AS value FROM lp")
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return _pairs(spark, sf_dir).select("pair_id", r6(value()).alias("value"))


_SINGLE = "(1.0 / CAST(0.001 AS DOUBLE)) * (p - 0.5)"
_row_query("loss_sppo", _self_play_sql(BETA), lambda: losses.self_play_loss(BETA))
_row_query("loss_sppo_ref", _self_play_sql(BETA, "rc", "rr"), lambda: losses.self_play_loss(BETA, "reference"))
_row_query(
    "loss_sppo_single",
    f"((pow({_DW} - {_SINGLE}, 2) + pow({_DL} + {_SINGLE}, 2)) / 2)",
    lambda: losses.single_probability_loss(BETA),
)
_row_query("ref_free_logits", "((pc - pr) - (rc - rr))", lambda: losses.ref_free_logits())
_row_query("ref_free_logits_policy_only", "(pc - pr)", lambda: losses.ref_free_logits(reference_free=True))


def _regularizer_query(name: str, loss_type: str) -> None:
    """Batch means of one regularizer."""

    @query(
        name,
        f"WITH {LP} SELECT batch_id, {s6(f'avg({REGULARIZERS[loss_type][1]})')} AS reg_loss FROM lp GROUP BY batch_id",
    )
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return losses.batch_regularizer(_pairs(spark, sf_dir), loss_type).withColumn("reg_loss", r6("reg_loss"))


for _name, _loss_type in {
    "reg_forward_importance": "sppo_forwardimportance10",
    "reg_reverse_kl": "sppo_reversekl",
    "reg_reverse_kl_noent": "sppo_reverseklnoent",
    "reg_forward_reverse": "sppo_forwardreverse",
    "reg_forward1_reverse": "sppo_forward1reverse5",
    "reg_forward1R5_reverse": "sppo_forward1R5reverse5",
    "reg_entropy": "sppo_entropy",
    "reg_chisq10": "sppo_chisq10",
    "reg_chisqsm1": "sppo_chisqsm1",
}.items():
    _regularizer_query(_name, _loss_type)


@query(
    "reg_forward",
    f"""WITH tok AS (
      SELECT vec_id // 8 AS seq_id, vec_id % 8 AS pos, label, CASE WHEN label = 9 THEN 0 ELSE 1 END AS mask,
        list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings),
    nxt AS (
      SELECT a.seq_id, a.l, b.label, b.mask FROM tok a
      JOIN tok b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1),
    lp AS (
      SELECT seq_id, mask, l[label + 1] - list_max(l)
        - ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) AS logp FROM nxt)
    SELECT seq_id // 4 AS batch_id, {s6("-avg(CASE WHEN mask = 0 THEN 0 ELSE logp END)")} AS reg_loss
    FROM lp GROUP BY seq_id // 4""",
)
def reg_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four sequences per batch; positions with label 9 are padding."""
    vectors = views.load(spark, sf_dir, "embeddings")
    tokens = vectors.select(
        quotient(F.col("vec_id"), 32).alias("batch_id"),
        quotient(F.col("vec_id"), 8).alias("seq_id"),
        (F.col("vec_id") % 8).alias("pos"),
        F.col("embedding").alias("logits"),
        "label",
        F.when(F.col("label") == 9, 0).otherwise(1).alias("mask"),
    )
    return losses.forward_regularizer(tokens).withColumn("reg_loss", r6("reg_loss"))


@query(
    "total_loss",
    f"""WITH {LP}, b AS (
      SELECT batch_id, avg({_self_play_sql(BETA)}) AS loss, avg({REGULARIZERS["sppo_forward1reverse5"][1]}) AS reg_loss
      FROM lp GROUP BY batch_id)
    SELECT batch_id, {s6("loss", 4)} AS loss, {s6("reg_loss")} AS reg_loss,
      {s6(f"loss + CAST({REG_COEF} AS DOUBLE) * reg_loss", 4)} AS total FROM b""",
)
def total_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = losses.total_loss(_pairs(spark, sf_dir), "sppo_forward1reverse5", BETA, REG_COEF)
    return result.select(
        "batch_id",
        r6("loss", 4).alias("loss"),
        r6("reg_loss").alias("reg_loss"),
        r6("total", 4).alias("total"),
    )


GRID_BETAS = (0.001, 0.01, 0.1)
GRID_COEFS = (0.1, 0.5)
GRID = [(name, beta, coef) for name in REGULARIZERS for beta in GRID_BETAS for coef in GRID_COEFS]


def _grid_sql() -> str:
    betas = ", ".join(f"avg({_self_play_sql(beta)}) AS loss{i}" for i, beta in enumerate(GRID_BETAS))
    regs = ", ".join(f"avg({sql}) AS reg{i}" for i, (_, sql) in enumerate(REGULARIZERS.values()))
    cells = " UNION ALL ".join(
        f"""SELECT batch_id, '{name}' AS loss_type, CAST({beta} AS DOUBLE) AS beta, CAST({coef} AS DOUBLE) AS reg_coef,
        {s6(f"loss{GRID_BETAS.index(beta)} + CAST({coef} AS DOUBLE) * reg{list(REGULARIZERS).index(name)}", 4)} AS total FROM m"""
        for name, beta, coef in GRID
    )
    return f"WITH {LP}, m AS (SELECT batch_id, {betas}, {regs} FROM lp GROUP BY batch_id) {cells}"


@query("loss_grid", _grid_sql())
def loss_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.loss_grid(spread(_pairs(spark, sf_dir)), GRID).withColumn("total", r6("total", 4))


def _report_sql() -> str:
    def lit(value, kind: str) -> str:
        return f"CAST({'NULL' if value is None else value} AS {kind})"

    return f"WITH {LP} " + " UNION ALL ".join(
        f"""SELECT batch_id, '{name}' AS loss_type, '{family}' AS family, {lit(cap, "INTEGER")} AS cap,
        {lit(coef, "DOUBLE")} AS reverse_coef, {s6(f"avg({sql})")} AS reg_loss FROM lp GROUP BY batch_id"""
        for name, ((family, cap, coef), sql) in REGULARIZERS.items()
    )


@query("parse_loss_type", _report_sql())
def parse_loss_type(spark: SparkSession, sf_dir: str) -> DataFrame:
    report = losses.regularizer_report(spread(_pairs(spark, sf_dir)), REGULARIZERS)
    return report.withColumn("reg_loss", r6("reg_loss"))


_REWARD_BETA = 0.1
_REWARDS = f"""rew AS (
  SELECT *, CAST({_REWARD_BETA} AS DOUBLE) * {_DW} AS chosen_reward, CAST({_REWARD_BETA} AS DOUBLE) * {_DL} AS rejected_reward FROM lp)"""


@query(
    "rewards",
    f"""WITH {LP}, {_REWARDS}
    SELECT pair_id, {s6("chosen_reward")} AS chosen_reward, {s6("rejected_reward")} AS rejected_reward,
      {s6("chosen_reward - rejected_reward")} AS margin,
      CASE WHEN chosen_reward > rejected_reward THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS accuracy FROM rew""",
)
def rewards(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = losses.rewards(_pairs(spark, sf_dir), _REWARD_BETA)
    return scored.select(
        "pair_id",
        *[r6(name).alias(name) for name in ("chosen_reward", "rejected_reward", "margin")],
        "accuracy",
    )


METRIC_SQL = {
    "rewards/chosen": "avg(chosen_reward)",
    "rewards/rejected": "avg(rejected_reward)",
    "rewards/accuracies": "avg(CASE WHEN chosen_reward > rejected_reward THEN 1.0 ELSE 0.0 END)",
    "rewards/margins": "avg(chosen_reward - rejected_reward)",
    "logps/rejected": "avg(pr)",
    "logps/chosen": "avg(pc)",
    "logits/rejected": "avg(logits_rejected)",
    "logits/chosen": "avg(logits_chosen)",
}
_WITH_REFERENCE = METRIC_SQL | {"ref_logps/chosen": "avg(rc)", "ref_logps/rejected": "avg(rr)"}


def _metrics_sql(named: dict[str, str]) -> str:
    return " UNION ALL ".join(
        f"SELECT batch_id, '{key}' AS key, {sql} AS value FROM rew GROUP BY batch_id"
        for key, sql in named.items()
    )


_EVAL_METRICS = {f"eval_{key}": sql for key, sql in _WITH_REFERENCE.items()} | {
    "reg/reg_loss": f"avg({_REVERSE})"
}
_PLAIN_METRICS = METRIC_SQL | {"reg/entropy": "(-avg(pc) - avg(pr))"}


@query(
    "batch_metrics",
    f"WITH {LP}, {_REWARDS}, m AS ({_metrics_sql(_EVAL_METRICS)}) SELECT batch_id, key, {s6('value')} AS value FROM m",
)
def batch_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    table = losses.batch_metrics(_pairs(spark, sf_dir), _REWARD_BETA, "sppo_reversekl", evaluation=True)
    return table.withColumn("value", r6("value"))


@query(
    "batch_metrics_unregularized",
    f"WITH {LP}, {_REWARDS}, m AS ({_metrics_sql(_PLAIN_METRICS)}) SELECT batch_id, key, {s6('value')} AS value FROM m",
)
def batch_metrics_unregularized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return losses.batch_metrics(_pairs(spark, sf_dir), _REWARD_BETA).withColumn("value", r6("value"))


_LOG_STEPS = 10


def _metric_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every batch is one training step of the log."""
    return losses.batch_metrics(_pairs(spark, sf_dir), _REWARD_BETA).select(
        F.lit("run").alias("run"), F.lit("train").alias("split"), (F.col("batch_id") + 1).alias("step"), "key", "value"
    )


@query(
    "metric_log_mean",
    f"""WITH {LP}, {_REWARDS}, m AS ({_metrics_sql(_PLAIN_METRICS)})
    SELECT 'run' AS run, 'train' AS split, CAST(ceil((batch_id + 1) / {_LOG_STEPS}.0) AS BIGINT) AS log_window,
      key, {s6("avg(value)")} AS value, count(*) AS n_values FROM m GROUP BY ALL""",
)
def metric_log_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _metric_log(spark, sf_dir)
    return losses.metric_log_mean(log, _LOG_STEPS).withColumn("value", r6("value"))


@query(
    "metric_log_stream",
    f"""WITH {LP}, {_REWARDS}, m AS ({_metrics_sql(_PLAIN_METRICS)})
    SELECT 'run' AS run, 'train' AS split, CAST(ceil((batch_id + 1) / {_LOG_STEPS}.0) AS BIGINT) * {_LOG_STEPS} AS step,
      key, {s6("avg(value)")} AS value, count(*) AS n_values FROM m GROUP BY ALL""",
)
def metric_log_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log written in two parts, cut between two log events; the second run goes on where the first one stopped."""
    log = materialize(_metric_log(spark, sf_dir), "metric-log")
    is_event = F.col("step") % _LOG_STEPS == 0
    events = log.filter(is_event).select("run", "split", "step").distinct()
    rows = log.unionByName(events.withColumns({"key": F.lit(None).cast("string"), "value": F.lit(None).cast("double")}))
    folder = scratch_path(spark, "metric-stream")
    for part in (F.col("step") <= 34, F.col("step") > 34):
        rows.filter(part).write.mode("append").parquet(f"{folder}/log")
        stream = spark.readStream.schema(rows.schema).parquet(f"{folder}/log")
        means = metrics.run_to_table(metrics.means_at_log_events(stream), folder)
    return means.withColumn("value", r6("value"))
