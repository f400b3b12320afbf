"""Preference losses, regularizers, rewards and metrics over log-probability tables.

One row per pair: ``pc, pr`` (policy), ``rc, rr`` (reference), ``lc, lr`` (last iterate)
log-probabilities of the chosen and rejected response, the probabilities ``p, pw, pl``
and ``batch_id``. Batch values are means over ``batch_id`` and combine before the shuffle.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.columns import clamp_max
from duelframe.operators.logps import next_token_shift, token_logps

# Loss names with the regularizer they stand for, the clamp of each
# (None where the name carries it), and the weight of the reverse part.
_EXACT_NAMES = {
    "sppo": ("none", None, None),
    "sppo_single": ("none", None, None),
    "sppo_forward": ("forward", None, None),
    "sppo_reversekl": ("reverse", None, None),
    "sppo_reverseklnoent": ("cross", None, None),
    "sppo_forwardreverse": ("forward_reverse", 10, 1.0),
    "sppo_entropy": ("entropy", None, None),
    "sppo_chisq10": ("chisq", 10, None),
    "sppo_chisqsm1": ("chisq_smoothed", 10, None),
}
_NUMBERED_NAMES = {
    r"sppo_forwardimportance(.*)": ("forward_importance", None),
    r"sppo_forward1reverse(.*)": ("forward_reverse", 10),
    r"sppo_forward1R5reverse(.*)": ("forward_reverse", 5),
}


@dataclass(frozen=True)
class Regularizer:
    family: str
    cap: int | None = None
    reverse_coef: float | None = None


def parse_loss_type(name: str) -> Regularizer:
    """Regularizer behind a loss name; unknown names and missing numbers are errors."""
    if name in _EXACT_NAMES:
        return Regularizer(*_EXACT_NAMES[name])
    for pattern, (family, cap) in _NUMBERED_NAMES.items():
        found = re.fullmatch(pattern, name)
        if found:
            if family == "forward_importance":
                return Regularizer(family, int(found.group(1)))
            return Regularizer(family, cap, float(found.group(1)))
    raise ValueError(f"unknown loss type: {name}")


def _square(x: Column) -> Column:
    return x * x


def _c(name: str) -> Column:
    return F.col(name)


def policy_gap() -> tuple[Column, Column]:
    """Policy minus reference for the chosen and the rejected response."""
    return _c("pc") - _c("rc"), _c("pr") - _c("rr")


def self_play_loss(beta: float, against: str = "last") -> Column:
    """Squared distance of both log ratios to their centred win rates, over beta.

    ``against`` names the log-probabilities compared with: ``last`` or ``reference``.
    """
    chosen, rejected = {"last": ("lc", "lr"), "reference": ("rc", "rr")}[against]
    scale = F.lit(1.0 / beta)
    return (
        _square(_c("pc") - _c(chosen) - scale * (_c("pw") - 0.5))
        + _square(_c("pr") - _c(rejected) - scale * (_c("pl") - 0.5))
    ) / 2


def single_probability_loss(beta: float) -> Column:
    """The same with one probability pulling the two sides in opposite directions."""
    chosen, rejected = policy_gap()
    pull = F.lit(1.0 / beta) * (_c("p") - 0.5)
    return (_square(chosen - pull) + _square(rejected + pull)) / 2


def unregularized_loss(loss_type: str, beta: float) -> Column:
    """Loss of training without a regularizer, where the last iterate is the reference."""
    if loss_type == "sppo":
        return self_play_loss(beta, "reference")
    if loss_type == "sppo_single":
        return single_probability_loss(beta)
    raise ValueError(f"unknown loss type without a regularizer: {loss_type}")


def base_loss(loss_type: str, beta: float, compat: bool = False) -> Column:
    """The loss a regularizer is added to. ``compat`` gives ``sppo_single`` the plain
    ``sppo`` loss, which is what its name silently stands for next to regularizers."""
    if loss_type == "sppo_single" and not compat:
        return single_probability_loss(beta)
    return self_play_loss(beta)


def regularizer_term(reg: Regularizer) -> Column:
    """Per-pair value whose batch mean is the regularizer."""
    chosen, rejected = policy_gap()

    def both(term) -> Column:
        return term(chosen) + term(rejected)

    def ratio(x: Column) -> Column:
        return F.exp(clamp_max(x, reg.cap))

    if reg.family == "none":
        return F.lit(0.0)
    if reg.family == "forward_importance":
        return both(lambda d: ratio(-d))
    if reg.family == "reverse":
        return both(_square)
    if reg.family == "cross":
        return -(_c("pc") * _c("rc")) - _c("pr") * _c("rr")
    if reg.family == "forward_reverse":
        return both(lambda d: ratio(-d)) + F.lit(reg.reverse_coef) * both(_square)
    if reg.family == "entropy":
        return _square(_c("pc")) + _square(_c("pr"))
    if reg.family == "chisq":
        return both(ratio)
    if reg.family == "chisq_smoothed":
        return both(lambda d: ratio(d) / (F.lit(1.0) + ratio(d)))
    raise ValueError(f"the {reg.family} regularizer needs token log-probabilities")


def per_batch(df: DataFrame, value: Column, out: str, batch_col: str = "batch_id") -> DataFrame:
    """Batch mean of a per-pair value."""
    return df.groupBy(batch_col).agg(F.avg(value).alias(out))


def batch_regularizer(df: DataFrame, loss_type: str) -> DataFrame:
    """``(batch_id, reg_loss)`` of a loss name."""
    return per_batch(df, regularizer_term(parse_loss_type(loss_type)), "reg_loss")


def regularizer_report(df: DataFrame, loss_types: Iterable[str]) -> DataFrame:
    """Batch mean of every named regularizer, with what its name was read as, in one job."""
    parsed = {name: parse_loss_type(name) for name in loss_types}
    means = df.groupBy("batch_id").agg(
        *[F.avg(regularizer_term(reg)).alias(f"_reg{i}") for i, reg in enumerate(parsed.values())]
    )
    rows = [
        F.struct(
            F.lit(name).alias("loss_type"),
            F.lit(reg.family).alias("family"),
            F.lit(reg.cap).cast("int").alias("cap"),
            F.lit(reg.reverse_coef).cast("double").alias("reverse_coef"),
            F.col(f"_reg{i}").alias("reg_loss"),
        )
        for i, (name, reg) in enumerate(parsed.items())
    ]
    return means.select("batch_id", F.inline(F.array(*rows)))


def forward_regularizer(reference_tokens: DataFrame) -> DataFrame:
    """``(batch_id, reg_loss)``: minus the mean token log-probability of the reference
    responses over all positions, padded ones (``mask`` 0) counting as 0.

    Rows ``(batch_id, seq_id, pos, logits, label, mask)``; labels and masks are those of
    the position itself and are shifted here. ``seq_id`` is unique over batches.
    """
    following = next_token_shift(
        reference_tokens.select(
            "batch_id", "seq_id", "pos", "logits",
            F.struct("label", "mask").alias("label"),
        )
    ).select(
        "batch_id", "seq_id", "pos", "logits",
        F.col("label.label").alias("label"), F.col("label.mask").alias("mask"),
    )
    masked = F.when(F.col("mask") == 0, F.lit(0.0)).otherwise(F.col("logp"))
    return token_logps(following).groupBy("batch_id").agg((-F.avg(masked)).alias("reg_loss"))


def total_loss(
    df: DataFrame, loss_type: str, beta: float, reg_coef: float, compat: bool = False
) -> DataFrame:
    """``(batch_id, loss, reg_loss, total)``."""
    term = regularizer_term(parse_loss_type(loss_type))
    return (
        df.groupBy("batch_id")
        .agg(F.avg(base_loss(loss_type, beta, compat)).alias("loss"), F.avg(term).alias("reg_loss"))
        .withColumn("total", F.col("loss") + F.lit(float(reg_coef)) * F.col("reg_loss"))
    )


def loss_grid(
    df: DataFrame, grid: Iterable[tuple[str, float, float]], compat: bool = False
) -> DataFrame:
    """Total loss per batch for every ``(loss_type, beta, reg_coef)`` of a sweep, in one job.

    The table is aggregated once, with one mean per distinct loss and regularizer; the
    grid is laid over the aggregated batches, never over the pairs.
    """
    grid = list(grid)

    def base(name: str, beta: float) -> tuple[str, float]:
        return ("sppo_single" if name == "sppo_single" else "sppo", beta)

    bases = sorted({base(name, beta) for name, beta, _ in grid})
    regs = sorted({parse_loss_type(name) for name, _, _ in grid}, key=repr)
    means = df.groupBy("batch_id").agg(
        *[F.avg(base_loss(*one, compat)).alias(f"_loss{i}") for i, one in enumerate(bases)],
        *[F.avg(regularizer_term(reg)).alias(f"_reg{i}") for i, reg in enumerate(regs)],
    )
    # Names have passed the parser, so they hold no quotes.
    cells = ", ".join(
        f"named_struct('loss_type', '{name}', 'beta', {float(beta)!r}D, 'reg_coef', {float(coef)!r}D, 'total',"
        f" _loss{bases.index(base(name, beta))} + {float(coef)!r}D * _reg{regs.index(parse_loss_type(name))})"
        for name, beta, coef in grid
    )
    return means.selectExpr("batch_id", f"inline(array({cells}))")


def rewards(df: DataFrame, beta: float) -> DataFrame:
    """Add implicit rewards of both responses, their margin and whether chosen wins."""
    chosen, rejected = policy_gap()
    return df.withColumns(
        {
            "chosen_reward": F.lit(float(beta)) * chosen,
            "rejected_reward": F.lit(float(beta)) * rejected,
        }
    ).withColumns(
        {
            "margin": F.col("chosen_reward") - F.col("rejected_reward"),
            "accuracy": (F.col("chosen_reward") > F.col("rejected_reward")).cast("double"),
        }
    )


def ref_free_logits(reference_free: bool = False) -> Column:
    """Difference of the policy and reference log ratios; no reference part if free of it."""
    policy = _c("pc") - _c("pr")
    return policy if reference_free else policy - (_c("rc") - _c("rr"))


def batch_metrics(
    df: DataFrame, beta: float, loss_type: str | None = None, evaluation: bool = False
) -> DataFrame:
    """The logged means of every batch as rows ``(batch_id, key, value)``.

    With a ``loss_type`` the regularizer is reported as ``reg/reg_loss``; without one
    (unregularized training) ``reg/entropy`` is and the reference means are not. Only
    ``reg/`` keys stay without the evaluation prefix.
    """
    prefix = "eval_" if evaluation else ""
    # The metric names.
    means = {
        "rewards/chosen": _c("chosen_reward"),
        "rewards/rejected": _c("rejected_reward"),
        "rewards/accuracies": _c("accuracy"),
        "rewards/margins": _c("margin"),
        "logps/rejected": _c("pr"),
        "logps/chosen": _c("pc"),
        "logits/rejected": _c("logits_rejected"),
        "logits/chosen": _c("logits_chosen"),
    }
    if loss_type is not None:
        means |= {"ref_logps/chosen": _c("rc"), "ref_logps/rejected": _c("rr")}
    named = {f"{prefix}{key}": F.avg(value) for key, value in means.items()}
    if loss_type is not None:
        named["reg/reg_loss"] = F.avg(regularizer_term(parse_loss_type(loss_type)))
    else:
        named["reg/entropy"] = -F.avg("pc") - F.avg("pr")
    return (
        rewards(df, beta)
        .groupBy("batch_id")
        .agg(*[value.alias(key) for key, value in named.items()])
        .unpivot(["batch_id"], [F.col(f"`{key}`") for key in named], "key", "value")
    )


def metric_log_mean(metrics: DataFrame, logging_steps: int) -> DataFrame:
    """Mean of every metric over the steps since the log call before.

    Rows ``(run, split, step, key, value)`` with steps counted from 1; a log call happens
    after every ``logging_steps`` steps.
    """
    window = F.ceil(F.col("step") / logging_steps).alias("log_window")
    return metrics.groupBy("run", "split", window, "key").agg(
        F.avg("value").alias("value"), F.count(F.lit(1)).alias("n_values")
    )
