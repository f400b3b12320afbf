"""Candidates and scores of a prompt: joining, stacking, win probabilities and pairs.

Tables are keyed by ``(prompt_idx, sample_id)`` with ``sample_id`` in ``0..k-1``.
Rows of one prompt are gathered with ``k`` conditional aggregates instead of a
collected list: they combine before the shuffle and hold at most ``k`` values per
prompt however many rows share the key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.columns import array_total, checked, named_key, take_last, win_probability

KEY = ("prompt_idx", "sample_id")

# Fixed value: scores looked at under ``compat``.
COMPAT_SCORES = 5


def join_prompt_responses(prompts: DataFrame, responses: DataFrame) -> DataFrame:
    """Every response next to its prompt."""
    return responses.join(prompts, "prompt_idx")


def join_prompt_scores(responses: DataFrame, scores: DataFrame) -> DataFrame:
    """Every response next to its score."""
    return responses.join(scores, list(KEY))


def _slot(value: str, sample: int) -> Column:
    return F.max(F.when(F.col("sample_id") == sample, F.col(value)))


def _unexpected(k: int) -> Column:
    return F.count_if(~F.col("sample_id").between(0, k - 1) | F.col("sample_id").isNull())


def _once_each(slots: list[str], k: int, partial: bool) -> Column:
    """Whether the rows of a prompt fill one slot each, and all ``k`` of them unless ``partial``."""
    filled = sum((F.col(slot).isNotNull().cast("int") for slot in slots), F.lit(0))
    whole = (F.col("_rows") == filled) & (F.col("_unexpected") == 0)
    return whole if partial else whole & (F.col("_rows") == k)


def _needed(what: str, k: int, partial: bool) -> str:
    return f"prompt needs at most {k} {what}" if partial else f"prompt needs exactly {k} {what}"


def stack_candidates(responses: DataFrame, k: int, partial: bool = False) -> DataFrame:
    """``(prompt_idx, candidates)`` with the k responses in sample order.

    Texts aggregate by sorting. Shuffling them first sorts them once; a partial step
    before the shuffle would sort them a second time and combine nothing, as a sample
    has one response. A prompt without exactly one response for each of the ``k`` samples
    stops the job; with ``partial`` it may lack samples, whose places are null.
    """
    slots = [_slot("response", i).alias(f"_c{i}") for i in range(k)]
    gathered = responses.repartition("prompt_idx").groupBy("prompt_idx").agg(
        *slots, F.count(F.lit(1)).alias("_rows"), _unexpected(k).alias("_unexpected")
    )
    names = [f"_c{i}" for i in range(k)]
    problem = named_key(f"{_needed('responses', k, partial)}, one for each sample, none missing", "prompt_idx")
    return checked(gathered, _once_each(names, k, partial), problem).select("prompt_idx", F.array(*names).alias("candidates"))


def score_arrays(scores: DataFrame, k: int, partial: bool = False) -> DataFrame:
    """``(prompt_idx, scores)`` with the k scores in sample order.

    A prompt without exactly one usable score per sample stops the job: the table
    was joined or generated wrongly and any index into it would be shifted. With ``partial``
    a prompt may lack samples; their places are null, so indexes stay those of the samples.
    """
    slots = [_slot("score", i).alias(f"_s{i}") for i in range(k)]
    gathered = scores.groupBy("prompt_idx").agg(
        *slots, F.count(F.lit(1)).alias("_rows"), _unexpected(k).alias("_unexpected")
    )
    names = [f"_s{i}" for i in range(k)]
    usable = _once_each(names, k, partial)
    for name in names:
        usable &= ~F.isnan(name)
    problem = named_key(f"{_needed('scores', k, partial)}, none missing or NaN", "prompt_idx")
    return checked(gathered, usable, problem).select("prompt_idx", F.array(*names).alias("scores"))


def coverage_check(prompts: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Keys whose candidates do not cover the prompt table; empty when all is well.

    ``problem`` is ``no candidates``, ``no prompt``, ``wrong count``, ``bad sample`` or
    ``bad score`` (missing or NaN).
    """
    distinct = [F.max((F.col("sample_id") == i).cast("int")) for i in range(k)]
    seen = distinct[0]
    for flag in distinct[1:]:
        seen = seen + flag
    per_prompt = scores.groupBy("prompt_idx").agg(
        F.count(F.lit(1)).alias("n_candidates"),
        seen.alias("_seen"),
        _unexpected(k).alias("_unexpected"),
        F.count_if(F.col("score").isNull() | F.isnan("score")).alias("_bad"),
    )
    known = prompts.groupBy("prompt_idx").agg(F.lit(True).alias("_known"))
    checked = known.join(per_prompt, "prompt_idx", "full_outer")
    problem = (
        F.when(F.col("n_candidates").isNull(), "no candidates")
        .when(F.col("_known").isNull(), "no prompt")
        .when(F.col("n_candidates") != k, "wrong count")
        .when((F.col("_unexpected") > 0) | (F.col("_seen") != k), "bad sample")
        .when(F.col("_bad") > 0, "bad score")
    )
    return checked.select(
        "prompt_idx",
        F.coalesce("n_candidates", F.lit(0)).alias("n_candidates"),
        problem.alias("problem"),
    ).filter(F.col("problem").isNotNull())


def win_prob_matrix(scores: Column) -> Column:
    """k x k array: entry (i, j) is the probability that i beats j."""
    return F.transform(scores, lambda own: win_row(own, scores))


def win_row(own: Column, scores: Column) -> Column:
    """One row of the matrix."""
    return F.transform(scores, lambda other: win_probability(own, other))


def mean_win_rate(own: Column, scores: Column) -> Column:
    """Row mean of the matrix, the 0.5 against itself included; null places add nothing to the sum over all k."""
    return array_total(win_row(own, scores)) / F.size(scores)


def best_index(scores: Column) -> Column:
    """0-based position of the highest score, the first one on ties."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def worst_index(scores: Column) -> Column:
    """0-based position of the lowest score, the first one on ties."""
    return (F.array_position(scores, F.array_min(scores)) - 1).cast("int")


def candidate_pairs(score_table: DataFrame) -> DataFrame:
    """All ordered pairs (i, j) of a prompt's k candidates, the diagonal included.

    Built inside the row from the k-wide score array: k is a fixed parameter and no
    shuffle happens. Samples a prompt lacks have no pairs. Gives ``(prompt_idx, i, j, prob)``.
    """
    rows = score_table.select(
        "prompt_idx", F.posexplode(win_prob_matrix(F.col("scores"))).alias("i", "_row")
    )
    return rows.select("prompt_idx", "i", F.posexplode("_row").alias("j", "prob")).filter(F.col("prob").isNotNull())


def pair_statistics(score_table: DataFrame, compat: bool = False) -> DataFrame:
    """Best and worst candidate of a prompt with their three probabilities.

    Only the two matrix rows in use are evaluated. ``compat`` looks for both among the
    last five scores but counts the position from the first candidate, which pairs
    scores and texts of different candidates when there are more than five.
    """
    scores = F.col("scores")
    ranked = take_last(scores, COMPAT_SCORES) if compat else scores
    picked = score_table.select(
        "prompt_idx", "scores", best_index(ranked).alias("best"), worst_index(ranked).alias("worst")
    )
    high, low = F.get(scores, F.col("best")), F.get(scores, F.col("worst"))
    return picked.select(
        "prompt_idx",
        "best",
        "worst",
        win_probability(high, low).alias("chosen_probs"),
        mean_win_rate(high, scores).alias("chosen_probs_win"),
        mean_win_rate(low, scores).alias("chosen_probs_lose"),
    )


def drop_degenerate_pairs(pairs: DataFrame) -> DataFrame:
    """Pairs (or statistics) whose best and worst candidate are not the same one."""
    return pairs.filter(F.col("best") != F.col("worst"))


def build_pairs(prompts: DataFrame, responses: DataFrame, statistics: DataFrame) -> DataFrame:
    """Chosen and rejected dialogues with their probabilities, one row per prompt.

    Everything is joined and grouped on ``prompt_idx`` alone, so the response texts
    are shuffled once and texts that are neither best nor worst stop at the join. A scored
    prompt whose best or worst response is missing, null or repeated stops the job, and so
    does one that ``prompts`` does not hold.
    """
    from duelframe.operators.chat import build_messages

    sample = F.col("sample_id")
    chosen_here, rejected_here = sample == F.col("best"), sample == F.col("worst")
    texts = responses.select(F.col("prompt_idx").alias("_prompt"), "sample_id", "response")
    picked = statistics.join(texts, (F.col("prompt_idx") == F.col("_prompt")) & (chosen_here | rejected_here), "left")
    carried = ("best", "worst", "chosen_probs", "chosen_probs_win", "chosen_probs_lose")
    paired = picked.groupBy("prompt_idx").agg(
        F.max(F.when(chosen_here, F.col("response"))).alias("_chosen"),
        F.max(F.when(rejected_here, F.col("response"))).alias("_rejected"),
        F.count_if(chosen_here).alias("_n_chosen"),
        F.count_if(rejected_here).alias("_n_rejected"),
        *[F.max(name).alias(name) for name in carried],
    )
    whole = (
        F.col("_chosen").isNotNull() & F.col("_rejected").isNotNull() & (F.col("_n_chosen") == 1) & (F.col("_n_rejected") == 1)
    )
    paired = checked(paired, whole, named_key("best or worst response is missing or repeated", "prompt_idx"))
    known = paired.join(prompts.withColumn("_known", F.lit(True)), "prompt_idx", "left")
    return checked(known, F.col("_known"), named_key("scored prompt is not in the prompt table", "prompt_idx")).select(
        "prompt_idx",
        build_messages(F.col("prompt"), F.col("_chosen")).alias("chosen"),
        build_messages(F.col("prompt"), F.col("_rejected")).alias("rejected"),
        *carried,
    )
