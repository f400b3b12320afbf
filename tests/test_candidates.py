import math

import numpy as np
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duelframe.operators import candidates as C
from duelframe.plans.rounds import offline_round


def _scores(spark, *rows):
    long = [(i, j, float(s)) for i, row in enumerate(rows) for j, s in enumerate(row)]
    return spark.createDataFrame(long, "prompt_idx long, sample_id int, score double")


def _numpy_statistics(scores):
    s = np.array(scores, dtype=float)
    with np.errstate(over="ignore"):
        matrix = 1 / (1 + np.exp(s[None, :] - s[:, None]))
    best, worst = int(s.argmax()), int(s.argmin())
    means = matrix.mean(axis=1)
    return best, worst, matrix[best, worst], means[best], means[worst]


HAND_MADE = [
    ([0.5, 2, 2, -1, -1], (1, 3, 0.952574, 0.744545, 0.255455)),
    ([1, 1, 1, 1, 1], (0, 0, 0.5, 0.5, 0.5)),
    ([1000, -1000, 0, 0, 0], (0, 1, 1.0, 0.9, 0.1)),
]


@pytest.mark.parametrize("scores,expected", HAND_MADE)
def test_hand_made_statistics(spark, scores, expected):
    row = C.pair_statistics(C.score_arrays(_scores(spark, scores), 5)).first()
    got = (row.best, row.worst, row.chosen_probs, row.chosen_probs_win, row.chosen_probs_lose)
    assert got[:2] == expected[:2]
    assert got[2:] == pytest.approx(expected[2:], abs=1e-6)


def test_statistics_match_numpy_for_any_k(spark):
    rng = np.random.default_rng(3)
    for k in (2, 5, 6):
        rows = rng.normal(size=(30, k)).tolist()
        table = C.pair_statistics(C.score_arrays(_scores(spark, *rows), k)).orderBy("prompt_idx")
        for row, scores in zip(table.collect(), rows):
            expected = _numpy_statistics(scores)
            assert (row.best, row.worst) == expected[:2]
            assert [row.chosen_probs, row.chosen_probs_win, row.chosen_probs_lose] == pytest.approx(
                expected[2:], abs=1e-12
            )


def test_compat_looks_at_the_last_five_scores(spark):
    scores = [9.0, 1.0, 2.0, 3.0, 5.0, -4.0]
    table = C.score_arrays(_scores(spark, scores), 6)
    row = C.pair_statistics(table, compat=True).first()
    assert (row.best, row.worst) == (3, 4)
    assert row.chosen_probs == pytest.approx(1 / (1 + math.exp(scores[4] - scores[3])))
    plain = C.pair_statistics(table).first()
    assert (plain.best, plain.worst) == (0, 5)


def test_matrix_properties(spark):
    rows = np.random.default_rng(5).normal(scale=4, size=(20, 5)).tolist()
    table = C.score_arrays(_scores(spark, *rows), 5)
    long = C.candidate_pairs(table)
    mirrored = long.select("prompt_idx", F.col("i").alias("j"), F.col("j").alias("i"), F.col("prob").alias("back"))
    sums = long.join(mirrored, ["prompt_idx", "i", "j"]).select(F.min(F.col("prob") + F.col("back")), F.max(F.col("prob") + F.col("back"))).first()
    assert list(sums) == pytest.approx([1.0, 1.0])
    means = long.groupBy("prompt_idx").agg(F.avg("prob").alias("m")).collect()
    assert [r.m for r in means] == pytest.approx([0.5] * 20)


@pytest.mark.parametrize(
    "rows",
    [
        [(0, 0, 1.0), (0, 1, float("nan"))],
        [(0, 0, 1.0)],
        [(0, 0, 1.0), (0, 1, 2.0), (0, 1, 2.0)],
        [(0, 0, 1.0), (0, 2, 2.0)],
        [(0, 0, 1.0), (0, 1, None)],
    ],
)
def test_unusable_scores_stop_the_job(spark, rows):
    table = spark.createDataFrame(rows, "prompt_idx long, sample_id int, score double")
    with pytest.raises(PySparkException, match="exactly 2 scores"):
        C.score_arrays(table, 2).collect()
    with pytest.raises(PySparkException, match="exactly 2 scores"):
        C.score_arrays(table, 2).count()


RESPONSES = "prompt_idx long, sample_id int, response string"


@pytest.mark.parametrize(
    "rows",
    [
        [(0, 0, "a"), (0, 1, "b"), (0, 2, "c")],
        [(0, 0, "a"), (0, 1, "b"), (0, 0, "z")],
        [(0, 0, "a")],
        [(0, 0, "a"), (0, 1, None)],
        [(0, 0, "a"), (0, None, "b")],
    ],
)
def test_candidates_need_each_sample_once(spark, rows):
    with pytest.raises(PySparkException, match="exactly 2 responses.*prompt_idx=0"):
        C.stack_candidates(spark.createDataFrame(rows, RESPONSES), 2).count()


@pytest.mark.parametrize(
    "responses,prompts,problem",
    [
        ([(0, 0, "a"), (0, 1, None)], [(0, "p")], "missing or repeated"),
        ([(0, 0, "a")], [(0, "p")], "missing or repeated"),
        ([(0, 0, "a"), (0, 1, "b"), (0, 1, "c")], [(0, "p")], "missing or repeated"),
        ([(3, 0, "a"), (3, 1, "b")], [(0, "p")], "missing or repeated"),
        ([(0, 0, "a"), (0, 1, "b")], [(1, "p")], "not in the prompt table"),
    ],
)
def test_a_round_loses_no_prompt(spark, responses, prompts, problem):
    pairs = offline_round(
        spark.createDataFrame(prompts, "prompt_idx long, prompt string"),
        spark.createDataFrame(responses, RESPONSES),
        _scores(spark, [2.0, 1.0]),
        2,
    )
    for run in (pairs.count, pairs.select("prompt_idx").collect):
        with pytest.raises(PySparkException, match=problem):
            run()


def test_coverage_names_every_problem(spark):
    prompts = spark.createDataFrame([(i,) for i in range(5)], "prompt_idx long")
    rows = [
        (0, 0, 1.0), (0, 1, 2.0),  # fine
        (1, 0, 1.0),
        (2, 0, 1.0), (2, 0, 1.0),
        (3, 0, 1.0), (3, 1, float("nan")),
        (9, 0, 1.0), (9, 1, 1.0),
    ]
    scores = spark.createDataFrame(rows, "prompt_idx long, sample_id int, score double")
    got = {r.prompt_idx: r.problem for r in C.coverage_check(prompts, scores, 2).collect()}
    assert got == {
        1: "wrong count", 2: "bad sample", 3: "bad score", 4: "no candidates", 9: "no prompt",
    }


def test_pairs_do_not_depend_on_partitioning(spark):
    k, n = 3, 40
    rng = np.random.default_rng(1)
    rows = [(i, j, f"text {i} {j}", float(rng.normal())) for i in range(n) for j in range(k)]
    table = spark.createDataFrame(rows, "prompt_idx long, sample_id int, response string, score double")
    prompts = spark.createDataFrame([(i, f"prompt {i}") for i in range(n)], "prompt_idx long, prompt string")
    results = []
    for parts in (1, 7):
        spread = table.repartition(parts, F.rand(parts))
        pairs = offline_round(
            prompts, spread.drop("score"), spread.drop("response"), k
        ).orderBy("prompt_idx").collect()
        results.append(pairs)
    assert results[0] == results[1] and len(results[0]) == n
    by_prompt = {}
    for i, j, text, score in rows:
        by_prompt.setdefault(i, []).append((score, text))
    for pair in results[0]:
        scored = by_prompt[pair.prompt_idx]
        assert pair.chosen[1].content == max(scored)[1]
        assert pair.rejected[1].content == min(scored)[1]
        assert [m.role for m in pair.chosen] == ["user", "assistant"]


def test_win_probability_of_overflowing_gap(spark):
    row = spark.range(1).select(
        C.win_probability(F.lit(-1000.0), F.lit(1000.0)).alias("low"),
        C.win_probability(F.lit(1000.0), F.lit(-1000.0)).alias("high"),
    ).first()
    assert (row.low, row.high) == (0.0, 1.0) and not math.isnan(row.low)


def test_degenerate_pairs_go(spark):
    table = C.pair_statistics(C.score_arrays(_scores(spark, [1.0, 1.0], [2.0, 1.0]), 2))
    assert [r.prompt_idx for r in C.drop_degenerate_pairs(table).collect()] == [1]
