import math
import random
from collections import Counter

import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duelframe.operators import diversity, judges


def _bleu(own, others):
    """Published definition on Python lists, uniform weights up to 4-grams."""
    def grams(tokens, n):
        return Counter(tuple(tokens[i : i + n]) for i in range(len(tokens) - n + 1))

    logs = 0.0
    for n in range(1, 5):
        mine = grams(own, n)
        best = Counter()
        for other in others:
            best |= grams(other, n)
        hits = sum((mine & best).values())
        if hits == 0:
            return 0.0
        logs += math.log(hits / max(len(own) - n + 1, 1))
    closest = min((abs(len(o) - len(own)), len(o)) for o in others)[1]
    brevity = 0.0 if len(own) > closest else 1 - closest / len(own)
    return math.exp(brevity + logs / 4)


def test_self_bleu_against_brute_force(spark):
    texts = {
        0: ["a b c d e", "a b c d", "a b c d e f g"],
        1: ["x", "x y z w v", "x y z w"],
        2: ["a a a a a", "a a a a", "b"],
        3: ["", "q w e r", "q w e r"],
    }
    rows = [(p, s, t) for p, samples in texts.items() for s, t in enumerate(samples)]
    table = spark.createDataFrame(rows, "prompt_idx long, sample_id int, response string")
    got = {(r.prompt_idx, r.sample_id): r.bleu for r in diversity.self_bleu(table, 3).collect()}
    assert len(got) == len(rows)
    for p, s, _ in rows:
        others = [t.split() for i, t in enumerate(texts[p]) if i != s]
        assert got[p, s] == pytest.approx(_bleu(texts[p][s].split(), others)), (p, s)
    means = {r.prompt_idx: r.self_bleu for r in diversity.mean_self_bleu(diversity.self_bleu(table, 3)).collect()}
    assert means[0] == pytest.approx(sum(got[0, s] for s in range(3)) / 3)


def test_scorer_is_built_per_task_and_keeps_keys(spark):
    rows = [(i, j, f"p{i}", "x" * (i + j)) for i in range(20) for j in range(3)]
    table = spark.createDataFrame(rows, "prompt_idx long, sample_id int, prompt string, response string").repartition(4)

    def make_scorer():
        weights = {"bias": 1.0}

        def score(batch: pd.DataFrame):
            assert list(batch.columns) == ["prompt", "response"]
            return batch["response"].str.len() + weights["bias"]

        return score

    got = {(r.prompt_idx, r.sample_id): r.score for r in judges.score_candidates(table, make_scorer).collect()}
    assert got == {(i, j): i + j + 1.0 for i, j, _, _ in rows}


def test_verdicts(spark):
    df = spark.createDataFrame([(0,), (1,), (-1,)], "rank int")
    assert [r.p for r in df.select(judges.rank_to_prob(F.col("rank")).alias("p")).collect()] == [1.0, 0.0, 0.5]


def test_progress_lines(spark):
    log = spark.createDataFrame([(i, float(i)) for i in range(10)], "row_idx long, seconds double")
    rows = judges.generation_progress(log, 4).orderBy("report").collect()
    assert [(r.n_done, r.elapsed) for r in rows] == [(4, 6.0), (8, 28.0), (10, 45.0)]
    assert [r.eta for r in rows] == [9.0, 7.0, 0.0]


def test_series_changes_and_best(spark):
    rows = [("a", 1, 0.0), ("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 1.0), ("b", 1, 0.5)]
    table = spark.createDataFrame(rows, "run string, iteration int, prob double").withColumn("output_length", F.lit(10))
    got = {(r.run, r.iteration): (r.rate, r.rate_change, r.best_iteration) for r in judges.result_series(table).collect()}
    assert got == {
        ("a", 1): (50.0, None, 2), ("a", 2): (100.0, 50.0, 2), ("a", 3): (100.0, 0.0, 2), ("b", 1): (50.0, None, 1),
    }


def test_win_rate(spark):
    table = spark.createDataFrame([("g", 1.0, 10), ("g", 0.0, 20), ("h", 0.5, 5)], "generator string, prob double, output_length int")
    got = {r.generator: (r.n_judged, r.win_rate, r.mean_length) for r in judges.win_rate(table).collect()}
    assert got == {"g": (2, 0.5, 15.0), "h": (1, 0.5, 5.0)}


def test_progress_counts_rows_and_not_positions(spark):
    log = spark.createDataFrame([(0, 1.0), (1, 1.0), (7, 2.0)], "row_idx long, seconds double")
    rows = judges.generation_progress(log, 2).orderBy("report").collect()
    assert [(r.report, r.n_done, r.elapsed, r.eta) for r in rows] == [(0, 2, 2.0, 1.0), (3, 3, 4.0, 0.0)]


@pytest.mark.parametrize("rows", [[(0, 0, "a b"), (0, 2, "c")], [(0, 0, "a"), (0, 0, "b")], [(0, None, "a")]])
def test_self_bleu_refuses_stray_and_repeated_samples(spark, rows):
    table = spark.createDataFrame(rows, "prompt_idx long, sample_id int, response string")
    with pytest.raises(PySparkException, match="samples must be 0 to 1"):
        diversity.self_bleu(table, 2).count()


def test_self_bleu_of_many_prompts_has_no_ngram_rows(spark):
    rng = random.Random(3)
    texts = {p: {s: " ".join(rng.choice("abcdef") for _ in range(rng.randrange(0, 30))) for s in range(5) if rng.random() < 0.9} for p in range(60)}
    rows = [(p, s, t) for p, samples in texts.items() for s, t in samples.items()] + [(1000, 2, None), (1000, 3, "a b c d")]
    table = spark.createDataFrame(rows, "prompt_idx long, sample_id int, response string").repartition(5)
    scored = diversity.self_bleu(table, 5)
    plan = scored._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "explode" not in plan
    got = {(r.prompt_idx, r.sample_id): r.bleu for r in scored.collect()}
    assert len(got) == len(rows) and got[1000, 2] == got[1000, 3] == 0.0
    for p, samples in texts.items():
        for s, text in samples.items():
            others = [t.split() for i, t in samples.items() if i != s]
            assert got[p, s] == pytest.approx(_bleu(text.split(), others) if others else 0.0), (p, s)


def _requests(spark, n=400):
    rows = [(i % 4, i, "p", "x" * (i % 7), "y" * (i % 5)) for i in range(n)]
    return spark.createDataFrame(rows, "worker_id int, prompt_idx long, prompt string, first string, second string")


def test_shuffled_order_cancels_a_preference_for_a_place(spark):
    first_wins = lambda: lambda batch: [0] * len(batch)
    plain = judges.regroup_judgements(_requests(spark), first_wins)
    assert {(r["rank"], r.prob) for r in plain.collect()} == {(0, 1.0)} and "swapped" not in plain.columns
    asked = judges.regroup_judgements(_requests(spark), first_wins, shuffle_seed=7)
    found = asked.collect()
    assert {(r.swapped, r["rank"], r.prob) for r in found} == {(False, 0, 1.0), (True, 1, 0.0)}
    assert 150 < sum(r.swapped for r in found) < 250
    again = judges.regroup_judgements(_requests(spark).repartition(9), first_wins, shuffle_seed=7)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, found))
    assert asked.filter("swapped").count() == sum(r.swapped for r in found)


def test_verdicts_are_turned_back_with_ranks_and_with_scores(spark):
    longer = lambda: lambda batch: [(a < b) - (a == b) for a, b in zip(batch["first"].str.len(), batch["second"].str.len())]
    plain = {r.prompt_idx: (r["rank"], r.prob) for r in judges.regroup_judgements(_requests(spark), longer).collect()}
    turned = {r.prompt_idx: (r["rank"], r.prob) for r in judges.regroup_judgements(_requests(spark), longer, shuffle_seed=1).collect()}
    assert plain == turned and {rank for rank, _ in plain.values()} == {-1, 0, 1}
    share = lambda: lambda batch: (1 + batch["first"].str.len()) / (2 + batch["first"].str.len() + batch["second"].str.len())
    soft = judges.regroup_judgements(_requests(spark), share, return_scores=True)
    assert "rank" not in soft.columns
    mixed = {r.prompt_idx: r.prob for r in judges.regroup_judgements(_requests(spark), share, shuffle_seed=1, return_scores=True).collect()}
    assert mixed == pytest.approx({r.prompt_idx: r.prob for r in soft.collect()})
