import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duelframe.operators import logps, tokens
from duelframe.operators.joins import attach_columns
from duelframe.operators.tokens import Limits


def _python_cut(prompt, chosen, rejected, limits):
    """The length rules on Python lists."""
    longer = max(len(chosen), len(rejected))

    def cut_prompt(p):
        if len(p) + longer <= limits.max_length:
            return p
        n = limits.max_prompt_length
        return p[:n] if limits.mode == "keep_start" else p[-n:]

    def cut_answer(p, a):
        return a[: limits.max_length - limits.max_prompt_length] if len(p) + longer > limits.max_length else a

    p = cut_prompt(prompt)
    return p, cut_answer(p, chosen), cut_answer(p, rejected)


@settings(max_examples=15, deadline=None)
@given(
    st.integers(0, 12), st.integers(0, 12), st.integers(0, 12),
    st.integers(1, 10), st.integers(0, 8), st.sampled_from(["keep_start", "keep_end"]),
)
def test_truncation_matches_list_slicing(spark, n_prompt, n_chosen, n_rejected, max_prompt, extra, mode):
    limits = Limits(max_prompt + extra, max_prompt, mode)
    lists = (list(range(n_prompt)), list(range(100, 100 + n_chosen)), list(range(200, 200 + n_rejected)))
    prompt, chosen, rejected = lists
    df = spark.createDataFrame(
        [(prompt, prompt, chosen, prompt, rejected)],
        "prompt_ids array<int>, chosen_prompt_ids array<int>, chosen_answer_ids array<int>,"
        " rejected_prompt_ids array<int>, rejected_answer_ids array<int>",
    )
    row = tokens.truncate_pairs(df, limits).first()
    expected = _python_cut(prompt, chosen, rejected, limits)
    assert (row.prompt_ids, row.chosen_answer_ids, row.rejected_answer_ids) == expected
    assert row.chosen_prompt_ids == row.rejected_prompt_ids == expected[0]
    for head, answer in ((row.chosen_prompt_ids, row.chosen_answer_ids), (row.rejected_prompt_ids, row.rejected_answer_ids)):
        assert len(head) + len(answer) <= limits.max_length


def test_limits_are_checked():
    for bad in ((10, 0), (10, 11)):
        with pytest.raises(ValueError):
            Limits(*bad)
    with pytest.raises(ValueError):
        Limits(10, 5, "middle")


def test_keep_end_keeps_short_prompts(spark):
    df = spark.createDataFrame([(list(range(7)),), (list(range(3)),)], "p array<int>")
    cut = tokens.truncate_prompt(F.col("p"), F.lit(100), Limits(50, 5))
    assert [r.c for r in df.select(cut.alias("c")).collect()] == [[2, 3, 4, 5, 6], [0, 1, 2]]


def test_merged_last_token_moves_the_cut(spark):
    df = spark.createDataFrame([([1, 2, 3], [1, 2, 3, 4]), ([1, 2, 3], [1, 2, 9, 4])], "p array<int>, f array<int>")
    head, answer = tokens.split_prompt_answer(F.col("p"), F.col("f"))
    rows = df.select(head.alias("h"), answer.alias("a")).collect()
    assert [(r.h, r.a) for r in rows] == [([1, 2, 3], [4]), ([1, 2], [9, 4])]
    short = spark.createDataFrame([([1, 2, 3], [1])], "p array<int>, f array<int>")
    with pytest.raises(PySparkException, match="shorter than the prompt"):
        short.select(tokens.prompt_cut(F.col("p"), F.col("f"))).collect()


def test_training_row_by_hand(spark):
    df = spark.createDataFrame([(0, "a b ", "c d", "e")], "prompt_idx long, prompt string, chosen string, rejected string")
    ids = {w: i for i, w in enumerate("abcde", start=10)}
    encode = tokens.tokenizer_encode(lambda: lambda texts: [[ids[w] for w in text.split()] for text in texts])
    row = tokens.tokenize_pairs(df, 1, 2, Limits(20, 10), encode).first()
    assert row.chosen_input_ids == [1, 10, 11, 12, 13, 2]
    assert row.chosen_labels == [-100, -100, -100, 12, 13, 2]
    assert row.rejected_input_ids == [1, 10, 11, 14, 2]
    assert row.prompt_input_ids == [1, 10, 11]
    assert row.rejected_attention_mask == [1] * 5


def test_tokenizer_sees_batches_and_no_nulls(spark):
    def make():
        def tokenize(texts):
            assert isinstance(texts, list) and None not in texts
            return [[len(text)] for text in texts]

        return tokenize

    df = spark.createDataFrame([(0, "ab"), (1, None), (2, "")], "id long, text string").coalesce(1)
    rows = tokens.tokenize(df, "text", tokens.tokenizer_encode(make)).orderBy("id").collect()
    assert [r.text_input_ids for r in rows] == [[2], None, [0]]


def test_differing_prompts_stop_the_job_whatever_is_read(spark):
    split = spark.createDataFrame([(0, "a b c ", "x", "y")], "prompt_idx long, prompt string, chosen string, rejected string")

    def shuffled(text):
        # Ids depend on the whole text, so the two joint encodings begin differently.
        return F.transform(tokens.words(text), lambda w: F.abs(F.hash(F.concat(w, text))))

    rows = tokens.tokenize_pairs(split, 1, 2, Limits(20, 10), shuffled)
    for run in (rows.count, rows.select("chosen_labels").collect):
        with pytest.raises(PySparkException, match="differ beyond"):
            run()


def test_attached_rows_are_complete_and_unique(spark):
    left = spark.createDataFrame([(1,), (2,)], "pair_id long")
    for rows, problem in (([(1, 0.5)], "no row to attach"), ([(1, 0.5), (2, 0.1), (2, 0.2)], "several rows")):
        right = spark.createDataFrame(rows, "pair_id long, x double")
        with pytest.raises(PySparkException, match=problem):
            attach_columns(left, right, ["pair_id"], ["x"]).count()


def test_inconsistent_prompts_are_found(spark):
    df = spark.createDataFrame(
        [(0, [1, 2], [1, 2]), (1, [1, 2], [3, 4]), (2, [1], [1, 2, 3]), (3, [1, 5], [1, 6])],
        "prompt_idx long, chosen_prompt_ids array<int>, rejected_prompt_ids array<int>",
    )
    assert sorted(r.prompt_idx for r in tokens.inconsistent_prompts(df).collect()) == [1, 2]


def test_padding_with_one_hot_batch(spark):
    rows = [(i, 0 if i < 60 else i, list(range(i % 9 + 1)), list(range(i % 4))) for i in range(90)]
    df = spark.createDataFrame(rows, "prompt_idx long, batch_id long, c array<int>, r array<int>")
    table = df.select(
        "prompt_idx", "batch_id",
        *[F.col(col).alias(f"{side}_{part}") for side, col in (("chosen", "c"), ("rejected", "r"))
          for part in ("input_ids", "attention_mask", "labels")],
    )
    stacked = tokens.pad_and_stack(table, pad_id=7).collect()
    assert len(stacked) == 180
    for row in stacked:
        width = 9 if row.batch_id == 0 else max(len(rows[row.prompt_idx][2]), len(rows[row.prompt_idx][3]))
        own = rows[row.prompt_idx][2 + row.side_pos]
        assert row.input_ids == own + [7] * (width - len(own))
        assert row.labels == own + [-100] * (width - len(own))
        assert row.attention_mask[len(own):] == [0] * (width - len(own))


@pytest.mark.parametrize("width", [1, 4, 7, 100])
def test_packing_keeps_the_stream(spark, width):
    rng = np.random.default_rng(0)
    rows = [(int(i), rng.integers(0, 99, size=int(n)).tolist()) for i, n in enumerate(rng.integers(0, 15, size=40))]
    df = spark.createDataFrame(rows, "doc long, ids array<int>").repartition(5)
    packed = tokens.pack_sequences(df, "ids", "doc", width, eos=-1).orderBy("chunk_id").collect()
    stream = [t for _, ids in rows for t in [*ids, -1]]
    assert [r.input_ids for r in packed] == [stream[i : i + width] for i in range(0, len(stream), width)]


def test_sequence_log_probability_by_hand(spark):
    df = spark.createDataFrame(
        [(0, 0, [0.0, 1.0, 2.0], 2), (0, 1, [5.0, 0.0, 0.0], -100), (0, 2, [1.0, 1.0, 1.0], 0), (1, 0, [1.0, 2.0], -100)],
        "seq_id long, pos int, logits array<float>, label int",
    )
    scored = logps.token_logps(df)
    totals = {r.seq_id: r.logp for r in logps.sequence_logp(scored).collect()}
    means = {r.seq_id: r.logp for r in logps.sequence_logp(scored, average=True).collect()}
    assert totals[0] == pytest.approx(-1.506218, abs=1e-6) and totals[1] == 0.0
    assert means[0] == pytest.approx(-0.753109, abs=1e-6) and np.isnan(means[1])


def test_shift_and_completion(spark):
    df = spark.createDataFrame(
        [(0, p, [0.0, 1.0], p % 2, int(p != 3)) for p in range(4)],
        "seq_id long, pos int, logits array<float>, label int, mask int",
    )
    shifted = {r.pos: r.label for r in logps.next_token_shift(df).collect()}
    assert shifted == {0: 1, 1: 0, 2: 1}
    done = {r.pos: r.logp for r in logps.completion_logps(df, 2).collect()}
    assert set(done) == {2, 3} and done[3] == 0.0 and done[2] == pytest.approx(-np.log(1 + np.e))


def test_log_softmax_of_large_logits(spark):
    df = spark.createDataFrame([([1e4, 0.0], 0), ([1e4, 0.0], 1)], "logits array<float>, label int")
    got = [r.x for r in df.select(logps.log_softmax_at(F.col("logits"), F.col("label")).alias("x")).collect()]
    assert got == pytest.approx([0.0, -1e4])


@pytest.mark.parametrize("ids", [[1, 1, 2, None], [-(2**62), 5, 2**62 + 1, 2**40], ["b", "a", None, "a"]])
def test_packing_takes_any_sortable_id(spark, ids):
    kind = "string" if isinstance(ids[0], str) else "long"
    rows = [(key, [10 * i + j for j in range(i + 1)]) for i, key in enumerate(ids)]
    df = spark.createDataFrame(rows, f"id {kind}, ids array<int>").repartition(3)
    packed = tokens.pack_sequences(df, "ids", "id", 4).orderBy("chunk_id").collect()
    stream = [token for row in packed for token in row.input_ids]
    assert [len(row.input_ids) for row in packed] == [4, 4, 2]
    assert sorted(stream) == sorted(token for _, own in rows for token in own)
    places = {own[0]: stream.index(own[0]) for _, own in rows}
    for key, own in rows:
        assert stream[places[own[0]] : places[own[0]] + len(own)] == own
        for other, first in rows:
            if key is None and other is not None or None not in (key, other) and key < other:
                assert places[own[0]] < places[first[0]]
    plan = tokens.pack_sequences(df, "ids", "id", 4)._jdf.queryExecution().executedPlan().toString()
    assert "SinglePartition" not in plan and "Arrow" not in plan and "Python" not in plan


def test_texts_are_encoded_once_with_the_check_in_place(spark):
    pairs = spark.createDataFrame([(0, "a b", " c d", " e")], "prompt_idx long, prompt string, chosen string, rejected string")
    rows = tokens.tokenize_pairs(pairs, 1, 2)
    for table in (rows, rows.select("chosen_labels"), rows.filter("size(chosen_labels) > 3")):
        plan = table._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("md5(") <= 3 and "raise_error" in plan
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("md5(") == 3


def test_packed_starts_are_sums_before_in_order(spark):
    rng = np.random.default_rng(1)
    rows = [(None if i % 9 == 0 else int(rng.integers(0, 30)), int(rng.integers(-5, 5)), int(rng.integers(1, 9)), i) for i in range(300)]
    table = spark.createDataFrame(rows, "_id long, _hash long, _n long, _row long").repartition(6)
    found = {r._row: r._start for r in tokens.stream_starts(table).collect()}
    total = 0
    for _, _, n, row in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[3])):
        assert found[row] == total
        total += n


def test_a_callers_tokenizer_below_the_barrier(spark):
    encode = tokens.tokenizer_encode(lambda: lambda texts: [[len(w) for w in text.split()] for text in texts])
    pairs = spark.createDataFrame([(0, "ab cde ", "f gh", "ijkl"), (1, "x ", "y", "zz z")], "prompt_idx long, prompt string, chosen string, rejected string")
    rows = {r.prompt_idx: r for r in tokens.tokenize_pairs(pairs, 1, 2, encode=encode).collect()}
    assert rows[0].chosen_input_ids == [1, 2, 3, 1, 2, 2] and rows[0].chosen_labels == [-100] * 3 + [1, 2, 2]
    assert rows[1].rejected_input_ids == [1, 1, 2, 1, 2] and rows[1].prompt_input_ids == [1, 1]
