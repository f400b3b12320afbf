import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from duelframe.operators import chat, turns

DIALOGUE = "array<struct<role:string,content:string>>"


def _dialogues(spark, *dialogues):
    return spark.createDataFrame([(i, d) for i, d in enumerate(dialogues)], f"id long, messages {DIALOGUE}")


def _one(df, column):
    return df.select(column.alias("x")).first().x


def test_prompt_template_cuts_at_none_only_on_request(spark):
    df = spark.createDataFrame([("a None b",)], "prompt string")
    assert _one(df, chat.prompt_template(F.col("prompt"), "inst")) == "<s>[INST] a None b [/INST]"
    assert _one(df, chat.prompt_template(F.col("prompt"), "inst", compat=True)) == "<s>[INST] a "


@pytest.mark.parametrize(
    "model,expected",
    [
        ("org/Mistral-7B-Instruct", "<s>[INST]  q  [/INST]"),
        (
            "org/Meta-Llama-3-8B-Instruct",
            "<|begin_of_text|><|start_header_id|>user<|end_header_id|>\n\nq<|eot_id|>"
            "<|start_header_id|>assistant<|end_header_id|>\n\n",
        ),
        ("org/gemma-2-9b-it", "<bos><start_of_turn>user\nq<end_of_turn>\n<start_of_turn>model\n"),
    ],
)
def test_templates_by_model_name(spark, model, expected):
    df = spark.createDataFrame([(" q ",)], "prompt string")
    assert _one(df, chat.prompt_template(F.col("prompt"), chat.template_for_model(model))) == expected


def test_unknown_model_name():
    with pytest.raises(ValueError, match="supported"):
        chat.template_for_model("other")


def test_default_rendering(spark):
    df = _dialogues(spark, [("system", "s"), ("user", "u"), ("tool", "t"), ("assistant", "a")])
    expected = "<|system|>\ns</s>\n<|user|>\nu</s>\n<|assistant|>\na</s>\n"
    assert _one(df, chat.render_chat(F.col("messages"))) == expected


def test_prompt_from_chosen_of_short_dialogues(spark):
    df = _dialogues(spark, [], [("user", "u")], [("user", "u"), ("assistant", "a")])
    sizes = [r.n for r in df.select(F.size(chat.prompt_from_chosen(F.col("messages"))).alias("n")).collect()]
    assert sorted(sizes) == [0, 0, 1]


def test_system_message_goes_in_front_once(spark):
    df = _dialogues(spark, [("user", "u")], [("system", "s"), ("user", "u")], [])
    rows = df.select("id", chat.ensure_system_message(F.col("messages")).alias("m")).orderBy("id").collect()
    assert [[m.role for m in r.m] for r in rows] == [["system", "user"], ["system", "user"], ["system"]]
    assert rows[0].m[0].content == "" and rows[1].m[0].content == "s"
    kept = df.select("id", chat.ensure_system_message(F.col("messages"), template="inst").alias("m"))
    assert [len(r.m) for r in kept.orderBy("id").collect()] == [1, 2, 0]


def test_format_pairs_cuts_by_prompt_length(spark):
    head = [("user", "q")]
    df = spark.createDataFrame(
        [(head + [("assistant", "good")], head + [("assistant", "bad")])], f"chosen {DIALOGUE}, rejected {DIALOGUE}"
    )
    row = chat.format_pairs(df).first()
    assert row.text_prompt == "<|user|>\nq</s>\n"
    assert row.text_chosen == "<|assistant|>\ngood</s>\n"
    assert row.text_rejected == "<|assistant|>\nbad</s>\n"
    with_system = chat.format_pairs(df, skip_system_message=False).first()
    assert with_system.text_prompt == "<|system|>\n</s>\n<|user|>\nq</s>\n"


def test_strict_suffix_rejects_other_prompts(spark):
    df = spark.createDataFrame([("abc", "xb")], "full string, prompt string")
    assert _one(df, chat.answer_suffix(F.col("full"), F.col("prompt"))) == "c"
    with pytest.raises(PySparkException, match="does not start"):
        df.select(chat.answer_suffix(F.col("full"), F.col("prompt"), strict=True)).collect()


def test_pair_columns_are_required(spark):
    with pytest.raises(ValueError, match="rejected"):
        chat.format_pairs(_dialogues(spark, []).withColumnRenamed("messages", "chosen"))


def test_dispatch_by_schema(spark):
    text = spark.createDataFrame([("hi", 1)], "prompt string, other int")
    assert chat.dispatch_prompt_schema(text).columns == ["prompt"]
    assert chat.dispatch_prompt_schema(text).first().prompt[0].role == "user"
    chosen = _dialogues(spark, [("user", "u"), ("assistant", "a")]).withColumnRenamed("messages", "chosen")
    dispatched = chat.dispatch_prompt_schema(chosen)
    assert dispatched.columns == ["prompt", "chosen"] and len(dispatched.first().prompt) == 1
    already = dispatched.select("prompt")
    assert chat.dispatch_prompt_schema(already).first().prompt == dispatched.first().prompt
    with pytest.raises(ValueError):
        chat.dispatch_prompt_schema(spark.range(1))


def test_turn_rows_and_arrays_agree(spark):
    rows = [(c, t, r, f"{c}{t}") for c, roles in enumerate(["ua", "sua", "uau"]) for t, r in enumerate(
        {"u": "user", "a": "assistant", "s": "system"}[x] for x in roles)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, content string")
    nested = chat.nest_turns(table.repartition(5))
    from_arrays = nested.select("conv_id", F.inline(chat.prompt_from_chosen(F.col("messages"))))
    from_turns = turns.prompt_turns(table).select("conv_id", "role", "content")
    assert sorted(from_arrays.collect()) == sorted(from_turns.collect())
    system_arrays = nested.select("conv_id", F.inline(chat.ensure_system_message(F.col("messages"))))
    system_turns = turns.ensure_system_turn(table).select("conv_id", "role", "content")
    assert sorted(system_arrays.collect()) == sorted(system_turns.collect())
    texts = {r.conv_id: r.t for r in nested.select("conv_id", chat.render_chat(F.col("messages")).alias("t")).collect()}
    pieces = turns.render_turns(table).orderBy("conv_id", "turn").collect()
    for conv, text in texts.items():
        assert "".join(p.piece for p in pieces if p.conv_id == conv) == text


TURNS = "conv_id long, turn long, role string, content string"


def test_turn_numbers_may_be_large_but_not_null_or_repeated(spark):
    far = spark.createDataFrame([(0, 150_000, "user", "a"), (0, 150_001, "assistant", "b")], TURNS)
    assert [m.content for m in chat.nest_turns(far).first().messages] == ["a", "b"]
    for turn in (None, 1):
        bad = spark.createDataFrame([(7, 1, "user", "a"), (7, turn, "user", "b")], TURNS)
        with pytest.raises(PySparkException, match="turn number: conv_id=7"):
            chat.nest_turns(bad).count()


@pytest.mark.parametrize("template", ["inst", "gemma-2", "llama-3"])
def test_model_templates_refuse_what_they_cannot_render(spark, template):
    unknown = _dialogues(spark, [("tool", "t"), ("user", "hi")])
    with pytest.raises(PySparkException, match="no form for role tool"):
        unknown.select(chat.render_chat(F.col("messages"), template)).collect()
    blank = _dialogues(spark, [("user", None)])
    with pytest.raises(PySparkException, match="without content"):
        blank.select(chat.render_chat(F.col("messages"), template)).collect()
    lenient = unknown.select(chat.render_chat(F.col("messages")).alias("t")).first().t
    assert lenient == "<|user|>\nhi</s>\n"


def test_strip_takes_all_white_space(spark):
    texts = [" \t\n a b \r\n", " x ", "", "\x1cz\x1f", "no"]
    df = spark.createDataFrame([(t,) for t in texts], "output string").withColumn("instruction", F.lit("i"))
    got = [r.output for r in chat.attach_generator(df, "g").collect()]
    assert got == [t.strip() for t in texts]
    kept = [r.output for r in chat.attach_generator(df, "g", strip_output=False).collect()]
    assert kept == texts


def test_eval_prompt_fallback(spark):
    df = spark.createDataFrame([(" a ",)], "instruction string")
    assert _one(df, chat.eval_prompt(F.col("instruction"))) == "a\n\n"
    assert _one(df, chat.eval_prompt(F.col("instruction"), F.lit("r"))) == "r"
