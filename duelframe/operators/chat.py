"""Dialogues (arrays of role/content messages) and their rendering to text."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions.columns import checked, drop_last, named_key, strip, take_last, text_from
from duelframe.schema import PROBABILITY_COLUMNS, require_columns


@dataclass(frozen=True)
class ChatTemplate:
    """What stands at the start of a text and around each role's content."""

    start: str
    around: dict[str, tuple[str, str]]
    assistant_opening: str
    strip_content: bool = False
    #: leave out messages of other roles or without content instead of stopping the job
    lenient: bool = False


# The text forms of the supported templates, and the part of a model's
# name that selects one.
TEMPLATES = {
    "default": ChatTemplate(
        start="",
        around={
            "user": ("<|user|>\n", "</s>\n"),
            "system": ("<|system|>\n", "</s>\n"),
            "assistant": ("<|assistant|>\n", "</s>\n"),
        },
        assistant_opening="<|assistant|>\n",
        lenient=True,
    ),
    "inst": ChatTemplate(
        start="<s>",
        around={"user": ("[INST] ", " [/INST]"), "assistant": ("", "</s>")},
        assistant_opening="",
    ),
    "llama-3": ChatTemplate(
        start="<|begin_of_text|>",
        around={
            role: (f"<|start_header_id|>{role}<|end_header_id|>\n\n", "<|eot_id|>")
            for role in ("system", "user", "assistant")
        },
        assistant_opening="<|start_header_id|>assistant<|end_header_id|>\n\n",
        strip_content=True,
    ),
    "gemma-2": ChatTemplate(
        start="<bos>",
        around={
            "user": ("<start_of_turn>user\n", "<end_of_turn>\n"),
            "assistant": ("<start_of_turn>model\n", "<end_of_turn>\n"),
        },
        assistant_opening="<start_of_turn>model\n",
        strip_content=True,
    ),
}
MODEL_FAMILIES = {"mistral": "inst", "llama-3": "llama-3", "gemma-2": "gemma-2"}


def template_for_model(model_name: str) -> str:
    """Template of the model family a name belongs to."""
    for family, template in MODEL_FAMILIES.items():
        if family in model_name.lower():
            return template
    raise ValueError(f"no template for model {model_name}; supported: {list(MODEL_FAMILIES)}")


def message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def build_messages(prompt: Column, response: Column) -> Column:
    """User turn and assistant turn."""
    return F.array(message("user", prompt), message("assistant", response))


def generated_table(prompts: DataFrame, candidates: DataFrame, k: int) -> DataFrame:
    """Prompt with one dialogue column ``generate_i`` per candidate, null where it has none."""
    joined = candidates.join(prompts, "prompt_idx")
    place = [F.get("candidates", F.lit(i)) for i in range(k)]
    return joined.select(
        "prompt_idx",
        "prompt",
        *[
            F.when(response.isNotNull(), build_messages(F.col("prompt"), response)).alias(f"generate_{i}")
            for i, response in enumerate(place)
        ],
    )


def render_turn(role: Column, content: Column, template: ChatTemplate) -> Column:
    """Text of one message.

    A role the template has no form for, and a null content, stop the job; the lenient
    default template leaves such a message out.
    """
    if template.strip_content:
        content = strip(content)
    if template.lenient:
        rendered = F.lit("")
    else:
        problem = F.concat(F.lit("template has no form for role "), F.coalesce(role, F.lit("null")))
        rendered = F.raise_error(problem).cast("string")
        content = F.coalesce(content, F.raise_error(F.lit("message without content")).cast("string"))
    for name, (before, after) in template.around.items():
        rendered = F.when(role == name, F.concat(F.lit(before), content, F.lit(after))).otherwise(
            rendered
        )
    return rendered


def render_chat(messages: Column, template: str = "default") -> Column:
    """Text of a whole dialogue."""
    form = TEMPLATES[template]
    parts = F.transform(messages, lambda m: render_turn(m["role"], m["content"], form))
    return F.concat(F.lit(form.start), F.array_join(parts, ""))


def prompt_template(prompt: Column, template: str = "default", compat: bool = False) -> Column:
    """Text a model continues: the rendered user turn up to the assistant's content.

    ``compat`` cuts at the first "None" instead, also inside the prompt itself.
    """
    form = TEMPLATES[template]
    opened = F.concat(
        F.lit(form.start),
        render_turn(F.lit("user"), prompt, form),
        F.lit(form.assistant_opening),
    )
    return F.substring_index(opened, "None", 1) if compat else opened


def eval_prompt(instruction: Column, rendered: Column | None = None) -> Column:
    """Rendered instruction, or the stripped instruction and a blank line without one."""
    plain = F.concat(strip(instruction), F.lit("\n\n"))
    return plain if rendered is None else F.coalesce(rendered, plain)


def to_conversational(df: DataFrame, column: str = "prompt") -> DataFrame:
    """Turn a text prompt into a one-message dialogue; a dialogue stays as it is."""
    if isinstance(df.schema[column].dataType, T.StringType):
        return df.withColumn(column, F.array(message("user", F.col(column))))
    return df


def prompt_from_chosen(chosen: Column) -> Column:
    """All messages but the last."""
    return drop_last(chosen)


def dispatch_prompt_schema(df: DataFrame, key: str | None = None) -> DataFrame:
    """Bring a table with ``prompt`` or ``chosen`` to a dialogue column ``prompt``."""
    keys = [key] if key else []
    if "prompt" in df.columns:
        return to_conversational(df.select(*keys, "prompt"))
    if "chosen" in df.columns:
        return df.select(*keys, prompt_from_chosen(F.col("chosen")).alias("prompt"), "chosen")
    raise ValueError(f"need a prompt or chosen column; found {df.columns}")


def split_last_turn(messages: Column) -> tuple[Column, Column]:
    """(all but the last message, the last message), both as dialogues."""
    return drop_last(messages), take_last(messages, 1)


def ensure_system_message(
    messages: Column, dialogue: Column | None = None, template: str | None = None
) -> Column:
    """Put an empty system message first unless ``dialogue`` already starts with one.

    With a ``template`` that knows no system role, nothing is added.
    """
    if template is not None and "system" not in TEMPLATES[template].around:
        return messages
    first_role = F.get(messages if dialogue is None else dialogue, F.lit(0))["role"]
    return F.when(
        ~first_role.eqNullSafe("system"), F.concat(F.array(message("system", F.lit(""))), messages)
    ).otherwise(messages)


def answer_suffix(full: Column, prompt: Column, strict: bool = False) -> Column:
    """What follows the first ``length(prompt)`` characters of ``full``.

    ``strict`` stops the job when ``full`` does not start with ``prompt``.
    """
    suffix = text_from(full, F.length(prompt))
    if strict:
        return F.when(F.startswith(full, prompt), suffix).otherwise(
            F.raise_error(F.lit("dialogue text does not start with its prompt text"))
        )
    return suffix


def format_pairs(
    df: DataFrame, template: str = "default", skip_system_message: bool = True, strict: bool = False
) -> DataFrame:
    """Add ``text_prompt``, ``text_chosen`` and ``text_rejected`` to a pair table."""
    require_columns(df, "chosen", "rejected")
    head, last = split_last_turn(F.col("chosen"))
    if not skip_system_message:
        return df.withColumns(
            {
                "text_prompt": render_chat(ensure_system_message(head, F.col("chosen")), template),
                "text_chosen": render_chat(last, template),
                "text_rejected": render_chat(split_last_turn(F.col("rejected"))[1], template),
            }
        )
    rendered = df.withColumns(
        {
            "text_prompt": render_chat(head, template),
            "_chosen": render_chat(F.col("chosen"), template),
            "_rejected": render_chat(F.col("rejected"), template),
        }
    )
    return rendered.withColumns(
        {
            "text_chosen": answer_suffix(F.col("_chosen"), F.col("text_prompt"), strict),
            "text_rejected": answer_suffix(F.col("_rejected"), F.col("text_prompt"), strict),
        }
    ).drop("_chosen", "_rejected")


def prune_and_rename(df: DataFrame, key: str | None = "prompt_idx") -> DataFrame:
    """Keep the three texts, under their short names, and the three probabilities."""
    return df.select(
        *([key] if key else []),
        *[F.col(f"text_{name}").alias(name) for name in ("prompt", "chosen", "rejected")],
        *PROBABILITY_COLUMNS,
    )


def nest_turns(turns: DataFrame, key: str = "conv_id") -> DataFrame:
    """Turn rows ``(key, turn, role, content)`` to one ``messages`` dialogue per key.

    A dialogue is one value here; the operators on turn rows take dialogues of any length.
    A null or repeated turn number has no place in the dialogue and stops the job.
    """
    ordered = F.array_sort(F.collect_list(F.struct("turn", "role", "content")))
    nested = turns.groupBy(key).agg(ordered.alias("_turns"))
    numbers = F.transform("_turns", lambda m: m["turn"])
    placed = ~F.exists(numbers, lambda n: n.isNull()) & (F.size(F.array_distinct(numbers)) == F.size("_turns"))
    return checked(nested, placed, named_key("null or repeated turn number", key)).select(
        key, F.transform("_turns", lambda m: F.struct(m["role"], m["content"])).alias("messages")
    )


def sft_text(messages: Column, template: str = "default") -> Column:
    """One training text per dialogue."""
    return render_chat(messages, template)


def attach_generator(
    df: DataFrame, generator: str | Column, strip_output: bool = True, keep: tuple[str, ...] = ()
) -> DataFrame:
    """Evaluation rows ``(instruction, output, generator)``."""
    output = strip(F.col("output")) if strip_output else F.col("output")
    name = F.lit(generator) if isinstance(generator, str) else generator
    return df.select("instruction", output.alias("output"), name.alias("generator"), *keep)
