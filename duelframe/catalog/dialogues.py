"""Queries over chat formatting and reshaping."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import views
from duelframe.catalog import query
from duelframe.catalog.shared import (
    ASSISTANT_SQL, CAND, K, PAIRS, PROBABILITIES, SYSTEM_SQL, USER_SQL,
    candidates, messages_long, pairs, probabilities,
)
from duelframe.operators import chat, turns
from duelframe.schema import require_columns


@query(
    "prompt_template",
    f"""SELECT page_id AS prompt_idx,
      {USER_SQL.format("url")} || '<|assistant|>' || chr(10) AS default_form,
      '<s>[INST] ' || url || ' [/INST]' AS inst_form,
      split_part('<s>[INST] ' || url || ' [/INST]', 'None', 1) AS compat_form
    FROM pages""",
)
def prompt_template(spark: SparkSession, sf_dir: str) -> DataFrame:
    prompt = F.col("prompt")
    return views.prompts(spark, sf_dir).select(
        "prompt_idx",
        chat.prompt_template(prompt).alias("default_form"),
        chat.prompt_template(prompt, "inst").alias("inst_form"),
        chat.prompt_template(prompt, "inst", compat=True).alias("compat_form"),
    )


@query(
    "build_messages",
    f"""WITH {CAND}
    SELECT prompt_idx, 'generate_' || sample_id AS candidate, 0 AS position, 'user' AS role, url AS content
    FROM cand JOIN pages ON page_id = prompt_idx
    UNION ALL
    SELECT prompt_idx, 'generate_' || sample_id, 1, 'assistant', response
    FROM cand JOIN pages ON page_id = prompt_idx""",
)
def build_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = chat.generated_table(views.prompts(spark, sf_dir), candidates(spark, sf_dir), K)
    long = wide.unpivot(["prompt_idx"], [f"generate_{i}" for i in range(K)], "candidate", "dialogue")
    return messages_long(long, "dialogue", "prompt_idx", "candidate")


@query(
    "to_conversational",
    "SELECT page_id AS prompt_idx, 0 AS position, 'user' AS role, url AS content FROM pages",
)
def to_conversational(spark: SparkSession, sf_dir: str) -> DataFrame:
    return messages_long(chat.to_conversational(views.prompts(spark, sf_dir)), "prompt", "prompt_idx")


_LAST = "last AS (SELECT conv_id, max(turn) AS last_turn FROM conversations GROUP BY conv_id)"


@query(
    "prompt_from_chosen",
    f"""WITH {_LAST}
    SELECT c.conv_id, turn, role, text AS content
    FROM conversations c JOIN last l ON c.conv_id = l.conv_id WHERE turn < last_turn""",
)
def prompt_from_chosen(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.prompt_turns(views.turns(spark, sf_dir)).select("conv_id", "turn", "role", "content")


@query(
    "dispatch_prompt_schema",
    f"""WITH {PAIRS} SELECT prompt_idx, 0 AS position, 'user' AS role, prompt AS content FROM pairs""",
)
def dispatch_prompt_schema(spark: SparkSession, sf_dir: str) -> DataFrame:
    pair_table = pairs(spark, sf_dir).select("prompt_idx", "chosen", "rejected")
    return messages_long(chat.dispatch_prompt_schema(pair_table, "prompt_idx"), "prompt", "prompt_idx")


@query(
    "split_last_turn",
    f"""WITH {_LAST}
    SELECT c.conv_id, turn, role, text AS content, turn = last_turn AS is_last
    FROM conversations c JOIN last l ON c.conv_id = l.conv_id""",
)
def split_last_turn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.mark_last_turn(views.turns(spark, sf_dir)).select(
        "conv_id", "turn", "role", "content", "is_last"
    )


@query(
    "ensure_system_message",
    """SELECT conv_id, turn, role, text AS content FROM conversations
    UNION ALL
    SELECT conv_id, -1, 'system', '' FROM (
      SELECT conv_id, role FROM conversations
      QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn) = 1) WHERE role <> 'system'""",
)
def ensure_system_message(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.ensure_system_turn(views.turns(spark, sf_dir))


@query(
    "render_turns",
    f"""SELECT conv_id, turn,
      CASE role WHEN 'user' THEN {USER_SQL.format("text")}
                WHEN 'system' THEN {SYSTEM_SQL.format("text")}
                WHEN 'assistant' THEN {ASSISTANT_SQL.format("text")} ELSE '' END AS piece
    FROM conversations""",
)
def render_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.render_turns(views.turns(spark, sf_dir)).select("conv_id", "turn", "piece")


@query(
    "render_chat",
    f"""SELECT conv_id, string_agg(
      CASE role WHEN 'user' THEN {USER_SQL.format("text")}
                WHEN 'system' THEN {SYSTEM_SQL.format("text")}
                WHEN 'assistant' THEN {ASSISTANT_SQL.format("text")} ELSE '' END, '' ORDER BY turn) AS rendered
    FROM conversations GROUP BY conv_id""",
)
def render_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    nested = chat.nest_turns(views.turns(spark, sf_dir))
    return nested.select("conv_id", chat.render_chat(F.col("messages")).alias("rendered"))


@query(
    "answer_suffix",
    f"""WITH {PAIRS}
    SELECT prompt_idx, {USER_SQL.format("prompt")} AS text_prompt,
      {ASSISTANT_SQL.format("chosen")} AS text_chosen, {ASSISTANT_SQL.format("rejected")} AS text_rejected
    FROM pairs""",
)
def answer_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(pairs(spark, sf_dir), strict=True).select(
        "prompt_idx", "text_prompt", "text_chosen", "text_rejected"
    )


@query(
    "format_with_system",
    f"""WITH {PAIRS}
    SELECT prompt_idx, {SYSTEM_SQL.format("''")} || {USER_SQL.format("prompt")} AS text_prompt,
      {ASSISTANT_SQL.format("chosen")} AS text_chosen, {ASSISTANT_SQL.format("rejected")} AS text_rejected
    FROM pairs""",
)
def format_with_system(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.format_pairs(pairs(spark, sf_dir), skip_system_message=False).select(
        "prompt_idx", "text_prompt", "text_chosen", "text_rejected"
    )


@query(
    "require_pair_columns",
    f"WITH {PAIRS} SELECT prompt_idx, 2 AS n_chosen, 2 AS n_rejected FROM pairs",
)
def require_pair_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    checked = require_columns(pairs(spark, sf_dir), "chosen", "rejected")
    return checked.select(
        "prompt_idx", F.size("chosen").alias("n_chosen"), F.size("rejected").alias("n_rejected")
    )


@query(
    "prune_and_rename",
    f"""WITH {PAIRS}
    SELECT prompt_idx, '<s>[INST] ' || prompt || ' [/INST]' AS prompt, chosen || '</s>' AS chosen,
      rejected || '</s>' AS rejected, {PROBABILITIES} FROM pairs""",
)
def prune_and_rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    renamed = chat.prune_and_rename(chat.format_pairs(pairs(spark, sf_dir), "inst"))
    return renamed.select("prompt_idx", "prompt", "chosen", "rejected", *probabilities())


@query("stack_candidates", f"WITH {CAND} SELECT prompt_idx, sample_id, response FROM cand")
def stack_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    stacked = candidates(spark, sf_dir).select(
        "prompt_idx", F.posexplode("candidates").alias("sample_id", "response")
    )
    return stacked.filter(F.col("response").isNotNull())


_STRIP = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"


@query(
    "eval_prompt",
    f"""SELECT doc_id, CASE WHEN lang = 'en' THEN '<s>[INST] ' || text || ' [/INST]'
      ELSE {_STRIP.format("text")} || chr(10) || chr(10) END AS eval_prompt FROM documents""",
)
def eval_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A template that covers English only; the other instructions fall back."""
    text = F.col("text")
    rendered = F.when(F.col("lang") == "en", chat.prompt_template(text, "inst"))
    return views.load(spark, sf_dir, "documents").select(
        "doc_id", chat.eval_prompt(text, rendered).alias("eval_prompt")
    )


@query(
    "attach_generator",
    f"""SELECT doc_id, lang AS instruction, {_STRIP.format("text")} AS output, source AS generator
    FROM documents""",
)
def attach_generator(spark: SparkSession, sf_dir: str) -> DataFrame:
    outputs = views.load(spark, sf_dir, "documents").select(
        "doc_id", F.col("lang").alias("instruction"), F.col("text").alias("output"), "source"
    )
    return chat.attach_generator(outputs, F.col("source"), keep=("doc_id",))


@query(
    "strip_prompt_prefix",
    f"WITH {CAND} SELECT prompt_idx, sample_id, response AS shown FROM cand JOIN pages ON page_id = prompt_idx",
)
def strip_prompt_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    opening = chat.prompt_template(F.col("prompt"))
    generated = views.responses(spark, sf_dir).join(views.prompts(spark, sf_dir), "prompt_idx")
    return generated.select(
        "prompt_idx",
        "sample_id",
        chat.answer_suffix(F.concat(opening, F.col("response")), opening).alias("shown"),
    )


_LLAMA_SQL = "'<|begin_of_text|>' || string_agg('<|start_header_id|>' || role || '<|end_header_id|>' || chr(10) || chr(10) || trim(text, ' ' || chr(9) || chr(10) || chr(13)) || '<|eot_id|>', '' ORDER BY turn)"


@query("sft_text", f"SELECT conv_id, {_LLAMA_SQL} AS text FROM conversations GROUP BY conv_id")
def sft_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Under a template with a form for all three roles, so that every turn is in the text."""
    nested = chat.nest_turns(views.turns(spark, sf_dir))
    return nested.select("conv_id", chat.sft_text(F.col("messages"), "llama-3").alias("text"))


_TRIMMED = "trim({0}, ' ' || chr(9) || chr(10) || chr(13))"


def _gemma_sql(answer: str) -> str:
    return (
        f"'<bos><start_of_turn>user' || chr(10) || {_TRIMMED.format('prompt')} || '<end_of_turn>' || chr(10)"
        f" || '<start_of_turn>model' || chr(10) || {_TRIMMED.format(answer)} || '<end_of_turn>' || chr(10)"
    )


@query(
    "render_chat_gemma",
    f"WITH {PAIRS} SELECT prompt_idx, {_gemma_sql('chosen')} AS chosen, {_gemma_sql('rejected')} AS rejected FROM pairs",
)
def render_chat_gemma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chosen and rejected dialogues under a template without a system role."""
    return pairs(spark, sf_dir).select(
        "prompt_idx", *[chat.render_chat(F.col(side), "gemma-2").alias(side) for side in ("chosen", "rejected")]
    )
