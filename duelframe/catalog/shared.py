"""SQL fragments and small helpers used by several query groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import views
from duelframe.operators.candidates import pair_statistics, score_arrays, stack_candidates
from duelframe.operators.chat import format_pairs, prune_and_rename
from duelframe.plans.rounds import offline_round

K = views.CANDIDATES


# Many results are exact short decimals. One that ends in a 5 just past the last kept
# digit would round by the order of its sum; the offset, far below that digit and far
# above double precision, moves such values off the edge on both sides.
_OFF_EDGE = 3e-8


def rounded(value: Column | str, digits: int = 6) -> Column:
    column = F.col(value) if isinstance(value, str) else value
    return F.round(column + F.lit(_OFF_EDGE), digits)


def sql_rounded(expression: str, digits: int = 6) -> str:
    """The same in SQL; adding 0.0 turns -0.0 into 0.0."""
    return f"(round(({expression}) + {_OFF_EDGE}, {digits}) + 0.0)"


r6, s6 = rounded, sql_rounded


def joined(items: Column | str, separator: str = " ") -> Column:
    """An array as one text, so that results compare as plain values."""
    column = F.col(items) if isinstance(items, str) else items
    return F.array_join(column.cast("array<string>"), separator)


def messages_long(df: DataFrame, dialogue: str, *keys: str) -> DataFrame:
    """One row per message: keys, position, role, content."""
    return df.select(*keys, F.posexplode(dialogue).alias("position", "_m")).select(
        *keys, "position", F.col("_m.role").alias("role"), F.col("_m.content").alias("content")
    )


def score_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all prompts; the last one has fewer than K where K doesn't divide the documents."""
    return score_arrays(views.scores(spark, sf_dir), K, partial=True)


def statistics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pair_statistics(score_table(spark, sf_dir))


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return offline_round(
        views.prompts(spark, sf_dir), views.responses(spark, sf_dir), views.scores(spark, sf_dir), K, partial=True
    )


def candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stack_candidates(views.responses(spark, sf_dir), K, partial=True)


def formatted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prompt, chosen and rejected texts of the pairs built from all candidates."""
    formatted = prune_and_rename(format_pairs(pairs(spark, sf_dir)))
    return formatted.select("prompt_idx", "prompt", "chosen", "rejected")


CAND = """cand AS (
  SELECT doc_id // 5 AS prompt_idx, CAST(doc_id % 5 AS INTEGER) AS sample_id, doc_id,
         text AS response, ln(1 + n_chars) AS score
  FROM documents)"""

PROB = f"""{CAND},
prob AS (
  SELECT a.prompt_idx, a.sample_id AS i, b.sample_id AS j,
         1 / (1 + exp(b.score - a.score)) AS prob
  FROM cand a JOIN cand b ON a.prompt_idx = b.prompt_idx),
win AS (SELECT prompt_idx, i, sum(prob) / 5 AS win FROM prob GROUP BY prompt_idx, i)"""

STATS = f"""{PROB},
best AS (
  SELECT prompt_idx, sample_id AS best FROM cand
  QUALIFY row_number() OVER (PARTITION BY prompt_idx ORDER BY score DESC, sample_id) = 1),
worst AS (
  SELECT prompt_idx, sample_id AS worst FROM cand
  QUALIFY row_number() OVER (PARTITION BY prompt_idx ORDER BY score, sample_id) = 1),
stats AS (
  SELECT b.prompt_idx, b.best, w.worst, p.prob AS chosen_probs,
         bw.win AS chosen_probs_win, ww.win AS chosen_probs_lose
  FROM best b JOIN worst w ON b.prompt_idx = w.prompt_idx
  JOIN prob p ON p.prompt_idx = b.prompt_idx AND p.i = b.best AND p.j = w.worst
  JOIN win bw ON bw.prompt_idx = b.prompt_idx AND bw.i = b.best
  JOIN win ww ON ww.prompt_idx = b.prompt_idx AND ww.i = w.worst)"""

PAIRS = f"""{STATS},
pairs AS (
  SELECT s.*, g.url AS prompt, c.response AS chosen, r.response AS rejected
  FROM stats s JOIN pages g ON g.page_id = s.prompt_idx
  JOIN cand c ON c.prompt_idx = s.prompt_idx AND c.sample_id = s.best
  JOIN cand r ON r.prompt_idx = s.prompt_idx AND r.sample_id = s.worst)"""

PROBABILITIES = ", ".join(
    f"{s6(name)} AS {name}" for name in ("chosen_probs", "chosen_probs_win", "chosen_probs_lose")
)

# Rendered forms of one turn.
USER_SQL = "'<|user|>' || chr(10) || {0} || '</s>' || chr(10)"
SYSTEM_SQL = "'<|system|>' || chr(10) || {0} || '</s>' || chr(10)"
ASSISTANT_SQL = "'<|assistant|>' || chr(10) || {0} || '</s>' || chr(10)"


def probabilities() -> list[Column]:
    return [r6(name).alias(name) for name in ("chosen_probs", "chosen_probs_win", "chosen_probs_lose")]
