"""Queries over token sequences and their log-probabilities."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from duelframe import views
from duelframe.catalog import query
from duelframe.catalog.shared import ASSISTANT_SQL, PAIRS, USER_SQL, formatted_pairs, joined, pairs, r6, s6
from duelframe.functions.columns import quotient
from duelframe.operators import logps, tokens
from duelframe.operators.tokens import Limits
from duelframe.plans import rounds
from duelframe.session import spread

BOS, EOS, PAD = 1, 2, 0
LIMITS = Limits(max_length=256, max_prompt_length=64)
BATCH = 4
PACKED = 128
TARGET = 100


def _ids_sql(text: str) -> str:
    return (
        rf"list_transform(list_filter(regexp_split_to_array({text}, '\s+'), lambda w: w <> ''),"
        " lambda w: CAST('0x' || substr(md5(w), 1, 7) AS INTEGER))"
    )


def _text(items: str) -> str:
    return f"array_to_string({items}, ' ')"


TRIPLES = f"""{PAIRS},
trip AS (
  SELECT prompt_idx, {USER_SQL.format("prompt")} AS prompt, {ASSISTANT_SQL.format("chosen")} AS chosen,
    {ASSISTANT_SQL.format("rejected")} AS rejected FROM pairs)"""

SPLIT = f"""{TRIPLES},
enc AS (
  SELECT prompt_idx, {_ids_sql("prompt")} AS p, {_ids_sql("prompt || chosen")} AS fc,
    {_ids_sql("prompt || rejected")} AS fr FROM trip),
cuts AS (
  SELECT *, CASE WHEN fc[1:len(p)] = p THEN len(p) ELSE len(p) - 1 END AS cc,
    CASE WHEN fr[1:len(p)] = p THEN len(p) ELSE len(p) - 1 END AS cr FROM enc),
split AS (
  SELECT prompt_idx, p, fc[1:cc] AS cp, fc[cc + 1:len(fc)] AS ca, fr[1:cr] AS rp, fr[cr + 1:len(fr)] AS ra,
    least(cc, cr) AS n FROM cuts)"""

FRAMED = f"""{SPLIT},
framed AS (
  SELECT prompt_idx, [{BOS}] || p[1:n] AS p, [{BOS}] || cp AS cp, ca || [{EOS}] AS ca,
    [{BOS}] || rp AS rp, ra || [{EOS}] AS ra,
    greatest(len(ca), len(ra)) + 1 AS longer FROM split)"""


def _cut_prompt(name: str) -> str:
    start = f"greatest(len({name}) - {LIMITS.max_prompt_length} + 1, 1)"
    return (
        f"CASE WHEN len({name}) + longer > {LIMITS.max_length}"
        f" THEN {name}[{start}:len({name})] ELSE {name} END AS {name}"
    )


def _cut_answer(name: str, prompt: str) -> str:
    kept = LIMITS.max_length - LIMITS.max_prompt_length
    return f"CASE WHEN len({prompt}) + longer > {LIMITS.max_length} THEN {name}[1:{kept}] ELSE {name} END AS {name}"


CUT = f"""{FRAMED},
cut1 AS (SELECT prompt_idx, {_cut_prompt("p")}, {_cut_prompt("cp")}, {_cut_prompt("rp")}, ca, ra, longer FROM framed),
cut AS (SELECT prompt_idx, p, cp, rp, {_cut_answer("ca", "cp")}, {_cut_answer("ra", "rp")} FROM cut1)"""

LABELS = """list_transform({prompt}, lambda x: -100) || {answer}"""

PARTS = {
    "prompt_ids": "p",
    "chosen_prompt_ids": "cp",
    "chosen_answer_ids": "ca",
    "rejected_prompt_ids": "rp",
    "rejected_answer_ids": "ra",
}
_PART_SQL = ", ".join(f"{_text(short)} AS {name}" for name, short in PARTS.items())


def _joined_parts(df: DataFrame) -> DataFrame:
    return df.select("prompt_idx", *[joined(name).alias(name) for name in PARTS])


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spread(views.load(spark, sf_dir, "documents").select("doc_id", "text"))


def _split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokens.split_pairs(formatted_pairs(spark, sf_dir))


@query(
    "tokenize",
    f"""SELECT doc_id, {_text(_ids_sql("text"))} AS ids, CAST(len({_ids_sql("text")}) AS INTEGER) AS n_attended
    FROM documents""",
)
def tokenize(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir)
    return tokens.tokenize(documents, "text").select(
        "doc_id",
        joined("text_input_ids").alias("ids"),
        F.size("text_attention_mask").alias("n_attended"),
    )


@query(
    "tokenize_with",
    "SELECT doc_id, array_to_string([length(text), len(string_split(text, ' '))], ' ') AS ids FROM documents",
)
def tokenize_with(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A caller's tokenizer run in Arrow batches; this one counts characters and spaces."""
    encode = tokens.tokenizer_encode(lambda: lambda texts: [[len(text), text.count(" ") + 1] for text in texts])
    documents = _documents(spark, sf_dir)
    return tokens.tokenize(documents, "text", encode).select("doc_id", joined("text_input_ids").alias("ids"))


@query("split_prompt_answer", f"WITH {SPLIT} SELECT prompt_idx, {_PART_SQL} FROM split")
def split_prompt_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_parts(_split(spark, sf_dir))


_DIFF = "CAST(len(list_filter(range(1, least(len(cp), len(rp)) + 1), lambda i: cp[i] <> rp[i])) AS INTEGER)"


@query(
    "prompt_consistency",
    f"""WITH {SPLIT} SELECT prompt_idx, {_DIFF} AS n_diff_tokens,
      CAST(abs(len(cp) - len(rp)) AS INTEGER) AS n_diff_length,
      {_DIFF} <= 1 AND abs(len(cp) - len(rp)) <= 1 AS consistent FROM split""",
)
def prompt_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    sides = (F.col("chosen_prompt_ids"), F.col("rejected_prompt_ids"))
    differing, length = tokens.prompt_difference(*sides)
    return _split(spark, sf_dir).select(
        "prompt_idx",
        differing.alias("n_diff_tokens"),
        length.alias("n_diff_length"),
        tokens.prompt_consistency(*sides).alias("consistent"),
    )


@query("trim_to_common_prompt", f"WITH {SPLIT} SELECT prompt_idx, {_text('p[1:n]')} AS prompt_ids FROM split")
def trim_to_common_prompt(spark: SparkSession, sf_dir: str) -> DataFrame:
    trimmed = tokens.trim_to_common_prompt(
        F.col("prompt_ids"), F.col("chosen_prompt_ids"), F.col("rejected_prompt_ids")
    )
    return _split(spark, sf_dir).select("prompt_idx", joined(trimmed).alias("prompt_ids"))


@query("add_bos_eos", f"WITH {FRAMED} SELECT prompt_idx, {_PART_SQL} FROM framed")
def add_bos_eos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _joined_parts(tokens.frame_pairs(_split(spark, sf_dir), BOS, EOS))


@query("longer_response", f"WITH {FRAMED} SELECT prompt_idx, CAST(longer AS INTEGER) AS longer FROM framed")
def longer_response(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = tokens.frame_pairs(_split(spark, sf_dir), BOS, EOS)
    longer = tokens.longer_response(F.col("chosen_answer_ids"), F.col("rejected_answer_ids"))
    return framed.select("prompt_idx", longer.alias("longer"))


@query("truncate_pair", f"WITH {CUT} SELECT prompt_idx, {_PART_SQL} FROM cut")
def truncate_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    framed = tokens.frame_pairs(_split(spark, sf_dir), BOS, EOS)
    return _joined_parts(tokens.truncate_pairs(framed, LIMITS))


@query(
    "mask_labels",
    f"""WITH {CUT} SELECT prompt_idx, {_text(LABELS.format(prompt="cp", answer="ca"))} AS chosen_labels,
      {_text(LABELS.format(prompt="rp", answer="ra"))} AS rejected_labels FROM cut""",
)
def mask_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.tokenize_pairs(formatted_pairs(spark, sf_dir), BOS, EOS, LIMITS)
    return rows.select("prompt_idx", *[joined(f"{side}_labels").alias(f"{side}_labels") for side in ("chosen", "rejected")])


_WHOLE = ", ".join(
    f"{_text(f'{head} || {answer}')} AS {side}_input_ids, CAST(len({head} || {answer}) AS INTEGER) AS {side}_attended,"
    f" {_text(LABELS.format(prompt=head, answer=answer))} AS {side}_labels"
    for side, head, answer in (("chosen", "cp", "ca"), ("rejected", "rp", "ra"))
)


@query(
    "training_rows",
    f"WITH {CUT} SELECT prompt_idx, {_text('p')} AS prompt_input_ids, CAST(len(p) AS INTEGER) AS prompt_attended, {_WHOLE} FROM cut",
)
def training_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The second half of the main path: built pairs to tokenized rows."""
    rows = rounds.training_rows(pairs(spark, sf_dir), BOS, EOS, limits=LIMITS)
    ids, attended = ("prompt", "chosen", "rejected"), "attention_mask"
    return rows.select(
        "prompt_idx",
        *[joined(f"{name}_input_ids").alias(f"{name}_input_ids") for name in ids],
        *[F.size(f"{name}_{attended}").alias(f"{name}_attended") for name in ids],
        *[joined(f"{side}_labels").alias(f"{side}_labels") for side in ids[1:]],
    )


def _padded(items: str, pad: int) -> str:
    return f"{items} || list_transform(range(width - len({items})), lambda x: {pad})"


@query(
    "pad_and_stack",
    f"""WITH {CUT},
    sides AS (
      SELECT prompt_idx, 'chosen' AS side, 0 AS side_pos, cp || ca AS ids, {LABELS.format(prompt="cp", answer="ca")} AS labels FROM cut
      UNION ALL
      SELECT prompt_idx, 'rejected', 1, rp || ra, {LABELS.format(prompt="rp", answer="ra")} FROM cut),
    wide AS (
      SELECT *, prompt_idx // {BATCH} AS batch_id,
        max(len(ids)) OVER (PARTITION BY prompt_idx // {BATCH}) AS width FROM sides)
    SELECT batch_id, prompt_idx, side, side_pos, {_text(_padded("ids", PAD))} AS input_ids,
      {_text(_padded("list_transform(ids, lambda x: 1)", 0))} AS attention_mask,
      {_text(_padded("labels", -100))} AS labels FROM wide""",
)
def pad_and_stack(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.tokenize_pairs(formatted_pairs(spark, sf_dir), BOS, EOS, LIMITS).withColumn(
        "batch_id", quotient(F.col("prompt_idx"), BATCH)
    )
    stacked = tokens.pad_and_stack(rows, PAD)
    return stacked.select(
        "batch_id", "prompt_idx", "side", "side_pos",
        *[joined(name).alias(name) for name in ("input_ids", "attention_mask", "labels")],
    )


@query(
    "encdec_truncate",
    f"""WITH {TRIPLES}, enc AS (
      SELECT prompt_idx, {_ids_sql("prompt")} AS p, {_ids_sql("chosen")} AS c, {_ids_sql("rejected")} AS r FROM trip)
    SELECT prompt_idx, {_text(f"c[1:{TARGET}]")} AS chosen_labels, {_text(f"r[1:{TARGET}]")} AS rejected_labels,
      {_text(f"p[1:{LIMITS.max_prompt_length}]")} AS prompt_input_ids,
      CAST(least(len(p), {LIMITS.max_prompt_length}) AS INTEGER) AS n_attended FROM enc""",
)
def encdec_truncate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tokens.encdec_truncate(formatted_pairs(spark, sf_dir), TARGET, LIMITS.max_prompt_length)
    return rows.select(
        "prompt_idx",
        *[joined(name).alias(name) for name in ("chosen_labels", "rejected_labels", "prompt_input_ids")],
        F.size("prompt_attention_mask").alias("n_attended"),
    )


@query(
    "pack_sequences",
    f"""WITH d AS (SELECT doc_id, {_ids_sql("text")} || [{EOS}] AS ids FROM documents),
    t AS (SELECT doc_id, unnest(ids) AS id, generate_subscripts(ids, 1) AS pos FROM d),
    s AS (SELECT id, row_number() OVER (ORDER BY doc_id, pos) - 1 AS place FROM t)
    SELECT place // {PACKED} AS chunk_id, count(*) AS n_tokens, string_agg(id, ' ' ORDER BY place) AS input_ids
    FROM s GROUP BY place // {PACKED}""",
)
def pack_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir).select("doc_id", tokens.word_ids(F.col("text")).alias("ids"))
    return tokens.pack_sequences(documents, "ids", "doc_id", PACKED, EOS).select(
        "chunk_id", F.size("input_ids").cast("long").alias("n_tokens"), joined("input_ids").alias("input_ids")
    )


@query(
    "truncate_left",
    f"""WITH d AS (SELECT doc_id, {_ids_sql("text")} AS ids FROM documents)
    SELECT doc_id, {_text("ids[greatest(len(ids) - 63, 1):len(ids)]")} AS ids FROM d""",
)
def truncate_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = _documents(spark, sf_dir).select("doc_id", tokens.word_ids(F.col("text")).alias("ids"))
    return documents.select("doc_id", joined(tokens.truncate_left(F.col("ids"), 64)).alias("ids"))


TOK = """tok AS (
  SELECT vec_id // 8 AS seq_id, CAST(vec_id % 8 AS INTEGER) AS pos,
    CASE WHEN label = 0 THEN -100 ELSE label END AS label,
    list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS l FROM embeddings)"""

LOGP_SQL = """CASE WHEN label = -100 THEN 0.0 ELSE l[label + 1] - list_max(l)
  - ln(list_sum(list_transform(l, lambda x: exp(x - list_max(l))))) END"""

SHIFTED = f"""{TOK},
nxt AS (
  SELECT a.seq_id, a.pos, a.l, b.label FROM tok a
  JOIN tok b ON a.seq_id = b.seq_id AND b.pos = a.pos + 1)"""


@query("token_logps", f"WITH {TOK} SELECT seq_id, pos, label, {s6(LOGP_SQL)} AS logp FROM tok")
def token_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logps.token_logps(views.token_logits(spark, sf_dir)).select(
        "seq_id", "pos", "label", r6("logp").alias("logp")
    )


@query("next_token_shift", f"WITH {SHIFTED} SELECT seq_id, pos, label FROM nxt")
def next_token_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return logps.next_token_shift(views.token_logits(spark, sf_dir)).select("seq_id", "pos", "label")


@query(
    "sequence_logp",
    f"""WITH {SHIFTED}, lp AS (SELECT seq_id, label, {LOGP_SQL} AS logp FROM nxt)
    SELECT seq_id, {s6("sum(logp)")} AS total, {s6("sum(logp) / nullif(count(*) FILTER (label <> -100), 0)")} AS mean
    FROM lp GROUP BY seq_id""",
)
def sequence_logp(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = logps.token_logps(logps.next_token_shift(views.token_logits(spark, sf_dir)))
    return logps.sequence_logps(scored).select(
        "seq_id", r6("total").alias("total"), r6(F.nanvl("mean", F.lit(None))).alias("mean")
    )


@query(
    "completion_logps",
    f"""WITH {TOK} SELECT seq_id, pos,
      {s6(f"CASE WHEN label = 9 THEN 0.0 ELSE {LOGP_SQL} END")} AS logp FROM tok WHERE pos >= 2""",
)
def completion_logps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions with label 9 are padding."""
    masked = views.token_logits(spark, sf_dir).withColumn("mask", F.when(F.col("label") == 9, 0).otherwise(1))
    return logps.completion_logps(masked, context_length=2).select("seq_id", "pos", r6("logp").alias("logp"))
