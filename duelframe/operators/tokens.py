"""Token sequences of preference pairs: encoding, cutting, labels, padding, packing.

Sequences are arrays inside a row, so everything but padding and packing is row-local.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from duelframe.functions.columns import checked, drop_first, evaluated_once, quotient, take_first, take_last
from duelframe.session import materialize

# Label of positions that carry no loss, and the length a tokenizer
# without a stated limit is given.
IGNORE_LABEL = -100
DEFAULT_MAX_LENGTH = 2048

Encode = Callable[[Column], Column]
TOKEN_IDS = T.ArrayType(T.IntegerType())


@dataclass(frozen=True)
class Limits:
    """Lengths in tokens and the side of the prompt that survives a cut."""

    max_length: int = 1024
    max_prompt_length: int = 512
    mode: str = "keep_end"

    def __post_init__(self) -> None:
        if not 0 < self.max_prompt_length <= self.max_length:
            raise ValueError("need 0 < max_prompt_length <= max_length")
        if self.mode not in ("keep_start", "keep_end"):
            raise ValueError(f"unknown truncation mode {self.mode}")


def words(text: Column) -> Column:
    """Tokens of the built-in white space tokenizer."""
    return F.filter(F.split(text, r"\s+"), lambda word: word != "")


def word_ids(text: Column) -> Column:
    """Ids of the built-in tokenizer: 28 bits of each word's md5, no vocabulary needed."""
    return F.transform(
        words(text), lambda word: F.conv(F.substring(F.md5(word), 1, 7), 16, 10).cast("int")
    )


def tokenizer_encode(make_tokenizer: Callable[[], Callable[[list[str]], Sequence[Sequence[int]]]]) -> Encode:
    """Encoder from a caller's tokenizer, built once per task.

    The tokenizer gets the texts of an Arrow batch as one list and gives one list of ids
    per text; a null text is not shown to it and stays null.
    """

    @F.pandas_udf(TOKEN_IDS)
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenize = make_tokenizer()
        for texts in batches:
            there = texts.notna()
            found = list(tokenize(texts[there].tolist())) if there.any() else []
            if len(found) != there.sum():
                raise ValueError(f"the tokenizer gave {len(found)} results for {there.sum()} texts")
            ids = pd.Series([None] * len(texts), index=texts.index, dtype=object)
            ids[there] = pd.Series([[int(i) for i in one] for one in found], index=texts.index[there], dtype=object)
            yield ids

    return encode


def tokenize(df: DataFrame, column: str, encode: Encode = word_ids) -> DataFrame:
    """Add ``{column}_input_ids`` and ``{column}_attention_mask``."""
    ids = f"{column}_input_ids"
    return df.withColumn(ids, encode(F.col(column))).withColumn(
        f"{column}_attention_mask", ones(F.col(ids))
    )


def ones(items: Column) -> Column:
    return F.array_repeat(F.lit(1), F.size(items))


def prompt_cut(prompt_ids: Column, full_ids: Column) -> Column:
    """Where the answer starts in the jointly encoded text: one token earlier when the
    last prompt token was merged with the answer's first one."""
    n = F.size(prompt_ids)
    return (
        F.when(F.size(full_ids) < n, F.raise_error(F.lit("joint encoding is shorter than the prompt")))
        .when(take_first(full_ids, n) == prompt_ids, n)
        .otherwise(n - 1)
        .cast("int")
    )


def split_prompt_answer(prompt_ids: Column, full_ids: Column) -> tuple[Column, Column]:
    """(prompt part, answer part) of the jointly encoded text."""
    cut = prompt_cut(prompt_ids, full_ids)
    return take_first(full_ids, cut), drop_first(full_ids, cut)


def prompt_difference(chosen_prompt: Column, rejected_prompt: Column) -> tuple[Column, Column]:
    """(differing tokens over the common length, difference of the lengths)."""
    common = F.least(F.size(chosen_prompt), F.size(rejected_prompt))
    same = F.zip_with(
        take_first(chosen_prompt, common), take_first(rejected_prompt, common), lambda a, b: a != b
    )
    return (
        F.size(F.filter(same, lambda differs: differs)),
        F.abs(F.size(chosen_prompt) - F.size(rejected_prompt)),
    )


def prompt_consistency(chosen_prompt: Column, rejected_prompt: Column) -> Column:
    """True when the two prompts differ by at most one token and one position."""
    tokens, length = prompt_difference(chosen_prompt, rejected_prompt)
    return (tokens <= 1) & (length <= 1)


def trim_to_common_prompt(
    prompt_ids: Column, chosen_prompt: Column, rejected_prompt: Column
) -> Column:
    """The prompt alone, cut to the shorter of the two prompt parts."""
    return take_first(prompt_ids, F.least(F.size(chosen_prompt), F.size(rejected_prompt)))


def add_bos(ids: Column, bos: int) -> Column:
    return F.concat(F.array(F.lit(bos)), ids)


def add_eos(ids: Column, eos: int) -> Column:
    return F.concat(ids, F.array(F.lit(eos)))


def longer_response(chosen: Column, rejected: Column) -> Column:
    """Length of the longer answer of a pair."""
    return F.greatest(F.size(chosen), F.size(rejected))


def truncate_prompt(prompt_ids: Column, longer: Column, limits: Limits) -> Column:
    """Cut the prompt when it and the longer answer exceed the length limit."""
    n = limits.max_prompt_length
    kept = take_first(prompt_ids, n) if limits.mode == "keep_start" else take_last(prompt_ids, n)
    return F.when(F.size(prompt_ids) + longer > limits.max_length, kept).otherwise(prompt_ids)


def truncate_answer(answer_ids: Column, cut_prompt: Column, longer: Column, limits: Limits) -> Column:
    """Cut the answer when its cut prompt and the longer answer still exceed the limit."""
    kept = take_first(answer_ids, limits.max_length - limits.max_prompt_length)
    return F.when(F.size(cut_prompt) + longer > limits.max_length, kept).otherwise(answer_ids)


def mask_labels(prompt_ids: Column, answer_ids: Column) -> Column:
    """Labels of prompt + answer with the prompt part ignored."""
    return F.concat(F.array_repeat(F.lit(IGNORE_LABEL), F.size(prompt_ids)), answer_ids)


def truncate_left(ids: Column, max_length: int = DEFAULT_MAX_LENGTH) -> Column:
    """Keep the end of a text input."""
    return take_last(ids, max_length)


def split_pairs(df: DataFrame, encode: Encode = word_ids) -> DataFrame:
    """Encode ``prompt``, ``chosen``, ``rejected`` texts and cut the two joint encodings.

    Adds ``prompt_ids`` (the prompt encoded alone) and, per side, ``{side}_prompt_ids``
    and ``{side}_answer_ids``. Each text is encoded once, whatever reads the ids later.
    """
    encoded = evaluated_once(
        df,
        {
            "_prompt": encode(F.col("prompt")),
            "_chosen": encode(F.concat("prompt", "chosen")),
            "_rejected": encode(F.concat("prompt", "rejected")),
        },
    )
    parts = {"prompt_ids": F.col("_prompt")}
    for side in ("chosen", "rejected"):
        head, answer = split_prompt_answer(F.col("_prompt"), F.col(f"_{side}"))
        parts[f"{side}_prompt_ids"] = head
        parts[f"{side}_answer_ids"] = answer
    return encoded.withColumns(parts).drop("_prompt", "_chosen", "_rejected")


def inconsistent_prompts(split: DataFrame, key: str = "prompt_idx") -> DataFrame:
    """Keys of pairs whose two prompt parts differ too much."""
    tokens, length = prompt_difference(F.col("chosen_prompt_ids"), F.col("rejected_prompt_ids"))
    return split.select(key, tokens.alias("n_diff_tokens"), length.alias("n_diff_length")).filter(
        (F.col("n_diff_tokens") > 1) | (F.col("n_diff_length") > 1)
    )


def frame_pairs(split: DataFrame, bos: int, eos: int) -> DataFrame:
    """Trim the lone prompt, then put BOS before prompts and EOS after answers."""
    common = trim_to_common_prompt(
        F.col("prompt_ids"), F.col("chosen_prompt_ids"), F.col("rejected_prompt_ids")
    )
    framed = {"prompt_ids": add_bos(common, bos)}
    for side in ("chosen", "rejected"):
        framed[f"{side}_prompt_ids"] = add_bos(F.col(f"{side}_prompt_ids"), bos)
        framed[f"{side}_answer_ids"] = add_eos(F.col(f"{side}_answer_ids"), eos)
    return evaluated_once(split, framed)


def truncate_pairs(framed: DataFrame, limits: Limits) -> DataFrame:
    """Cut prompts, then answers, of framed pairs to the limits."""
    longer = F.col("_longer")
    prompts_cut = framed.withColumn(
        "_longer", longer_response(F.col("chosen_answer_ids"), F.col("rejected_answer_ids"))
    ).withColumns(
        {
            name: truncate_prompt(F.col(name), longer, limits)
            for name in ("prompt_ids", "chosen_prompt_ids", "rejected_prompt_ids")
        }
    )
    return prompts_cut.withColumns(
        {
            f"{side}_answer_ids": truncate_answer(
                F.col(f"{side}_answer_ids"), F.col(f"{side}_prompt_ids"), longer, limits
            )
            for side in ("chosen", "rejected")
        }
    ).drop("_longer")


def tokenize_pairs(
    df: DataFrame, bos: int, eos: int, limits: Limits = Limits(), encode: Encode = word_ids
) -> DataFrame:
    """Training columns of formatted pairs.

    Adds ``{chosen,rejected}_{input_ids,attention_mask,labels}`` and
    ``prompt_{input_ids,attention_mask}``. A pair whose prompts differ by more than the
    tokenizer can explain stops the job.
    """
    split = split_pairs(df, encode)
    fits = prompt_consistency(F.col("chosen_prompt_ids"), F.col("rejected_prompt_ids"))
    kept = checked(split, fits, "chosen and rejected prompts differ beyond their last token")
    cut = truncate_pairs(frame_pairs(kept, bos, eos), limits)
    columns = {
        "prompt_input_ids": F.col("prompt_ids"),
        "prompt_attention_mask": ones(F.col("prompt_ids")),
    }
    for side in ("chosen", "rejected"):
        head, answer = F.col(f"{side}_prompt_ids"), F.col(f"{side}_answer_ids")
        columns[f"{side}_input_ids"] = F.concat(head, answer)
        columns[f"{side}_attention_mask"] = F.array_repeat(F.lit(1), F.size(head) + F.size(answer))
        columns[f"{side}_labels"] = mask_labels(head, answer)
    return cut.withColumns(columns).drop(
        "prompt_ids",
        *[f"{side}_{part}_ids" for side in ("chosen", "rejected") for part in ("prompt", "answer")],
    )


def encdec_truncate(
    df: DataFrame, max_target_length: int, max_prompt_length: int, encode: Encode = word_ids
) -> DataFrame:
    """Encoder-decoder columns: every field cut on its own, answers as labels."""
    ids = take_first(encode(F.col("prompt")), max_prompt_length)
    return df.withColumns(
        {
            "chosen_labels": take_first(encode(F.col("chosen")), max_target_length),
            "rejected_labels": take_first(encode(F.col("rejected")), max_target_length),
            "prompt_input_ids": ids,
        }
    ).withColumn("prompt_attention_mask", ones(F.col("prompt_input_ids")))


def _pad(items: Column, width: Column, value: int) -> Column:
    return F.concat(items, F.array_repeat(F.lit(value), width - F.size(items)))


def pad_and_stack(tokenized: DataFrame, pad_id: int = 0, batch_col: str = "batch_id") -> DataFrame:
    """One row per side, padded to the longest sequence of the batch.

    The batch maximum is aggregated before the shuffle and joined back, so a batch
    with very many rows is not gathered in one task. The sequences are written once,
    as both steps need them and the maximum reads only their lengths. ``side_pos`` 0 is
    chosen, 1 rejected.
    """
    parts = ("input_ids", "attention_mask", "labels")
    longer = longer_response(F.col("chosen_input_ids"), F.col("rejected_input_ids"))
    stored = materialize(tokenized.withColumn("_longer", longer), "tokenized")
    widths = stored.groupBy(batch_col).agg(F.max("_longer").alias("_width"))
    sides = F.array(
        *[
            F.struct(
                F.lit(place).alias("side_pos"),
                F.lit(side).alias("side"),
                *[F.col(f"{side}_{part}").alias(part) for part in parts],
            )
            for place, side in enumerate(("chosen", "rejected"))
        ]
    )
    replaced = {f"{side}_{part}" for side in ("chosen", "rejected", "prompt") for part in parts}
    carried = [name for name in tokenized.columns if name not in replaced]
    padding = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE_LABEL}
    return (
        stored.join(widths, batch_col)
        .select(*carried, "_width", F.inline(sides))
        .withColumns({name: _pad(F.col(name), F.col("_width"), pad) for name, pad in padding.items()})
        .drop("_width")
    )


def pack_sequences(
    df: DataFrame, ids_col: str, id_col: str, max_seq_length: int, eos: int | None = None
) -> DataFrame:
    """Join all sequences end to end in id order and cut the stream every ``max_seq_length``.

    The sequences are written once, as they come. Only a narrow row of each, its order, length and
    place in that table, is brought into order by range; lengths are summed inside the ranges,
    whose starts come from a table with one row per range. So a sequence learns its place in the stream
    by one join. It hands out one slice per chunk it touches, and a chunk gathers at most
    ``max_seq_length`` tokens. The last chunk may be shorter. Ids are of any sortable type;
    null ids come first, and rows that share an id follow each other in the order of a hash of
    their tokens. Gives ``(chunk_id, input_ids)``.
    """
    ids = F.col(ids_col) if eos is None else add_eos(F.col(ids_col), eos)
    written = evaluated_once(df.select(F.col(id_col).alias("_id"), F.col(ids_col)), {"_ids": ids})
    stored = materialize(
        written.filter(F.size("_ids") > 0).select(
            "_id", F.xxhash64("_ids").alias("_hash"), F.size("_ids").cast("long").alias("_n"), F.monotonically_increasing_id().alias("_row"), "_ids"
        ),
        "sequences",
    )
    starts = stream_starts(stored.select("_id", "_hash", "_n", "_row"))
    placed = stored.select("_row", "_n", "_ids").join(starts, "_row")
    start, end = F.col("_start"), F.col("_start") + F.col("_n") - 1

    def piece(chunk: Column) -> Column:
        first = F.greatest(chunk * max_seq_length - start, F.lit(0))
        # A chunk that begins inside this sequence takes a full width from it; one that
        # began earlier takes what is left of the width.
        room = max_seq_length - F.greatest(start - chunk * max_seq_length, F.lit(0))
        taken = F.slice("_ids", (first + 1).cast("int"), room.cast("int"))
        return F.struct(chunk.alias("chunk_id"), F.struct(start.alias("start"), taken.alias("ids")).alias("_piece"))

    chunks = F.sequence(quotient(start, max_seq_length), quotient(end, max_seq_length))
    pieces = placed.select(F.inline(F.transform(chunks, piece)))
    return pieces.groupBy("chunk_id").agg(
        F.flatten(F.transform(F.array_sort(F.collect_list("_piece")), lambda p: p["ids"])).alias(
            "input_ids"
        )
    )


def stream_starts(lengths: DataFrame) -> DataFrame:
    """``_row`` and ``_start``, the sum of ``_n`` over all rows before in the order of ``_id`` and ``_hash``.

    ``_row`` tells rows apart that are equal otherwise. The sorted rows are written once, so that
    ranges stay the same whatever is computed again.
    """
    order = (F.col("_id").asc_nulls_first(), F.col("_hash"), F.col("_row"))
    ranged = materialize(
        lengths.repartitionByRange(*order).sortWithinPartitions(*order).select(
            F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().alias("_place"), "_n", "_row"
        ),
        "lengths",
    )
    begins, total = [], 0
    for row in ranged.groupBy("_part").agg(F.sum("_n").alias("_n")).orderBy("_part").collect():
        begins.append((row["_part"], total))  # one row per range, so their number is fixed by the session settings
        total += row["_n"]
    begins = lengths.sparkSession.createDataFrame(begins, "_part int, _begin long")
    before = Window.partitionBy("_part").orderBy("_place").rowsBetween(Window.unboundedPreceding, -1)
    inside = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return ranged.withColumn("_inside", inside).join(F.broadcast(begins), "_part").select("_row", (F.col("_begin") + F.col("_inside")).alias("_start"))
