"""Self-BLEU of several samples per prompt, after the published definition of BLEU."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.functions.columns import checked, evaluated_once, named_key
from duelframe.operators.tokens import Encode, words

# Fixed value: longest n-gram of the published score.
MAX_ORDER = 4

# Tokens counted at a time: sorting them needs some hundred bytes for each.
SLICE_TOKENS = 1 << 18

_MULTIPLIER, _MIXER = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFF51AFD7ED558CCD)


def _longer_grams(grams: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Ids of n-grams from those one shorter and the tokens behind them."""
    ids = grams * _MULTIPLIER + tokens
    ids ^= ids >> np.uint64(29)
    ids *= _MIXER
    return ids ^ (ids >> np.uint64(32))


def _clipped_matches(prompt: np.ndarray, sample: np.ndarray, grams: np.ndarray, prompts: int, k: int) -> np.ndarray:
    """Per prompt and sample: occurrences of its n-grams, each counted at most as often as another sample has it.

    Occurrences are sorted into runs of one n-gram of one sample. Runs of one n-gram stand together,
    so the largest count among the other samples is the largest of them, or the next one for the sample that has it.
    """
    order = np.lexsort((sample, grams, prompt))
    prompt, sample, grams = prompt[order], sample[order], grams[order]
    new_gram = np.ones(len(grams), dtype=bool)
    new_gram[1:] = (grams[1:] != grams[:-1]) | (prompt[1:] != prompt[:-1])
    new_run = new_gram.copy()
    new_run[1:] |= sample[1:] != sample[:-1]
    runs = np.flatnonzero(new_run)
    counts = np.diff(np.append(runs, len(grams)))
    heads = np.flatnonzero(new_gram[runs])  # first run of each n-gram
    most = np.maximum.reduceat(counts, heads)
    gram_of = np.repeat(np.arange(len(heads)), np.diff(np.append(heads, len(runs))))
    is_most = counts == most[gram_of]
    alone_at_top = np.add.reduceat(is_most, heads) == 1
    next_most = np.maximum.reduceat(np.where(is_most, 0, counts), heads)
    others = np.where(is_most & alone_at_top[gram_of], next_most[gram_of], most[gram_of])
    place = prompt[runs] * k + sample[runs]
    return np.bincount(place, weights=np.minimum(counts, others), minlength=prompts * k).reshape(prompts, k)


def _scores(lengths: np.ndarray, tokens: np.ndarray, max_order: int) -> np.ndarray:
    """BLEU of each sample of each prompt; ``lengths`` is -1 where there is none, ``tokens`` come in their order."""
    prompts, k = lengths.shape
    sizes = np.maximum(lengths, 0).ravel()
    place = np.repeat(np.arange(prompts * k), sizes)
    last = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(tokens))  # tokens of the text from here on
    logs, all_match = np.zeros((prompts, k)), np.ones((prompts, k), dtype=bool)
    grams = tokens
    for order in range(1, max_order + 1):
        if order > 1:
            grams = _longer_grams(grams[:-1], tokens[order - 1 :])
        inside = last[: len(grams)] >= order
        own = place[: len(grams)][inside]
        matches = _clipped_matches(own // k, own % k, grams[inside], prompts, k) if len(own) else np.zeros((prompts, k))
        all_match &= matches > 0
        logs += np.log(np.maximum(matches, 1) / np.maximum(lengths - (order - 1), 1))
    gaps = np.abs(lengths[:, :, None] - lengths[:, None, :]) * 2 + (lengths[:, None, :] > lengths[:, :, None])
    missing = (lengths[:, None, :] < 0) | np.eye(k, dtype=bool)
    nearest = np.where(missing, np.iinfo(np.int64).max, gaps).argmin(axis=2)  # the shorter one on ties
    reference = np.take_along_axis(lengths, nearest, axis=1)
    brevity = np.where(lengths > reference, 0.0, 1.0 - reference / np.maximum(lengths, 1))
    return np.where(all_match & (lengths > 0), np.exp(brevity + logs / max_order), 0.0)


def _slices(batch: pa.RecordBatch, names: list[str], size: int) -> Iterator[pa.RecordBatch]:
    """Consecutive prompts with about ``size`` tokens together; a longer prompt is a slice of its own."""
    tokens = sum(np.asarray(batch.column(name).value_lengths().fill_null(0), dtype=np.int64) for name in names)
    ends, first = np.cumsum(tokens), 0
    while first < len(ends):
        before = ends[first - 1] if first else 0
        last = max(int(np.searchsorted(ends, before + size, side="right")), first + 1)
        yield batch.slice(first, last - first)
        first = last


def self_bleu(
    responses: DataFrame, k: int, tokenize: Encode = words, max_order: int = MAX_ORDER
) -> DataFrame:
    """BLEU of every sample against the other samples of its prompt: ``(prompt_idx, sample_id, bleu)``.

    Texts become arrays of 64-bit token ids before the one shuffle, on the prompt, which puts
    the samples of a prompt into k columns; a prompt holds at most k texts. Slices of batches, of
    ``SLICE_TOKENS`` tokens whatever the size of a batch, then count n-grams as runs in sorted arrays
    of ids made from the ids of their tokens; no n-gram is a row. An order without any match makes the score 0 (no smoothing). Prompts with
    a single sample have nothing to compare with and score 0. A sample id outside ``0..k-1`` and
    a repeated sample stop the job.
    """
    ids = F.coalesce(F.transform(tokenize(F.col("response")), lambda token: F.xxhash64(token)), F.array().cast("array<long>"))
    tokens = evaluated_once(responses.select("prompt_idx", "sample_id", "response"), {"_ids": ids})

    def of(i: int) -> Column:
        return F.col("sample_id") == i

    per_prompt = tokens.groupBy("prompt_idx").agg(
        *[F.first(F.when(of(i), F.col("_ids")), ignorenulls=True).alias(f"_ids{i}") for i in range(k)],
        F.greatest(*[F.count_if(of(i)) for i in range(k)], F.lit(0)).alias("_copies"),
        F.count_if(F.col("sample_id").isNull() | ~F.col("sample_id").between(0, k - 1)).alias("_stray"),
    )
    usable = (F.col("_stray") == 0) & (F.col("_copies") <= 1)
    per_prompt = checked(per_prompt, usable, named_key(f"samples must be 0 to {k - 1}, each once", "prompt_idx")).drop("_stray", "_copies")
    prompt_type = responses.schema["prompt_idx"].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f"_ids{i}" for i in range(k)]
        for part in (part for batch in batches for part in _slices(batch, names, SLICE_TOKENS)):
            columns = [part.column(name) for name in names]
            lengths = np.stack([np.asarray(c.value_lengths().fill_null(-1), dtype=np.int64) for c in columns], axis=1)
            # Prompt by prompt and sample by sample, as the lengths are.
            own = [c.flatten().to_numpy(zero_copy_only=False).view(np.uint64) for c in columns]
            sizes = np.maximum(lengths, 0)
            ends = np.cumsum(sizes.ravel()).reshape(sizes.shape)
            mixed = np.empty(int(sizes.sum()), dtype=np.uint64)
            for i, values in enumerate(own):
                begins = np.repeat(ends[:, i] - np.cumsum(sizes[:, i]), sizes[:, i])
                mixed[np.arange(len(values)) + begins] = values
            found = _scores(lengths, mixed, max_order)
            row, sample = np.nonzero(lengths >= 0)
            yield pa.RecordBatch.from_arrays(
                [part.column("prompt_idx").take(pa.array(row)), pa.array(sample, pa.int32()), pa.array(found[row, sample])],
                names=["prompt_idx", "sample_id", "bleu"],
            )

    return per_prompt.mapInArrow(score, f"prompt_idx {prompt_type}, sample_id int, bleu double")


def mean_self_bleu(per_sample: DataFrame) -> DataFrame:
    """Mean score per prompt."""
    return per_sample.groupBy("prompt_idx").agg(F.avg("bleu").alias("self_bleu"))
