"""Quality classifier: a byte-level convolutional network in numpy.

Learned filters look at every ``WIDTH`` consecutive bytes. Each filter's greatest response
is taken within chunks of a document; chunks overlap and together cover all of it. Mean and
maximum over the chunks are combined into one probability. Only bytes enter a score.

The network is trained on the driver with a bounded sample of labelled documents; every
document is scored in the tasks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from duelframe.llm.bytewise import blocks, text_buffer
from duelframe.llm.names import unused
from duelframe.session import materialize

WIDTH = 6
FILTERS = 8
CHUNK = 256
STEP = 192
# Labelled documents the network is trained on, at most.
SAMPLE_ROWS = 2500
# Bytes of their texts together, at most; a text of more than a 64th of it is left out of training.
SAMPLE_BYTES = 64 << 20
# Texts shown in training, repeats included: a small sample is shown more often.
SHOWN = 16_000
THRESHOLD = 0.7
# Weight of a good document in training, so that one of few bytes is not lost for want of evidence.
GOOD_WEIGHT = 2.0
_SCORE_BLOCK = 1 << 19
# Chunks handled at a time, of long documents and in training.
PIECE_CHUNKS = 512


@dataclass
class Network:
    """Filters by byte and offset, their offsets, and the weights of mean and maximum."""

    filters: np.ndarray  # WIDTH x 256 x FILTERS
    offset: np.ndarray
    weights: np.ndarray  # 2 * FILTERS
    bias: float

    def __post_init__(self) -> None:
        # Two neighbouring bytes are looked up at once.
        self.pairs = [
            (self.filters[i][:, None, :] + self.filters[i + 1][None, :, :]).reshape(65536, -1).astype(np.float32)
            for i in range(0, WIDTH, 2)
        ]

    def responses(self, padded: np.ndarray) -> np.ndarray:
        """Every filter at every place, without the last ``WIDTH - 1`` places."""
        two = padded[:-1].astype(np.int32) * 256 + padded[1:]
        n = len(padded) - WIDTH + 1
        total = self.pairs[0][two[:n]]
        for i, table in enumerate(self.pairs[1:], 1):
            total += table[two[2 * i : 2 * i + n]]
        return total

    def combine(self, peaks: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Probability and combined features of documents whose chunks begin at ``firsts``."""
        active = np.maximum(peaks + self.offset, 0)
        counts = np.diff([*firsts, len(peaks)])
        mean = np.add.reduceat(active, firsts) / counts[:, None]
        features = np.concatenate([mean, np.maximum.reduceat(active, firsts)], axis=1)
        logits = np.clip(features @ self.weights + self.bias, -30, 30)
        return 1 / (1 + np.exp(-logits)), features

    def score_long(self, data: np.ndarray) -> float:
        """Score of one long document, some chunks at a time: maxima and sums are carried on."""
        count = 1 + max(0, -(-(len(data) - CHUNK) // STEP))
        total, most = np.zeros(FILTERS), np.full(FILTERS, -np.inf)
        for first in range(0, count, PIECE_CHUNKS):
            chunks = min(PIECE_CHUNKS, count - first)
            low = first * STEP
            high = min(len(data), low + (chunks - 1) * STEP + CHUNK)
            padded = np.zeros(high - low + WIDTH, dtype=np.uint8)
            own = data[low : high + WIDTH]
            padded[: len(own)] = own
            begins = np.arange(chunks) * STEP
            spots = np.stack([begins, np.minimum(begins + CHUNK, high - low)], axis=1).ravel()
            peaks = np.maximum.reduceat(self.responses(padded), spots)[::2]
            active = np.maximum(peaks.astype(np.float64) + self.offset, 0)
            total += active.sum(axis=0)
            most = np.maximum(most, active.max(axis=0))
        logit = np.clip(np.concatenate([total / count, most]) @ self.weights + self.bias, -30, 30)
        return float(1 / (1 + np.exp(-logit)))

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        if len(offsets) == 2 and len(data) > _SCORE_BLOCK:
            return np.array([self.score_long(data)])
        padded, begins, ends, firsts = _layout(data, offsets)
        spots = np.stack([begins, ends], axis=1).ravel()
        values = self.responses(padded)
        peaks = np.maximum.reduceat(np.concatenate([values, np.full((1, FILTERS), -np.inf, np.float32)]), spots)[::2]
        return self.combine(peaks.astype(np.float64), firsts)[0]


def _layout(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ``WIDTH`` zeros behind each document; begin and end of chunks; first chunks.

    An empty document has one chunk of one place, over zeros.
    """
    lengths = np.diff(offsets)
    places = np.maximum(lengths, 1)
    padded = np.zeros(int((places + WIDTH).sum()), dtype=np.uint8)
    base = np.cumsum(places + WIDTH) - (places + WIDTH)
    padded[np.arange(len(data)) + np.repeat(base - offsets[:-1], lengths)] = data
    counts = 1 + np.maximum(0, -(-(places - CHUNK) // STEP))
    firsts = np.cumsum(counts) - counts
    order = np.arange(counts.sum()) - np.repeat(firsts, counts)
    begins = np.repeat(base, counts) + order * STEP
    ends = np.minimum(begins + CHUNK, np.repeat(base + places, counts))
    return padded, begins, ends, firsts


def train(texts: list[bytes], labels: list[int], shown: int = SHOWN, seed: int = 7) -> Network:
    """Fit the network by stochastic gradients (Adam) on cross-entropy.

    Without any labelled text the network is neutral and gives 0.5 to every document.
    """
    rng = np.random.default_rng(seed)
    if not texts:
        return Network(np.zeros((WIDTH, 256, FILTERS)), np.zeros(FILTERS), np.zeros(2 * FILTERS), 0.0)
    values = [rng.normal(0, 0.15, (WIDTH, 256, FILTERS)), np.zeros(FILTERS), rng.normal(0, 0.3, 2 * FILTERS), np.zeros(1)]
    first, second = [np.zeros_like(v) for v in values], [np.zeros_like(v) for v in values]
    target = np.array(labels, dtype=np.float64)
    step, epochs = 0, -(-shown // len(texts))
    for epoch in range(epochs):
        rate = 0.02 * (1 - epoch / epochs)
        order = rng.permutation(len(texts))
        for part in np.split(order, range(32, len(order), 32)):
            step += 1
            gradients = _gradients(values, [texts[i] for i in part], target[part])
            for v, g, m, s in zip(values, gradients, first, second):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                v -= rate * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
            values[0] *= 1 - 0.02 * rate
    return Network(values[0], values[1], values[2], float(values[3][0]))


def _gradients(values: list[np.ndarray], texts: list[bytes], target: np.ndarray) -> list[np.ndarray]:
    filters, offset, weights, bias = values
    network = Network.__new__(Network)
    network.filters, network.offset, network.weights, network.bias = filters, offset, weights, float(bias[0])
    data = np.frombuffer(b"".join(texts), np.uint8)
    padded, begins, ends, firsts = _layout(data, np.cumsum([0, *map(len, texts)]))
    peaks, chosen = np.empty((len(begins), FILTERS)), np.empty((len(begins), FILTERS), dtype=np.int64)
    for first in range(0, len(begins), PIECE_CHUNKS):
        part = slice(first, first + PIECE_CHUNKS)
        low, high = int(begins[part][0]), int(ends[part].max())
        response = sum(filters[j][padded[low + j : high + j]] for j in range(WIDTH))
        # Places of each chunk; a short last chunk repeats its last place.
        places = np.minimum(begins[part, None] + np.arange(CHUNK), ends[part, None] - 1)
        spread = response[places - low]
        at = spread.argmax(axis=1)
        peaks[part] = np.take_along_axis(spread, at[:, None, :], axis=1)[:, 0]
        chosen[part] = np.take_along_axis(places, at, axis=1)
    probability, features = network.combine(peaks, firsts)
    error = (probability - target) * np.where(target == 1, GOOD_WEIGHT, 1.0) / len(target)
    to_features = error[:, None] * weights
    counts = np.diff([*firsts, len(peaks)])
    owner = np.repeat(np.arange(len(counts)), counts)
    active = np.maximum(peaks + offset, 0)
    to_active = to_features[owner, :FILTERS] / counts[owner, None]
    greatest = active == features[owner, FILTERS:]
    ties = np.add.reduceat(greatest.astype(np.float64), firsts)
    to_active += np.where(greatest, to_features[owner, FILTERS:] / ties[owner], 0)
    to_peaks = to_active * (peaks + offset > 0)
    to_filters = np.zeros_like(filters)
    which = np.broadcast_to(np.arange(FILTERS), chosen.shape)
    for j in range(WIDTH):
        np.add.at(to_filters[j], (padded[chosen + j], which), to_peaks)
    return [to_filters, to_peaks.sum(axis=0), features.T @ error, np.array([error.sum()])]


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Network:
    """Train on at most ``sample_rows`` labelled documents that are not held out, of ``sample_bytes`` together.

    The sample is chosen by a hash of the id, from labels alone; only its texts are read
    into the driver, of an id with several rows the least. Rows without a label, an id or a document are left out.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max("quality").alias("quality"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary").alias("text"))
    sample = materialize(texts.join(chosen, "doc_id").groupBy("doc_id", "quality").agg(F.min("text").alias("text")), "labelled-texts")
    before = Window.orderBy(F.xxhash64("doc_id"), "doc_id")  # as many rows as the sample has
    length = F.octet_length("text")
    small = sample.filter(length <= sample_bytes // 64)
    within = small.select("doc_id", F.sum(length).over(before).alias("_bytes")).filter(F.col("_bytes") <= sample_bytes)
    rows = sample.join(F.broadcast(within), "doc_id", "left_semi").collect()
    rows = sorted((row["doc_id"], bytes(row["text"]), row["quality"]) for row in rows)
    return train([text for _, text, _ in rows], [int(quality) for _, _, quality in rows])


def score_documents(docs: DataFrame, network: Network, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text", out: str = "score") -> DataFrame:
    """``keep`` columns with the probability of good quality as ``out``.

    Null texts score like empty ones. Repeated rows each get their row; equal texts have
    equal scores.
    """
    shared = docs.sparkSession.sparkContext.broadcast(network)
    kept = list(dict.fromkeys(keep))
    source = docs.select(*[F.col(name).alias(f"_keep{i}") for i, name in enumerate(kept)], F.col(text_col).cast("string").alias("_text"))
    schema = source.drop("_text").withColumn("_score", F.lit(0.0)).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column("_text"))
            scores = [
                shared.value.score(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]) for a, b in blocks(offsets, _SCORE_BLOCK)
            ]
            column = pa.array(np.concatenate([np.zeros(0), *scores]), pa.float64())
            yield pa.RecordBatch.from_arrays([column if n == "_score" else batch.column(n) for n in schema.names], names=schema.names)

    done = source.mapInArrow(run, schema)
    return done.select(*[F.col(f"_keep{i}").alias(name) for i, name in enumerate(kept)], F.col("_score").alias(out))


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document.

    Null and empty texts get the score of no bytes; long ones are scored whole. A null id is not held out;
    rows that share an id each get their row, equal texts equal scores. Without labels every score is
    0.5, without documents there are no rows.
    """
    scored = score_documents(docs, fit(docs, labels))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"),
    )


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents the classifier predicts to be good, all columns kept."""
    names = docs.columns
    out = unused(docs, "score")
    scored = score_documents(docs, fit(docs, labels), keep=tuple(names), out=out)
    return scored.filter(F.col(out) >= THRESHOLD).select(*names)
