"""LM scoring by masked pseudo-likelihood with a bidirectional window network in numpy.

The network predicts every word from the two words on either side of it, the word itself
left out. A document's score is the sum of the logarithms of these conditional
probabilities. The network knows the corpus's most frequent words by exact counts over all
documents, more of them the larger the corpus; other words share buckets by hash. An id's
probability is that of its class times that of its place in the class, so no layer is as
wide as the vocabulary. A word in a bucket has the bucket's probability times the word's own
share of the bucket, from the exact counts of all words; these stay a table, and documents
ask it batch by batch (``exchange``). Words that were never counted have a share as well.

Training covers all documents. In each round tasks train copies of their own over their shares,
starting from the common parameters, and the copies are averaged, weighted by their words,
slice by slice. The rounds take disjoint shares of the documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, fields

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import AtomicType

from duelframe.llm import exchange
from duelframe.llm.bytewise import LOWER, PLAIN_WORDS, blocks, text_buffer, word_hashes, word_spans
from duelframe.session import materialize

CLASS = 32  # ids in a class, and classes, of a small corpus
VOCABULARY = CLASS * CLASS
# With the words of the corpus both grow by their sixth root: the ids by their cube root.
CLASS_GROWTH = 2.5
# Hashes a word that was never counted may have.
HASHES = 2.0**64
OFFSETS = (-2, -1, 1, 2)
HIDDEN = 16
ROUNDS = 2
# Words a copy of the network is trained on, for each of its parameters.
WORDS_PER_PARAMETER = 8
# Bytes of all copies of a slice of the parameters.
SLICE_BYTES = 4 << 20
RATE = 0.01
# Words of a training step: small at first, so that a small share also makes many steps.
FIRST_STEP = 1_024
GROW_EVERY = 16
TRAIN_STEP = 16_384
SCORE_STEP = 32_768
_PAD = 0
# Words whose counts a task gathers before it hands them on.
_COUNT_WORDS = 1 << 20


@dataclass
class Parameters:
    context: np.ndarray  # offsets x vocabulary x hidden
    hidden: np.ndarray
    classes: np.ndarray  # hidden x classes
    class_bias: np.ndarray
    words: np.ndarray  # classes x hidden x words of a class
    word_bias: np.ndarray

    @classmethod
    def initial(cls, seed: int = 11, side: int = CLASS) -> Parameters:
        rng = np.random.default_rng(seed)
        shape = lambda *s: rng.normal(0, 0.1, s).astype(np.float32)
        zero = lambda *s: np.zeros(s, np.float32)
        return cls(
            shape(len(OFFSETS), side * side, HIDDEN), zero(HIDDEN), shape(HIDDEN, side), zero(side), shape(side, HIDDEN, side), zero(side, side)
        )

    def arrays(self) -> list[np.ndarray]:
        return [getattr(self, f.name) for f in fields(self)]

    def flat(self) -> np.ndarray:
        return np.concatenate([a.ravel() for a in self.arrays()])

    def replaced(self, flat: np.ndarray) -> Parameters:
        parts = np.split(flat.astype(np.float32), np.cumsum([a.size for a in self.arrays()])[:-1])
        return Parameters(*[p.reshape(a.shape) for p, a in zip(parts, self.arrays())])


# Logits are shifted by a bound of them all, and by each row's largest where the bound is so far up that exponentials could vanish.
_FAR = 60.0


def _bounds(weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """What no logit exceeds, as hidden units lie between -1 and 1."""
    return (np.abs(weights).sum(axis=-2) + np.abs(bias)).max(axis=-1)


def _softmax(active: np.ndarray, weights: np.ndarray, bias: np.ndarray, bound: float, target: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Exponentials of the shifted logits, their sums, and the logarithm of each target's share of them."""
    logits = active @ weights
    logits += bias - bound
    if bound > _FAR:
        logits -= logits.max(axis=1, keepdims=True)
    own = logits[np.arange(len(target)), target]
    np.exp(logits, out=logits)
    sums = logits @ np.ones(logits.shape[1], logits.dtype)
    return logits, sums, own - np.log(sums)


class _Pass:
    """Forward pass over words and their contexts; keeps what the gradients need, once."""

    def __init__(self, p: Parameters, target: np.ndarray, around: np.ndarray):
        self.target, self.around, self.side = target, around, len(p.class_bias)
        total = p.context[0][around[0]]
        for table, ids in zip(p.context[1:], around[1:]):
            total += table[ids]
        self.active = np.tanh(total + p.hidden)
        self.of_class = target // self.side
        self.order = np.argsort(self.of_class, kind="stable")
        cuts = np.searchsorted(self.of_class[self.order], np.arange(self.side + 1))
        self.parts = [(c, self.order[a:b]) for c, a, b in zip(range(self.side), cuts[:-1], cuts[1:]) if b > a]
        *self.class_parts, self.log = _softmax(self.active, p.classes, p.class_bias, _bounds(p.classes, p.class_bias), self.of_class)
        bounds, self.word_parts = _bounds(p.words, p.word_bias), []
        for c, rows in self.parts:
            active, place = self.active[rows], target[rows] % self.side
            exponentials, sums, log = _softmax(active, p.words[c], p.word_bias[c], bounds[c], place)
            self.word_parts.append((active, place, exponentials, sums))
            self.log[rows] += log

    def gradients(self, p: Parameters) -> Parameters:
        n = np.float32(len(self.target))
        wrong, sums = self.class_parts
        wrong /= sums[:, None]
        wrong[np.arange(len(self.target)), self.of_class] -= 1
        to_active = wrong @ p.classes.T
        words, word_bias = np.zeros_like(p.words), np.zeros_like(p.word_bias)
        for (c, rows), (active, place, off, sums) in zip(self.parts, self.word_parts):
            off /= sums[:, None]
            off[np.arange(len(rows)), place] -= 1
            words[c] = active.T @ off / n
            word_bias[c] = off.sum(axis=0) / n
            to_active[rows] += off @ p.words[c].T
        to_hidden = to_active * (1 - self.active**2) / n
        flat, unit = to_hidden.ravel(), np.arange(HIDDEN)
        context = np.stack(
            [
                np.bincount((ids[:, None] * HIDDEN + unit).ravel(), weights=flat, minlength=self.side**2 * HIDDEN).reshape(-1, HIDDEN)
                for ids in self.around
            ]
        ).astype(np.float32)
        return Parameters(context, to_hidden.sum(axis=0), self.active.T @ wrong / n, wrong.sum(axis=0) / n, words, word_bias)


class Trainer:
    """Stochastic gradients with Adam, over words gathered to steps of one size."""

    def __init__(self, start: Parameters):
        self.p, self.seen, self.step = start.replaced(start.flat()), 0, 0
        self.first, self.second = [[np.zeros_like(a) for a in start.arrays()] for _ in range(2)]
        self.waiting: list[tuple[np.ndarray, np.ndarray]] = []
        self.count = 0

    def feed(self, target: np.ndarray, around: np.ndarray) -> None:
        self.waiting.append((target, around))
        self.count += len(target)
        if self.count >= TRAIN_STEP:
            self.finish()

    def size(self) -> int:
        return min(TRAIN_STEP, FIRST_STEP * (1 + self.step // GROW_EVERY))

    def finish(self) -> None:
        if not self.count:
            return
        target = np.concatenate([t for t, _ in self.waiting])
        around = np.concatenate([a for _, a in self.waiting], axis=1)
        self.waiting, self.count = [], 0
        # Neighbouring words are alike; a step takes its words from all over what is there.
        order = np.random.default_rng(self.step).permutation(len(target))
        at = 0
        while at < len(order):
            rows = order[at : at + self.size()]
            at += len(rows)
            self.update(_Pass(self.p, target[rows], around[:, rows]).gradients(self.p), len(rows))

    def update(self, gradients: Parameters, words: int) -> None:
        self.step += 1
        self.seen += words
        for a, g, m, s in zip(self.p.arrays(), gradients.arrays(), self.first, self.second):
            m += 0.1 * (g - m)
            s += 0.01 * (g * g - s)
            a -= RATE * (m / (1 - 0.9**self.step)) / (np.sqrt(s / (1 - 0.99**self.step)) + 1e-8)


@dataclass
class Vocabulary:
    """Hashes of the frequent words, sorted, the id of each, and how many classes the ids fill."""

    hashes: np.ndarray
    ids: np.ndarray
    side: int = CLASS

    @property
    def buckets(self) -> int:
        """Ids at the end that rare words share: a quarter of all but the padding's."""
        return self.side**2 // 4 - 1

    def rare(self, ids: np.ndarray) -> np.ndarray:
        return ids >= self.side**2 - self.buckets

    def bucket(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes % np.uint64(self.buckets)).astype(np.int64)

    def encode(self, hashes: np.ndarray) -> np.ndarray:
        rare = self.side**2 - self.buckets + self.bucket(hashes)
        if not len(self.hashes):
            return rare
        slot = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[slot] == hashes, self.ids[slot], rare)


@dataclass
class RareWords:
    """Exact counts of all words (``word``, ``n``), and of each bucket its words' sum and number."""

    counts: DataFrame
    words: np.ndarray
    kinds: np.ndarray


def log_shares(bucket: np.ndarray, n: np.ndarray, words: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Logarithm of a word's share of its bucket, ``n`` times counted.

    As many occurrences as the bucket has different words are set aside for words never
    counted and spread evenly over the hashes of the bucket (Witten and Bell).
    """
    aside = np.maximum(kinds, 1)
    known = np.where(n > 0, n, aside[bucket] * (len(kinds) / HASHES))
    return np.log(known / (words + aside)[bucket])


def _hashed_blocks(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Word hashes, and first words of the documents, of each block."""
    data, offsets = text_buffer(texts)
    for a, b in blocks(offsets):
        part = LOWER[data[offsets[a] : offsets[b]]]
        starts, ends, firsts = word_spans(part, offsets[a : b + 1] - offsets[a], PLAIN_WORDS)
        yield word_hashes(part, starts, ends), firsts


def _around(ids: np.ndarray, firsts: np.ndarray) -> np.ndarray:
    """Ids around each word, within its document."""
    sizes = np.diff(firsts)
    left = np.arange(len(ids)) - np.repeat(firsts[:-1], sizes)
    right = np.repeat(sizes, sizes) - 1 - left
    around = np.full((len(OFFSETS), len(ids)), _PAD, dtype=np.int64)
    for row, offset in zip(around, OFFSETS):
        inside = np.flatnonzero(left >= -offset) if offset < 0 else np.flatnonzero(right >= offset)
        row[inside] = ids[inside + offset]
    return around


def count_words(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``word`` (a 64-bit hash) and ``n`` over all documents."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def counted() -> pa.RecordBatch:
            words, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(words.view(np.int64)), pa.array(n.astype(np.int64))], names=["word", "n"])

        for batch in batches:
            for hashes, _ in _hashed_blocks(batch.column(0)):
                held.append(hashes)
                if sum(map(len, held)) >= _COUNT_WORDS:
                    yield counted()
        if held:
            yield counted()

    rows = docs.select(F.col(text_col).cast("string")).mapInArrow(count, "word long, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n"))


def frequent_words(counts: DataFrame) -> Vocabulary:
    """The most frequent words, as many as there are ids beside the rare buckets."""
    total = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    found = Vocabulary(np.zeros(0, np.uint64), np.zeros(0, np.int64), max(CLASS, int(CLASS_GROWTH * total ** (1 / 6))))
    rows = counts.orderBy(F.desc("n"), "word").limit(found.side**2 - found.buckets - 1).collect()
    hashes = np.array([row["word"] for row in rows], dtype=np.int64).view(np.uint64)
    order = np.argsort(hashes)
    # Ids follow frequency: a class holds words about equally frequent.
    found.hashes, found.ids = hashes[order], np.arange(1, len(rows) + 1, dtype=np.int64)[order]
    return found


def rare_words(counts: DataFrame, vocabulary: Vocabulary) -> RareWords:
    """``counts`` with the sums of the words outside the vocabulary, bucket by bucket."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, kinds = np.zeros(vocabulary.buckets), np.zeros(vocabulary.buckets, np.int64)
        for batch in batches:
            hashes = batch.column(0).to_numpy().view(np.uint64)
            rare = vocabulary.rare(vocabulary.encode(hashes))
            bucket = vocabulary.bucket(hashes[rare])
            words += np.bincount(bucket, weights=batch.column(1).to_numpy()[rare], minlength=len(words))
            kinds += np.bincount(bucket, minlength=len(kinds))
        at = pa.array(np.arange(len(kinds)))
        yield pa.RecordBatch.from_arrays([at, pa.array(words.astype(np.int64)), pa.array(kinds)], names=["bucket", "words", "kinds"])

    summed = counts.select("word", "n").mapInArrow(add, "bucket long, words long, kinds long")
    rows = summed.groupBy("bucket").agg(F.sum("words").alias("words"), F.sum("kinds").alias("kinds")).collect()
    words, kinds = np.zeros(vocabulary.buckets), np.zeros(vocabulary.buckets)
    for row in rows:
        words[row["bucket"]], kinds[row["bucket"]] = row["words"], row["kinds"]
    return RareWords(counts, words, kinds)


def train(docs: DataFrame, vocabulary: Vocabulary, words: int, text_col: str = "text", rounds: int = ROUNDS) -> Parameters:
    """Common parameters after ``rounds`` rounds, each over its own share of all documents.

    A task trains a copy and hands it on as slices of packed numbers. There are as many copies as ``words``, the
    number of all, allows at ``WORDS_PER_PARAMETER`` for each, so what is moved follows the corpus.
    Slices are averaged in tasks of their own and come to the driver packed.
    """
    parameters = Parameters.initial(side=vocabulary.side)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("_text"))
    size = len(parameters.flat())
    copies = max(1, words // (rounds * WORDS_PER_PARAMETER * size))
    # All copies of a slice meet in one task.
    length = max(256, min(size, SLICE_BYTES // (4 * copies)))
    for number in range(rounds):
        shared = context.broadcast((vocabulary, parameters))

        def fit(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocabulary, start = shared.value
            trainer = Trainer(start)
            for batch in batches:
                for hashes, firsts in _hashed_blocks(batch.column(0)):
                    ids = vocabulary.encode(hashes)
                    trainer.feed(ids, _around(ids, firsts))
            trainer.finish()
            if trainer.seen:
                flat = trainer.p.flat().astype("<f4")
                parts = [flat[at : at + length].tobytes() for at in range(0, size, length)]
                columns = [pa.array(np.arange(len(parts))), pa.array(parts, pa.binary()), pa.array(np.full(len(parts), trainer.seen))]
                yield pa.RecordBatch.from_arrays(columns, names=["slice", "part", "words"])

        share = texts.filter(F.pmod(F.xxhash64("_text"), F.lit(rounds)) == number)
        trained = share.coalesce(copies).mapInArrow(fit, "slice long, part binary, words long")
        rows = trained.groupBy("slice").applyInArrow(_mean_slice, "slice long, part binary").collect()
        if rows:
            mean = b"".join(bytes(row["part"]) for row in sorted(rows, key=lambda row: row["slice"]))
            parameters = parameters.replaced(np.frombuffer(mean, "<f4"))
    return parameters


def _mean_slice(table: pa.Table) -> pa.Table:
    """Mean of the copies of a slice, weighted by the words each has seen; in an order of their own, as rows come in any."""
    copies = sorted(zip(table.column("words").to_pylist(), table.column("part").to_pylist()))
    total = sum(words for words, _ in copies)
    mean = sum(np.frombuffer(part, "<f4").astype(np.float64) * (words / total) for words, part in copies)
    return pa.table([table.column("slice").slice(0, 1), pa.array([mean.astype("<f4").tobytes()], pa.binary())], names=["slice", "part"])


def score_documents(
    docs: DataFrame, vocabulary: Vocabulary, parameters: Parameters, rare: RareWords, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text"
) -> DataFrame:
    """``keep`` columns with ``n_tokens`` and ``log_likelihood``, the sum over all words.

    A text without words, null ones too, has no token and a sum of 0. Equal texts have
    equal scores up to rounding. Every row gives a row; other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, parameters))
    kept = list(dict.fromkeys(keep))
    source = docs.select(*[F.col(name).alias(f"_keep{i}") for i, name in enumerate(kept)], F.col(text_col).cast("string").alias("_text"))
    schema = source.drop("_text").withColumn("n_tokens", F.lit(0).cast("long")).withColumn("log_likelihood", F.lit(0.0)).schema
    total = exchange.corpus_bytes(source, "_text")
    # Rows of one text are dealt by their other columns as well.
    dealt_by = [F.col(f.name) for f in source.schema if isinstance(f.dataType, AtomicType)]
    count = max(1, -(-total // exchange.BATCH_BYTES))
    texts = source.withColumn("_batch", F.pmod(F.xxhash64(*dealt_by), F.lit(count)))
    words, kinds = rare.words, rare.kinds
    shards = exchange.shard_count(total + 8 * int(words.sum()))

    def question(table: pa.Table) -> list[exchange.Row]:
        vocabulary, _ = shared.value
        held = [np.zeros(0, np.uint64)]
        for hashes, _ in _hashed_blocks(table.column("_text")):
            held.append(np.unique(hashes[vocabulary.rare(vocabulary.encode(hashes))]))
        keys = np.unique(np.concatenate(held))
        return exchange.by_shard(0, exchange.shard_of(keys, shards), keys, np.zeros(0, np.uint8)) if len(keys) else []

    def reply(asked: pa.Table, counted: pa.Table) -> pa.Table:
        vocabulary, _ = shared.value
        known = counted.column("word").to_numpy().view(np.uint64)
        order = np.argsort(known)
        # A word that was never counted finds the extra place at the end.
        known, n = known[order], np.append(counted.column("n").to_numpy()[order], 0)
        codes = []
        for keys in asked.column("keys").to_pylist():
            keys = np.frombuffer(keys, np.uint64)
            slot = np.searchsorted(known, keys)
            slot[np.append(known, 0)[slot] != keys] = len(known)
            codes.append(log_shares(vocabulary.bucket(keys), n[slot], words, kinds).astype(np.float32).tobytes())
        return pa.table([*[asked.column(c) for c in ("_batch", "kind", "shard")], pa.array(codes, pa.binary())], names=["_batch", "kind", "shard", "bits"])

    def work(table: pa.Table, answers: dict[int, bytes]) -> pa.Table:
        vocabulary, parameters = shared.value
        parts = list(_hashed_blocks(table.column("_text")))
        encoded = [vocabulary.encode(hashes) for hashes, _ in parts]
        own = [np.flatnonzero(vocabulary.rare(ids)) for ids in encoded]
        keys = np.unique(np.concatenate([np.zeros(0, np.uint64), *[hashes[at] for (hashes, _), at in zip(parts, own)]]))
        shares = np.frombuffer(answers.get(0, b""), np.float32)
        counts, sums = [np.zeros(0, np.int64)], [np.zeros(0)]
        for (hashes, firsts), ids, at in zip(parts, encoded, own):
            around = _around(ids, firsts)
            logs = np.zeros(len(ids) + 1)
            for a in range(0, len(ids), SCORE_STEP):
                logs[a + 1 : a + 1 + SCORE_STEP] = _Pass(parameters, ids[a : a + SCORE_STEP], around[:, a : a + SCORE_STEP]).log
            logs[at + 1] += shares[np.searchsorted(keys, hashes[at])]
            logs = np.cumsum(logs)
            counts.append(np.diff(firsts))
            sums.append(logs[firsts[1:]] - logs[firsts[:-1]])
        fresh = {"n_tokens": pa.array(np.concatenate(counts)), "log_likelihood": pa.array(np.concatenate(sums))}
        return pa.table([fresh[n] if n in fresh else table.column(n) for n in schema.names], names=schema.names)

    counts = rare.counts.select("word", "n", F.shiftright(F.shiftrightunsigned("word", 32) * F.lit(shards).cast("long"), 32).alias("shard"))
    answers = exchange.ask(texts, question).groupBy("shard").cogroup(counts.groupBy("shard")).applyInArrow(reply, exchange.ANSWER)
    done = exchange.finish(texts, answers, work, schema)
    return done.select(*[F.col(f"_keep{i}").alias(name) for i, name in enumerate(kept)], "n_tokens", "log_likelihood")


def pseudo_likelihood(docs: DataFrame) -> DataFrame:
    """Train on all documents, then score all: sum, mean per word, and pseudo-perplexity.

    Mean and perplexity of a text without words are null.
    """
    counts = materialize(count_words(docs), "word-counts")
    vocabulary = frequent_words(counts)
    words = counts.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    scored = score_documents(docs, vocabulary, train(docs, vocabulary, words), rare_words(counts, vocabulary))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return scored.select(
        "doc_id",
        "n_tokens",
        F.round("log_likelihood", 4).alias("log_likelihood"),
        F.round(mean, 6).alias("mean_log_likelihood"),
        F.round(F.exp(-mean), 4).alias("pseudo_perplexity"),
    )
