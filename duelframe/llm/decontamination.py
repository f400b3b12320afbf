"""Benchmark decontamination: Wu-Manber search for benchmark passages in documents.

A pattern is a window of consecutive words of a benchmark item. The search reads the last
block of words of the window under it. A shift table tells how far the window can move
before a pattern could end there, so most places are never looked at. Where the shift is
zero, the hash of that last block picks a bucket of patterns, and only a direct comparison
of the words decides.

The patterns are a stated query set. They are cut into slices of bounded size; documents
pass through one slice after the other without a shuffle.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.bytewise import LOWER, PLAIN_WORDS, blocks, text_buffer, word_hashes, word_spans
from duelframe.llm.names import unused

WINDOW = 10
# Bytes of benchmark text whose patterns are broadcast together.
SLICE_BYTES = 8 << 20
_TABLE_BITS = 20
_BLOCK_FACTOR = np.uint64(0x9FB21C651E98DF25)
# Consecutive window ends searched by one lane; all lanes of a block advance together.
_LANE = 512


def plain_words(text: str | None) -> list[bytes]:
    """Lower-cased words of a text as the search sees them."""
    data = LOWER[np.frombuffer((text or "").encode(), np.uint8)]
    if not len(data):
        return []
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), PLAIN_WORDS)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(starts, ends)]


class PatternGroup:
    """Wu-Manber tables for patterns of one length, in words."""

    def __init__(self, length: int, patterns: dict[bytes, set[str]]):
        self.length = length
        self.block = min(2, length)
        self.shift = np.full(1 << _TABLE_BITS, length - self.block + 1, dtype=np.int64)
        buckets: dict[int, dict[bytes, tuple[str, ...]]] = defaultdict(dict)
        for pattern, items in patterns.items():
            data = np.frombuffer(pattern, np.uint8)
            starts, ends, _ = word_spans(data, np.array([0, len(data)]), PLAIN_WORDS)
            cells = self.cells(word_hashes(data, starts, ends), np.arange(self.block - 1, length))
            np.minimum.at(self.shift, cells, np.arange(length - self.block, -1, -1))
            buckets[int(cells[-1])][pattern] = tuple(items)
        self.buckets = dict(buckets)

    def cells(self, hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Table cell of the block of words ending at each of ``ends``."""
        value = hashes[ends]
        if self.block == 2:
            value = (value + hashes[ends - 1] * _BLOCK_FACTOR) * _BLOCK_FACTOR
        return (value >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def search(self, hashes: np.ndarray, firsts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window ends whose last block ends some pattern, and their cells."""
        low, high = firsts[:-1] + self.length - 1, firsts[1:]
        kept = low < high
        low, high = low[kept], high[kept]
        lanes = -(-(high - low) // _LANE)
        if not lanes.sum():
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        order = np.arange(lanes.sum()) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        place = np.repeat(low, lanes) + order * _LANE
        stop = np.minimum(place + _LANE, np.repeat(high, lanes))
        found, cells = [], []
        while len(place):
            cell = self.cells(hashes, place)
            shift = self.shift[cell]
            zero = shift == 0
            if zero.any():
                found.append(place[zero])
                cells.append(cell[zero])
            place = place + np.maximum(shift, 1)
            going = place < stop
            place, stop = place[going], stop[going]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        found, cells = np.concatenate(found), np.concatenate(cells)
        order = np.argsort(found)
        return found[order], cells[order]


def compile_patterns(items: list[tuple[str, str | None]], window: int = WINDOW) -> list[PatternGroup]:
    """Tables for every window of ``window`` words of the items; a shorter item is one window."""
    by_length: dict[int, dict[bytes, set[str]]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = plain_words(text)
        if words:
            size = min(window, len(words))
            for i in range(len(words) - size + 1):
                by_length[size][b" ".join(words[i : i + size])].add(item)
    return [PatternGroup(size, patterns) for size, patterns in sorted(by_length.items())]


def _search_batch(text: pa.Array, groups: list[PatternGroup]) -> tuple[list[int], list[list], list[list]]:
    """Per document: number of words, occurrences as (first word, words), items found."""
    counts, occurrences, items = [], [], []
    data, offsets = text_buffer(text)
    for first, last in blocks(offsets):
        part = LOWER[data[offsets[first] : offsets[last]]]
        starts, ends, firsts = word_spans(part, offsets[first : last + 1] - offsets[first], PLAIN_WORDS)
        counts += np.diff(firsts).tolist()
        hashes = word_hashes(part, starts, ends)
        spans = defaultdict(list)
        names = defaultdict(set)
        raw = part.tobytes()
        for group in groups:
            found, cells = group.search(hashes, firsts)
            owners = np.searchsorted(firsts, found, side="right") - 1
            for end, cell, owner in zip(found.tolist(), cells.tolist(), owners.tolist()):
                begin = end - group.length + 1
                words = b" ".join([raw[starts[k] : ends[k]] for k in range(begin, end + 1)])
                hit = group.buckets.get(cell, {}).get(words)
                if hit is not None:
                    spans[owner].append((begin - int(firsts[owner]), group.length))
                    names[owner].update(hit)
        for owner in range(last - first):
            occurrences.append(sorted(spans.get(owner, ())))
            items.append(sorted(names.get(owner, ())))
    return counts, occurrences, items


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("words", pa.int64())]))


def find_occurrences(
    docs: DataFrame,
    benchmark: DataFrame,
    keep: tuple[str, ...] = ("doc_id",),
    text_col: str = "text",
    window: int = WINDOW,
    slice_bytes: int = SLICE_BYTES,
    out: tuple[str, str, str] = ("n_words", "occurrences", "items"),
) -> DataFrame:
    """``keep`` columns of ``docs`` with ``n_words``, ``occurrences`` and ``items``, named by ``out``.

    ``occurrences`` lists ``(start, words)`` of every place where a benchmark window
    occurs, in words from 0; ``items`` the item ids found, as sorted strings. A null or
    blank text has no words. Benchmark rows without an id or without words give no
    pattern; repeated items count once; with no pattern at all nothing occurs. Repeated
    documents each get their row. Columns beyond ``keep`` are not looked at.
    """
    named = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").alias("text"))
    named = named.filter("item_id IS NOT NULL AND text IS NOT NULL")
    size = named.agg(F.coalesce(F.sum(F.octet_length("text") + 64), F.lit(0))).first()[0]
    slices = max(1, -(-size // slice_bytes))
    kept = list(dict.fromkeys(keep))
    state = docs.select(
        *[F.col(name).alias(f"_keep{i}") for i, name in enumerate(kept)],
        F.col(text_col).cast("string").alias("_text"),
        F.lit(0).cast("long").alias("n_words"),
        F.expr("CAST(array() AS array<struct<start: bigint, words: bigint>>)").alias("occurrences"),
        F.expr("CAST(array() AS array<string>)").alias("items"),
    )
    schema = state.schema
    for number in range(slices):
        rows = named.filter(F.pmod(F.xxhash64("item_id"), F.lit(slices)) == number).collect()
        groups = compile_patterns([(row[0], row[1]) for row in rows], window)
        shared = docs.sparkSession.sparkContext.broadcast(groups)

        def search(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                counts, spans, items = _search_batch(batch.column("_text"), shared.value)
                if slices > 1:
                    spans = [sorted(a + [(x["start"], x["words"]) for x in b]) for a, b in zip(spans, batch.column("occurrences").to_pylist())]
                    items = [sorted({*a, *b}) for a, b in zip(items, batch.column("items").to_pylist())]
                spans = pa.array([[{"start": s, "words": w} for s, w in row] for row in spans], _SPAN)
                fresh = {"n_words": pa.array(counts, pa.int64()), "occurrences": spans, "items": pa.array(items, pa.list_(pa.string()))}
                yield pa.RecordBatch.from_arrays([fresh.get(name, batch.column(i)) for i, name in enumerate(batch.schema.names)], names=batch.schema.names)

        state = state.mapInArrow(search, schema)
    results = [F.col(name).alias(own) for name, own in zip(("n_words", "occurrences", "items"), out)]
    return state.select(*[F.col(f"_keep{i}").alias(name) for i, name in enumerate(kept)], *results)


def contamination(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """Digest per document: ``n_words``, ``n_hit``, ``n_items``, ``items_sha256``, ``contaminated``.

    Null and blank texts have no words and are never contaminated; items without an id or without words match
    nothing. Every row gives a row. The benchmark goes out in slices, but an item longer than a
    slice is not divided.
    """
    found = find_occurrences(docs, benchmark, **options)
    # Occurrences are sorted by start: each adds the words beyond the furthest end so far.
    hit = F.aggregate(
        "occurrences",
        F.struct(F.lit(0).cast("long").alias("end"), F.lit(0).cast("long").alias("n")),
        lambda acc, x: F.struct(
            F.greatest(acc["end"], x["start"] + x["words"]).alias("end"),
            (acc["n"] + F.greatest(F.lit(0), x["start"] + x["words"] - F.greatest(acc["end"], x["start"]))).alias("n"),
        ),
        lambda acc: acc["n"],
    )
    return found.select(
        "doc_id",
        "n_words",
        hit.alias("n_hit"),
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.size("items") > 0).alias("contaminated"),
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, **options: object) -> DataFrame:
    """The documents in which no benchmark window occurs, all columns kept."""
    names = docs.columns
    out = tuple(unused(docs, name) for name in ("n_words", "occurrences", "items"))
    found = find_occurrences(docs, benchmark, keep=tuple(names), out=out, **options)
    return found.filter(F.size(out[2]) == 0).select(*names)
