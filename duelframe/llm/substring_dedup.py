"""Substring dedup: repeated windows of words, found behind a count-min prefilter.

Every window of words has an anchor: the least of the hashes of the shorter shingles in it.
Places of equal windows have equal anchors at equal distance, so the number of places whose
anchor falls into a cell of a count-min sketch is never less than the number of places of
the window. Each batch sketches its own anchors; the sketches are merged cell by cell, in
shards, and the merged counts of its cells go back to the batch. Only windows whose anchor
is counted twice or more in every row of the sketch are then grouped exactly, so no
repeated window is lost, whatever the sketch's size.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.bytewise import BLANK_WORDS, blocks, covered, mix, run_hashes, text_buffer, window_minima, word_hashes, word_spans
from duelframe.llm.exchange import answer, ask, ask_again, by_shard, corpus_bytes, deal, finish, shard_count, shard_of

WINDOW = 50
SHINGLE = 16
# Rows of the sketch, cells of a shard of one row, and cells for each anchor expected.
DEPTH = 2
CELLS = 1 << 22
CELLS_PER_ANCHOR = 8
_SEEDS = np.array([0x6C62272E07BB0142, 0x27D4EB2F165667C5], dtype=np.uint64)
_NO_ID = np.iinfo(np.int64).max
_WINDOWS = DEPTH  # the kind of the questions about windows; sketch rows are kinds 0 and 1


class _Block:
    """Windows of a block of documents and the anchor of each."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data = data
        self.starts, self.ends, self.firsts = word_spans(data, offsets, BLANK_WORDS)
        hashes = word_hashes(data, self.starts, self.ends)
        counts = np.maximum(np.diff(self.firsts) - (WINDOW - 1), 0)
        #: first word and document of every window
        self.owner = np.repeat(np.arange(len(counts)), counts)
        self.window = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts) + self.firsts[:-1][self.owner]
        self.hashes = hashes
        if len(self.window):
            shingles = run_hashes(hashes, SHINGLE)
            # The low bits hold the place, so the least value names its first place.
            bits = np.uint64(max(1, int(len(shingles)).bit_length()))
            low = (np.uint64(1) << bits) - np.uint64(1)
            ranked = (shingles & ~low) | np.arange(len(shingles), dtype=np.uint64)
            anchor = (window_minima(ranked, WINDOW - SHINGLE + 1) & low).astype(np.int64)[self.window]
            self.anchors, self.of_anchor = np.unique(anchor, return_inverse=True)
            self.names = shingles[self.anchors]
        else:
            self.anchors = self.of_anchor = np.zeros(0, np.int64)
            self.names = np.zeros(0, np.uint64)

    def window_keys(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Two independent hashes of the chosen windows."""
        place = self.window[chosen]
        other = word_hashes(self.data, self.starts, self.ends, stream=1)
        return run_hashes(self.hashes, WINDOW)[place], run_hashes(other, WINDOW)[place]


def _blocks(table: pa.Table) -> list[tuple[int, int, _Block]]:
    data, offsets = text_buffer(table.column("_text"))
    return [(a, b, _Block(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) for a, b in blocks(offsets)]


def _ids(table: pa.Table) -> np.ndarray:
    return table.column("_id").combine_chunks().fill_null(_NO_ID).to_numpy(zero_copy_only=False)


def _cells(names: np.ndarray, row: int, shards: int) -> np.ndarray:
    """Shard and cell of every anchor in one row of the sketch, as one number."""
    spread = mix(names ^ _SEEDS[row])
    return (shard_of(spread, shards) << np.uint64(32)) | (spread & np.uint64(CELLS - 1))


def _sketch(table: pa.Table, shards: int) -> list[tuple]:
    """A batch's own sketch: its cells with a count of one, or two for more."""
    names = np.concatenate([block.names for _, _, block in _blocks(table)] or [np.zeros(0, np.uint64)])
    rows = []
    for row in range(DEPTH):
        cells, counts = np.unique(_cells(names, row, shards), return_counts=True)
        extra = np.minimum(counts, 2).astype(np.uint8)
        rows += by_shard(row, (cells >> np.uint64(32)).astype(np.int64), cells.astype(np.uint32), extra)
    return rows


def _merge(kind: int, sketches: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """Merged counts of the cells of each sketch: 1 where they reach two."""
    merged = np.zeros(CELLS, dtype=np.uint8)
    for cells, counts in sketches:
        merged[cells] = np.minimum(merged[cells] + counts, 2)
    return [np.packbits(merged[cells] >= 2) for cells, _ in sketches]


class _Candidates:
    """Windows of a batch that the sketch lets through, sorted by shard and key."""

    def __init__(self, table: pa.Table, known: dict[int, bytes], sketch_shards: int, shards: int):
        self.parts = _blocks(table)
        self.ids = _ids(table)
        passed = self._passed(known, sketch_shards)
        shard, key, owner, self.place = [], [], [], []
        seen = 0
        for (first, _, block), lets in zip(self.parts, passed):
            chosen = np.flatnonzero(lets[block.of_anchor]) if len(block.window) else np.zeros(0, np.int64)
            self.place.append(chosen)
            if len(chosen):
                one, two = block.window_keys(chosen)
                key.append(one)
                shard.append(shard_of(two, shards))
                owner.append(self.ids[first + block.owner[chosen]])
            seen += len(chosen)
        empty = np.zeros(0, np.uint64)
        key, shard = np.concatenate([empty, *key]), np.concatenate([empty, *shard]).astype(np.int64)
        self.owner = np.concatenate([np.zeros(0, np.int64), *owner])
        order = np.lexsort((self.owner, key, shard))
        new = np.ones(len(order), dtype=bool)
        new[1:] = (np.diff(key[order]) != 0) | (np.diff(shard[order]) != 0)
        self.group = np.empty(len(order), dtype=np.int64)
        self.group[order] = np.cumsum(new) - 1
        self.keys, self.shards, self.least = key[order][new], shard[order][new], self.owner[order][new]

    def _passed(self, known: dict[int, bytes], shards: int) -> list[np.ndarray]:
        names = [block.names for _, _, block in self.parts]
        every = np.concatenate([np.zeros(0, np.uint64), *names])
        lets = np.ones(len(every), dtype=bool)
        for row in range(DEPTH):
            cells = _cells(every, row, shards)
            unique = np.unique(cells)
            # Bits come shard by shard, each padded to whole bytes.
            codes = _unpack(known.get(row, b""), (unique >> np.uint64(32)).astype(np.int64))
            lets &= codes[np.searchsorted(unique, cells)]
        return np.split(lets, np.cumsum([len(n) for n in names])[:-1]) if names else []


def _unpack(packed: bytes, shards: np.ndarray) -> np.ndarray:
    """Bits of keys sorted by shard, from the bytes of each shard one after the other."""
    bits = np.unpackbits(np.frombuffer(packed, np.uint8))
    cuts = np.flatnonzero(np.diff(shards)) + 1
    bounds = [0, *cuts.tolist(), len(shards)]
    out, at = np.zeros(len(shards), dtype=bool), 0
    for a, b in zip(bounds[:-1], bounds[1:]):
        out[a:b] = bits[at : at + b - a]
        at += -(-(b - a) // 8) * 8
    return out


def _first_owner(kind: int, parts: list[tuple[np.ndarray, np.ndarray]]) -> list[np.ndarray]:
    """For each key whether a document with a smaller id has it in some batch."""
    keys = np.concatenate([k for k, _ in parts])
    owners = np.concatenate([e.view(np.int64) for _, e in parts])
    order = np.argsort(keys, kind="stable")
    new = np.flatnonzero(np.concatenate([[True], np.diff(keys[order]) != 0]))
    least = np.minimum.reduceat(owners[order], new)
    smaller = np.empty(len(keys), dtype=bool)
    smaller[order] = np.repeat(least, np.diff([*new, len(keys)])) < owners[order]
    return [np.packbits(part) for part in np.split(smaller, np.cumsum([len(k) for k, _ in parts])[:-1])]


_SCHEMA = "doc_id long, n_words long, n_removed long, kept binary"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, ``n_words``, ``n_removed`` and ``kept`` (words joined by one space, bytes).

    A word goes if a window over it also begins in a document with a smaller id. Documents
    that share an id do not remove each other's windows; a null id counts as greater than
    any other. Null and blank texts have no words. Every row gives a row.
    """
    total = corpus_bytes(docs, text_col)
    texts = deal(docs, total, id_col, text_col)
    shards = shard_count(total)
    # About one anchor for 18 words of six bytes.
    sketch_shards = max(1, -(-CELLS_PER_ANCHOR * (total // 108) // CELLS))
    sketched = answer(ask(texts, lambda table: _sketch(table, sketch_shards)), _merge, "<u4")

    def windows(table: pa.Table, known: dict[int, bytes]) -> list[tuple]:
        found = _Candidates(table, known, sketch_shards, shards)
        return by_shard(_WINDOWS, found.shards, found.keys, found.least)

    grouped = answer(ask_again(texts, sketched, windows), _first_owner, "<u8")

    def cut(table: pa.Table, known: dict[int, bytes]) -> pa.Table:
        found = _Candidates(table, known, sketch_shards, shards)
        removed_before = _unpack(known.get(_WINDOWS, b""), found.shards)
        gone = removed_before[found.group] | (found.owner > found.least[found.group])
        counts, removed, kept, at = [], [], [], 0
        for (_, _, block), place in zip(found.parts, found.place):
            flags = gone[at : at + len(place)]
            at += len(place)
            mask = covered(block.window[place[flags]], WINDOW, len(block.starts))
            raw = block.data.tobytes()
            for a, b in zip(block.firsts[:-1].tolist(), block.firsts[1:].tolist()):
                lost = int(mask[a:b].sum())
                counts.append(b - a)
                removed.append(lost)
                if lost == b - a:
                    kept.append(b"")
                elif lost:
                    rest = np.flatnonzero(~mask[a:b]) + a
                    kept.append(b" ".join([raw[s:e] for s, e in zip(block.starts[rest].tolist(), block.ends[rest].tolist())]))
                else:
                    kept.append(b" ".join(raw[block.starts[a] : block.ends[b - 1]].split()))
        return pa.table([table.column("_id"), pa.array(counts, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary())], schema=_ARROW)

    return finish(texts, sketched.unionByName(grouped), cut, _SCHEMA)


def dedup_digest(docs: DataFrame) -> DataFrame:
    """``remove_repeats`` with the hash of the kept words in their place; hard rows as there."""
    return remove_repeats(docs).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
