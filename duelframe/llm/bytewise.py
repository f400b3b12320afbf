"""Words, runs of words and their hashes, computed on Arrow buffers with numpy.

A column of texts arrives as one byte buffer with offsets. Work goes over it in blocks of
whole documents (``blocks``), so memory follows the block and not the batch. All word
classes of this package break at ASCII separators, so they can be read off UTF-8 bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text handled at a time; a longer document is a block of its own.
BLOCK_BYTES = 1 << 20

_random = np.random.default_rng(20240607)
_VALUES = _random.integers(1, 1 << 63, size=(2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BASES = (0x9E3779B97F4A7C15, 0xD1B54A32D192ED03)
_M1, _M2 = np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53)
_LEFT = np.uint64(0xA0761D6478BD642F)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _class_table(separators: list[int]) -> np.ndarray:
    table = np.ones(256, dtype=bool)
    table[separators] = False
    return table


#: ``[^\x20\x09-\x0D]+``
BLANK_WORDS = _class_table([0x20, *range(0x09, 0x0E)])
#: ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing A-Z
PLAIN_WORDS = _class_table([*range(0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)])
#: lower-cases A-Z, leaves every other byte
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32


def text_buffer(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and ``n + 1`` offsets of a string or binary column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def blocks(offsets: np.ndarray, size: int = BLOCK_BYTES) -> Iterator[tuple[int, int]]:
    """Ranges of documents of about ``size`` bytes together."""
    first, count = 0, len(offsets) - 1
    while first < count:
        last = int(np.searchsorted(offsets, offsets[first] + size, side="right")) - 1
        last = min(max(last, first + 1), count)
        yield first, last
        first = last


def word_spans(data: np.ndarray, offsets: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of every word, and the index of each document's first word (``n + 1``)."""
    inside = words[data]
    starts, ends = inside.copy(), inside.copy()
    starts[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[1:-1]
    cuts = cuts[(cuts > 0) & (cuts < len(data))]
    starts[cuts] = inside[cuts]
    ends[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(starts), np.flatnonzero(ends) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def mix(x: np.ndarray) -> np.ndarray:
    """Spread the bits of a fresh unsigned array, in place."""
    x ^= x >> np.uint64(32)
    x *= _M1
    x ^= x >> np.uint64(29)
    x *= _M2
    x ^= x >> np.uint64(32)
    return x


def _power_tables(stream: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    if stream not in _powers or len(_powers[stream][0]) < length:
        size = max(length, BLOCK_BYTES + 1)
        base = _BASES[stream]
        tables = []
        for factor in (base, pow(base, -1, 1 << 64)):
            table = np.full(size, factor, dtype=np.uint64)
            table[0] = 1
            tables.append(np.multiply.accumulate(table))
        if size > 4 * BLOCK_BYTES:
            return tables[0], tables[1]  # not kept
        _powers[stream] = (tables[0], tables[1])
    return _powers[stream]


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, stream: int = 0) -> np.ndarray:
    """A 64-bit hash of each word's bytes; the two streams are independent."""
    out = np.empty(len(starts), dtype=np.uint64)
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + BLOCK_BYTES, side="right")))
        low, high = int(starts[i]), int(ends[j - 1])
        power, inverse = _power_tables(stream, high - low + 1)
        sums = np.zeros(high - low + 1, dtype=np.uint64)
        np.cumsum(_VALUES[stream][data[low:high]] * power[: high - low], out=sums[1:])
        s, e = starts[i:j] - low, ends[i:j] - low
        out[i:j] = mix((sums[e] - sums[s]) * inverse[s])
        i = j
    return out


def rolling_hashes(data: np.ndarray, length: int, stream: int = 0) -> np.ndarray:
    """A 64-bit hash of every ``length`` consecutive bytes, from one running sum."""
    n = len(data) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    power, inverse = _power_tables(stream, len(data) + 1)
    sums = np.zeros(len(data) + 1, dtype=np.uint64)
    np.cumsum(_VALUES[stream][data] * power[: len(data)], out=sums[1:])
    return mix((sums[length:] - sums[:-length]) * inverse[:n])


def join_hashes(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Identifier of two neighbouring stretches from the identifiers of each."""
    return mix(left * _LEFT + right)


def run_hashes(values: np.ndarray, length: int) -> np.ndarray:
    """Identifier of every stretch of ``length`` consecutive values.

    Stretches of 1, 2, 4, ... values are named from the names of their two halves, and
    ``length`` is put together from those sizes, so each level reuses the one before.
    """
    n = len(values) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    level, size, done, result = values, 1, 0, None
    while True:
        if length & size:
            part = level[done : done + n]
            result = part.copy() if result is None else join_hashes(result, part)
            done += size
        if size * 2 > length:
            return result
        level = join_hashes(level[:-size], level[size:])
        size *= 2


def window_minima(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, in linear time."""
    n = len(values) - width + 1
    if n <= 0:
        return values[:0]
    if width == 1:
        return values.copy()
    padded = np.full(-(-len(values) // width) * width, np.iinfo(values.dtype).max, dtype=values.dtype)
    padded[: len(values)] = values
    grid = padded.reshape(-1, width)
    forward = np.minimum.accumulate(grid, axis=1).ravel()
    backward = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(backward[:n], forward[width - 1 : width - 1 + n])


def covered(starts: np.ndarray, length: int, size: int) -> np.ndarray:
    """Boolean mask of the places inside any stretch of ``length`` beginning at ``starts``."""
    change = np.zeros(size + 1, dtype=np.int32)
    np.add.at(change, starts, 1)
    np.add.at(change, np.minimum(starts + length, size), -1)
    return np.cumsum(change[:-1]) > 0
