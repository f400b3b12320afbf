"""Elias-Fano coding of sorted numbers.

The low bits of every number stand packed one after the other; the high bits are a bit string in
which the i-th number sets bit ``high + i``. ``select`` finds that bit again: for every ``STEP``-th
number the word of its bit is noted in 32 bits, and from there whole words are counted. Together
about ``2 + log2(range / count)`` bits a number, and 5 bytes for every ``STEP`` numbers.
"""

from __future__ import annotations

import struct

import numpy as np

STEP = 64
_HEAD = struct.Struct("<QqQQ")
_WORD = np.uint64(64)


def _select_in_words(words: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """Place of the ``nth`` set bit (from 0) of each word."""
    words, nth, place = words.copy(), nth.copy(), np.zeros(len(words), dtype=np.int64)
    for half in (32, 16, 8, 4, 2, 1):
        low = words & np.uint64((1 << half) - 1)
        below = np.bitwise_count(low).astype(np.int64)
        above = nth >= below
        nth -= np.where(above, below, 0)
        place += np.where(above, half, 0)
        words = np.where(above, words >> np.uint64(half), low)
    return place


class EliasFano:
    """Reader of one coded sequence; ``size`` is the bytes it takes in the buffer."""

    def __init__(self, buffer: bytes | memoryview, at: int = 0):
        start = at
        self.count, self.base, self.bits, high_words = _HEAD.unpack_from(buffer, at)
        at += _HEAD.size
        marks = -(-self.count // STEP)
        fields = []
        for kind, length in (("<u8", -(-self.count * self.bits // 64) + 1), ("<u8", high_words), ("<u4", marks), ("<u1", marks)):
            fields.append(np.frombuffer(buffer, kind, length, at))
            at += length * np.dtype(kind).itemsize
        self.low, self.high, self.mark_word, self.mark_rank = fields
        self.size = at - start

    def select(self, index: np.ndarray) -> np.ndarray:
        """The numbers at the places ``index``."""
        index = np.asarray(index, dtype=np.int64)
        mark = index // STEP
        word = self.mark_word[mark].astype(np.int64)
        # Set bits to pass, counted from the beginning of the word.
        rest = index - mark * STEP + self.mark_rank[mark]
        open_ = np.arange(len(index))
        while len(open_):
            inside = np.bitwise_count(self.high[word[open_]]).astype(np.int64)
            open_, inside = open_[rest[open_] >= inside], inside[rest[open_] >= inside]
            rest[open_] -= inside
            word[open_] += 1
        high = word * 64 + _select_in_words(self.high[word], rest) - index
        if not self.bits:
            return high + self.base
        place = index.astype(np.uint64) * np.uint64(self.bits)
        at, shift = (place // _WORD).astype(np.int64), place % _WORD
        low = self.low[at] >> shift
        low |= np.where(shift > 0, self.low[at + 1] << ((_WORD - shift) % _WORD), np.uint64(0))
        low &= np.uint64((1 << self.bits) - 1)
        return ((high.astype(np.uint64) << np.uint64(self.bits)) + low).view(np.int64) + self.base


def encode(values: np.ndarray) -> bytes:
    """Coded form of numbers that do not fall."""
    values = np.asarray(values, dtype=np.int64)
    count = len(values)
    base = int(values[0]) if count else 0
    above = values.view(np.uint64) - np.uint64(base % (1 << 64))  # the difference, also where it passes a signed long
    most = int(above[-1]) if count else 0
    bits = max(0, (most // count).bit_length() - 1) if count else 0
    low = np.zeros(-(-count * bits // 64) + 1, dtype=np.uint64)
    if bits:
        part = above & np.uint64((1 << bits) - 1)
        place = np.arange(count, dtype=np.uint64) * np.uint64(bits)
        at, shift = (place // _WORD).astype(np.int64), place % _WORD
        np.bitwise_or.at(low, at, part << shift)
        over = shift > 0
        np.bitwise_or.at(low, at[over] + 1, part[over] >> (_WORD - shift[over]))
    bit = (above >> np.uint64(bits)).astype(np.int64) + np.arange(count)
    high = np.zeros(int(bit[-1]) // 64 + 1 if count else 0, dtype=np.uint64)
    if len(high) >> 32:
        raise ValueError("too many words for marks of 32 bits")
    np.bitwise_or.at(high, bit // 64, np.uint64(1) << (bit % 64).astype(np.uint64))
    marked = bit[::STEP] // 64
    # Set bits of a marked word before the marked one.
    first_of_word = np.searchsorted(bit, marked * 64)
    rank = np.arange(0, count, STEP) - first_of_word
    head = _HEAD.pack(count, base, bits, len(high))
    return head + low.astype("<u8").tobytes() + high.astype("<u8").tobytes() + marked.astype("<u4").tobytes() + rank.astype("<u1").tobytes()
