"""Token ids of whole texts from a library tokenizer, each distinct chunk of text encoded once.

The byte-level tokenizer cuts a text with a pattern before it merges bytes: runs of letters, of digits
and of other signs, with at most one space before, runs of white space, and contractions. A chunk
begins where one of its matches must begin and none can go on: at a space or line feed
behind text, and where ASCII letters, digits and signs change, but for a letter behind an apostrophe,
which could be a contraction. Where the character before could itself be white space to some
definition, or is not ASCII, the text is not cut. So chunks encode alone as they do in their text.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from duelframe.llm.bytewise import blocks, text_buffer, word_hashes

#: Chunks remembered by a worker; beyond it, those that came only once go.
REMEMBERED = 1 << 19
#: Bytes of text handled at a time.
BLOCK_BYTES = 2 << 20

_SPACE, _LETTER, _DIGIT, _SIGN = 1, 2, 3, 4


def _byte_classes() -> np.ndarray:
    table = np.zeros(256, dtype=np.uint8)
    table[0x21:0x7F] = _SIGN
    table[[0x20, 0x0A]] = _SPACE
    table[0x30:0x3A] = _DIGIT
    table[0x41:0x5B] = table[0x61:0x7B] = _LETTER
    return table


_CLASSES = _byte_classes()


def chunk_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where chunks begin, the beginnings of documents that hold bytes included."""
    kind = _CLASSES[data]
    begins = np.zeros(len(data), dtype=bool)
    own, before = kind[1:], kind[:-1]
    text = before > _SPACE
    # Two-byte characters from U+00C0 on are no white space.
    text[1:] |= (data[1:-1] >= 0x80) & (data[1:-1] < 0xC0) & (data[:-2] >= 0xC3) & (data[:-2] < 0xE0)
    begins[1:] = (own == _SPACE) & text
    changes = (own > _SPACE) & (before > _SPACE) & (own != before)
    changes &= ~((own == _LETTER) & (data[:-1] == 0x27))
    begins[1:] |= changes
    firsts = offsets[:-1]
    begins[firsts[firsts < offsets[1:]]] = True
    return np.flatnonzero(begins)


class ChunkEncoder:
    """Ids of texts by a tokenizer of the ``tokenizers`` library, given as the JSON it is stored in.

    Ids of chunks are kept in arrays sorted by the 64-bit hashes of the chunks.
    """

    def __init__(self, tokenizer_json: str):
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        # Strings of special tokens in a document are ordinary text.
        self.tokenizer.encode_special_tokens = True
        self.names, self.used = np.zeros(0, np.uint64), np.zeros(0, bool)
        self.begins, self.sizes, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    def _forget(self) -> None:
        """Keep the chunks that came again since the last time."""
        kept = self.used
        sizes = self.sizes[kept]
        source = np.arange(sizes.sum()) + np.repeat(self.begins[kept] - (np.cumsum(sizes) - sizes), sizes)
        self.names, self.ids, self.sizes, self.begins = self.names[kept], self.ids[source], sizes, np.cumsum(sizes) - sizes
        self.used = np.zeros(len(sizes), bool)

    def _learn(self, names: np.ndarray, texts: list[str]) -> None:
        """Encode chunks, some hundred as the words of one input."""
        step = 512
        found = self.tokenizer.encode_batch([texts[i : i + step] for i in range(0, len(texts), step)], is_pretokenized=True, add_special_tokens=False)
        ids = np.concatenate([np.array(f.ids, np.uint32) for f in found])
        word = np.concatenate([np.array(f.word_ids, np.int64) + step * i for i, f in enumerate(found)])
        sizes = np.bincount(word, minlength=len(texts))
        place = np.searchsorted(self.names, names)
        self.begins = np.insert(self.begins, place, len(self.ids) + np.cumsum(sizes) - sizes)
        self.sizes = np.insert(self.sizes, place, sizes)
        self.names = np.insert(self.names, place, names)
        self.used = np.insert(self.used, place, False)
        self.ids = np.concatenate([self.ids, ids])

    def encode(self, column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """For one block of documents after the other: all their ids, and the number of each document; null counts as empty."""
        data, offsets = text_buffer(column)
        for first, last in blocks(offsets, BLOCK_BYTES):
            yield self._block(data[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first])

    def _block(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts = chunk_starts(data, offsets)
        if not len(starts):
            return np.zeros(0, np.uint32), np.zeros(len(offsets) - 1, np.int64)
        ends = np.append(starts[1:], len(data))
        names, first, kind = np.unique(word_hashes(data, starts, ends), return_index=True, return_inverse=True)
        if len(self.names) > REMEMBERED:
            self._forget()
        place = np.searchsorted(self.names, names)
        known = place < len(self.names)
        known[known] = self.names[place[known]] == names[known]
        self.used[place[known]] = True
        if not known.all():
            raw = data.tobytes()
            at = first[~known]
            self._learn(names[~known], [raw[a:b].decode("utf-8", "replace") for a, b in zip(starts[at].tolist(), ends[at].tolist())])
            place = np.searchsorted(self.names, names)
        chunk = place[kind]
        lengths = self.sizes[chunk]
        until = np.cumsum(lengths)
        source = np.repeat(self.begins[chunk] - (until - lengths), lengths)
        source += np.arange(len(source))
        bounds = np.concatenate([[0], until])[np.searchsorted(starts, offsets)]
        return self.ids[source], np.diff(bounds)


_encoders: dict[str, ChunkEncoder] = {}


def encoder_of(tokenizer_json: str) -> ChunkEncoder:
    """The encoder of this worker process, which keeps what earlier tasks learned."""
    if tokenizer_json not in _encoders:
        _encoders.clear()
        _encoders[tokenizer_json] = ChunkEncoder(tokenizer_json)
    return _encoders[tokenizer_json]
