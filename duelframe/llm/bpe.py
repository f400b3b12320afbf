"""Byte-level BPE encoding and decoding as a monoid on byte strings.

The encoding of a piece is a tree reduction: the piece is halved down to short leaves,
and two encoded neighbours are joined. Joining re-encodes a window of tokens around the
seam and widens it until the tokens outside are proven to stay: an encoding is right
exactly if every two neighbouring tokens re-encode to themselves, so it is enough that the
pair on each edge of the window does. Decoding concatenates token bytes up the tree.

Pieces are the matches of a split pattern and are encoded separately, so above the piece
the join is plain concatenation.
"""

from __future__ import annotations

import base64
import re
import struct
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of a piece that are encoded without halving.
LEAF_BYTES = 4
# Entries of each of a worker's tables before they start anew; only a memory bound.
MEMO_ENTRIES = 200_000
_MEMO_CHARS = 48
# A space after another white space: text is then split by the pattern alone.
_DOUBLE_SPACE = re.compile(r"\s ")


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ranks of a rank file (one base64 token and its rank a line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class BytePairMonoid:
    """Encodes byte strings by merge ranks; ``join`` is associative and has ``()`` as unit."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {rank: token for token, rank in ranks.items()}
        self.leaves: dict[bytes, tuple[int, ...]] = {}
        self.stable: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> tuple[int, ...]:
        """The definition: merge the neighbouring pair of lowest rank, leftmost first, until none is left."""
        known = self.leaves.get(data)
        if known is not None:
            return known
        ranks, parts = self.ranks, [data[i : i + 1] for i in range(len(data))]
        while len(parts) > 1:
            best = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
            pair = parts[best] + parts[best + 1]
            if pair not in ranks:
                break
            parts[best : best + 2] = [pair]
        found = tuple([ranks[part] for part in parts])
        if len(self.leaves) >= MEMO_ENTRIES:
            self.leaves.clear()
        self.leaves[data] = found
        return found

    def stays(self, left: int, right: int) -> bool:
        """Whether two neighbouring tokens re-encode to themselves."""
        known = self.stable.get((left, right))
        if known is None:
            known = self.merged(self.token[left] + self.token[right]) == (left, right)
            if len(self.stable) >= MEMO_ENTRIES:
                self.stable.clear()
            self.stable[left, right] = known
        return known

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """Encoding of two encoded neighbours put together."""
        if not left or not right:
            return left or right
        if self.stays(left[-1], right[0]):
            return left + right
        width = 1
        while True:
            a, b = left[-width:], right[:width]
            rest_left, rest_right = left[: len(left) - len(a)], right[len(b) :]
            middle = self.merged(self.decode(a + b))
            if (not rest_left or self.stays(rest_left[-1], middle[0])) and (not rest_right or self.stays(middle[-1], rest_right[0])):
                return rest_left + middle + rest_right
            width *= 2

    def encode(self, data: bytes) -> tuple[int, ...]:
        if data in self.ranks:
            return (self.ranks[data],)
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self._node(data[:half]), self._node(data[half:]))

    def _node(self, data: bytes) -> tuple[int, ...]:
        """Like ``encode``, without the rule that a piece that is a token is that token."""
        if len(data) <= LEAF_BYTES:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self._node(data[:half]), self._node(data[half:]))

    def decode(self, ids: tuple[int, ...] | list[int]) -> bytes:
        """Bytes of a token sequence, concatenated up the tree."""
        if len(ids) <= 4096:
            return b"".join([self.token[i] for i in ids])
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])


class TextEncoder:
    """Splits texts by a pattern and encodes each match, remembering frequent stretches."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.monoid = BytePairMonoid(ranks)
        self.pieces = regex.compile(pattern)
        self.memo: dict[str, bytes] = {}

    def _packed(self, text: str) -> bytes:
        ids: list[int] = []
        for piece in self.pieces.findall(text):
            ids += self.monoid.encode(piece.encode())
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Token ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        if _DOUBLE_SPACE.search(text):
            return self._packed(text)
        # A single space between other characters always begins a piece, so stretches from
        # one space to the next encode on their own.
        head, *rest = text.split(" ")
        parts, memo = [self._packed(head)], self.memo
        for stretch in rest:
            packed = memo.get(stretch)
            if packed is None:
                packed = self._packed(" " + stretch)
                if len(stretch) <= _MEMO_CHARS:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    memo[stretch] = packed
            parts.append(packed)
        return b"".join(parts)

    def decode(self, packed: bytes) -> bytes:
        return self.monoid.decode(memoryview(packed).cast("I").tolist())


_encoders: dict[tuple[int, str], TextEncoder] = {}


def _encoder(key: int, ranks: dict[bytes, int], pattern: str) -> TextEncoder:
    """One encoder a worker process, so that its tables serve later tasks."""
    if (key, pattern) not in _encoders:
        _encoders.clear()
        _encoders[key, pattern] = TextEncoder(ranks, pattern)
    return _encoders[key, pattern]


def encode(docs: DataFrame, ranks_path: str, pattern: str, keep: tuple[str, ...] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """``keep`` columns with ``ids`` (packed as little-endian unsigned 32-bit) and ``decoded`` bytes.

    A null text is encoded like an empty one, to no token. Repeated documents each get
    their row, and no other column is looked at. Special tokens in a text are ordinary
    text. The rank file is read on the driver, so only there its path must exist.
    """
    ranks = read_ranks(ranks_path)
    if any(bytes([i]) not in ranks for i in range(256)):
        raise ValueError("the rank file lacks single bytes, so not every text can be encoded")
    shared = docs.sparkSession.sparkContext.broadcast(ranks)
    key = hash((ranks_path, len(ranks), shared._jbroadcast.id() if shared._jbroadcast is not None else 0))
    kept = list(dict.fromkeys(keep))
    source = docs.select(*[F.col(name).alias(f"_keep{i}") for i, name in enumerate(kept)], F.col(text_col).cast("string").alias("_text"))
    schema = source.drop("_text").withColumn("ids", F.lit(None).cast("binary")).withColumn("decoded", F.lit(None).cast("binary")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, shared.value, pattern)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # bounds the texts held as Python objects
                part = batch.slice(first, 256)
                ids = [encoder.encode(text) for text in part.column("_text").to_pylist()]
                fresh = {"ids": pa.array(ids, pa.binary()), "decoded": pa.array([encoder.decode(x) for x in ids], pa.binary())}
                yield pa.RecordBatch.from_arrays([fresh[name] if name in fresh else part.column(name) for name in schema.names], names=schema.names)

    done = source.mapInArrow(run, schema)
    return done.select(*[F.col(f"_keep{i}").alias(name) for i, name in enumerate(kept)], "ids", "decoded")


def token_digest(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Per document: ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.

    Null and empty texts have no tokens and the hashes of no bytes. Every row gives a row.
    """
    encoded = encode(docs, ranks_path, pattern)
    return encoded.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
