"""Questions about keys that all documents share, asked batch by batch and answered by shard.

Documents are dealt into batches by hash. A batch asks about its keys, each once however
often it holds it, packed per shard. A shard sees at most one entry of a key from each
batch, so a key that a third of all documents hold weighs no more than the number of
batches. Answers go back to the batch in the order of its sorted keys, so neither keys nor
positions have to travel again.

The texts are shuffled once: every pass over the batches has the same exchange below it,
which Spark plans once and reuses. Nothing depends on file splits or on the order of rows,
so a lost executor's part can be computed again anywhere.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Bytes of text in a batch; on large executors a larger batch asks fewer questions.
BATCH_BYTES = 4 << 20
# Bytes of text for each shard.
SHARD_BYTES = 16 << 20

QUESTION = "_batch long, kind int, shard long, keys binary, extra binary"
ANSWER = "_batch long, kind int, shard long, bits binary"
_QUESTION_ARROW = pa.schema(
    [("_batch", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("keys", pa.binary()), ("extra", pa.binary())]
)
_ANSWER_ARROW = pa.schema([("_batch", pa.int64()), ("kind", pa.int32()), ("shard", pa.int64()), ("bits", pa.binary())])

Row = tuple[int, int, bytes, bytes]


def corpus_bytes(docs: DataFrame, text_col: str = "text") -> int:
    return docs.agg(F.coalesce(F.sum(F.octet_length(F.col(text_col).cast("string"))), F.lit(0))).first()[0]


def deal(docs: DataFrame, total: int, id_col: str = "doc_id", text_col: str = "text", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """``_batch``, ``_id`` and ``_text`` (bytes, never null) of every row."""
    count = max(1, -(-total // batch_bytes))
    text = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    return docs.select(
        F.pmod(F.xxhash64(F.col(id_col), F.col(text_col)), F.lit(count)).alias("_batch"),
        F.col(id_col).cast("long").alias("_id"),
        text.alias("_text"),
    )


def shard_count(total: int, shard_bytes: int = SHARD_BYTES) -> int:
    return max(1, -(-total // shard_bytes))


def shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    return ((hashes >> np.uint64(32)) * np.uint64(shards)) >> np.uint64(32)


def ask(texts: DataFrame, question: Callable[[pa.Table], list[Row]]) -> DataFrame:
    """First questions: ``question`` sees a batch and gives ``(kind, shard, keys, extra)``."""

    def run(table: pa.Table) -> pa.Table:
        return _questions(table.column("_batch")[0].as_py(), question(table))

    return texts.groupBy("_batch").applyInArrow(run, QUESTION)


def ask_again(texts: DataFrame, answers: DataFrame, question: Callable[[pa.Table, dict], list[Row]]) -> DataFrame:
    """Questions of a batch that has answers already."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        if not table.num_rows:
            return _QUESTION_ARROW.empty_table()
        return _questions(table.column("_batch")[0].as_py(), question(table, received(known)))

    return texts.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(run, QUESTION)


def answer(questions: DataFrame, reply: Callable[[int, list[tuple[np.ndarray, np.ndarray]]], list[np.ndarray]], key_type: str) -> DataFrame:
    """Answers of all shards: ``reply`` gets ``(keys, extra bytes)`` of every batch and gives codes.

    Codes are small numbers, one for each key. Batches come in order of their numbers: an
    answer may be computed more than once and must then be the same, however rows arrive.
    """

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("_batch")
        kind = table.column("kind")[0].as_py()
        keys = [np.frombuffer(k, key_type) for k in table.column("keys").to_pylist()]
        extra = [np.frombuffer(e, np.uint8) for e in table.column("extra").to_pylist()]
        bits = [np.ascontiguousarray(codes, dtype=np.uint8).tobytes() for codes in reply(kind, list(zip(keys, extra)))]
        return pa.table(
            [table.column("_batch"), table.column("kind"), table.column("shard"), pa.array(bits, pa.binary())], schema=_ANSWER_ARROW
        )

    return questions.groupBy("kind", "shard").applyInArrow(run, ANSWER)


def finish(texts: DataFrame, answers: DataFrame, work: Callable[[pa.Table, dict], pa.Table], schema: str) -> DataFrame:
    """Last pass: every batch with all its answers."""

    def run(table: pa.Table, known: pa.Table) -> pa.Table:
        return work(table, received(known))

    return texts.groupBy("_batch").cogroup(answers.groupBy("_batch")).applyInArrow(run, schema)


def _questions(batch: int, rows: list[Row]) -> pa.Table:
    columns = list(zip(*rows)) if rows else [(), (), (), ()]
    return pa.table([pa.array([batch] * len(rows), pa.int64()), *[pa.array(c, f.type) for c, f in zip(columns, list(_QUESTION_ARROW)[1:])]], schema=_QUESTION_ARROW)


def received(table: pa.Table) -> dict[int, bytes]:
    """Codes of a batch by kind, shard after shard."""
    rows = sorted(zip(table.column("kind").to_pylist(), table.column("shard").to_pylist(), table.column("bits").to_pylist()))
    found: dict[int, list[bytes]] = {}
    for kind, _, bits in rows:
        found.setdefault(kind, []).append(bits)
    return {kind: b"".join(parts) for kind, parts in found.items()}


def by_shard(kind: int, shards: np.ndarray, keys: np.ndarray, extra: np.ndarray) -> list[Row]:
    """Rows of keys that are sorted by shard already."""
    cuts = np.flatnonzero(np.diff(shards)) + 1
    bounds = [0, *cuts.tolist(), len(shards)]
    return [
        (kind, int(shards[a]), keys[a:b].tobytes(), np.ascontiguousarray(extra[a:b]).tobytes())
        for a, b in zip(bounds[:-1], bounds[1:])
        if b > a
    ]
