"""Token ids of documents as binary files, in the order of their ids, written and read through Spark.

A file holds, one after the other:

- the head: ``IDS1``, bytes of an id (2 or 4), documents, documents without an id, token ids;
- the documents' ids, Elias-Fano coded, those without an id first and left out;
- where each document ends in the id array, Elias-Fano coded, with marks for ``select``;
- the array of all token ids, little-endian.

``index`` names the files in order, with the number of documents and token ids before each, coded alike. It
is written last, in one step: files that a lost or repeated task left behind are not in it.

``TokenFiles`` is a data source: ``write`` sorts documents by range, so every task writes the files of
one stretch of ids, and holds one file in memory. Reading gives a task to each file; its ids are
read in pieces through the selected boundaries.
"""

from __future__ import annotations

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from duelframe.llm import elias_fano
from duelframe.llm.chunked_tokens import encoder_of
from duelframe.llm.exchange import corpus_bytes

FORMAT = "token_files"
_MAGIC = b"IDS1"
_HEAD = struct.Struct("<4sIQQQ")
#: Token ids of a file at most, but for a single longer document.
FILE_IDS = 16 << 20
#: Bytes of text for each writing task.
TASK_BYTES = 32 << 20
#: Token ids read at a time.
PIECE_IDS = 1 << 20
_SCHEMA = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def file_head(doc_ids: list[int], without_id: int, ends: np.ndarray, id_bytes: int) -> bytes:
    """All that stands before the id array."""
    head = _HEAD.pack(_MAGIC, id_bytes, len(ends), without_id, int(ends[-1]) if len(ends) else 0)
    return head + elias_fano.encode(np.array(doc_ids, np.int64)) + elias_fano.encode(ends)


class TokenFile:
    """Random access to the documents of one file; only head and boundaries are held."""

    def __init__(self, system: fs.FileSystem, path: str):
        self.file = system.open_input_file(path)
        magic, self.id_bytes, self.documents, self.without_id, self.ids = _HEAD.unpack(self.file.read_at(_HEAD.size, 0))
        self.begin = self.file.size() - self.ids * self.id_bytes
        if magic != _MAGIC or self.begin < _HEAD.size:
            raise ValueError(f"{path} is no token file")
        index = self.file.read_at(self.begin - _HEAD.size, _HEAD.size)
        self.names = elias_fano.EliasFano(index)
        self.ends = elias_fano.EliasFano(index, self.names.size)

    def bounds(self, documents: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where documents begin and end in the id array, by their place in the file."""
        ends = self.ends.select(documents)
        starts = np.zeros(len(documents), dtype=np.int64)
        later = documents > 0
        starts[later] = self.ends.select(documents[later] - 1)
        return starts, ends

    def doc_ids(self, documents: np.ndarray) -> pa.Array:
        null = documents < self.without_id
        out = np.zeros(len(documents), dtype=np.int64)
        out[~null] = self.names.select(documents[~null] - self.without_id)
        return pa.array(out, mask=null)

    def token_ids(self, start: int, end: int) -> np.ndarray:
        raw = self.file.read_at((end - start) * self.id_bytes, self.begin + start * self.id_bytes)
        return np.frombuffer(raw, f"<u{self.id_bytes}")

    def batches(self, before: int) -> Iterator[pa.RecordBatch]:
        """All documents, about ``PIECE_IDS`` token ids at a time; ``before`` token ids stand in earlier files."""
        first = 0
        while first < self.documents:
            count = min(1 << 16, self.documents - first)
            starts, ends = self.bounds(np.arange(first, first + count))
            count = max(1, int(np.searchsorted(ends, starts[0] + PIECE_IDS, side="right")))
            starts, ends = starts[:count], ends[:count]
            ids = self.token_ids(int(starts[0]), int(ends[-1])).astype("<u4").tobytes()
            offsets = np.append(starts, ends[-1]) - starts[0]
            raw = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets * 4), pa.py_buffer(ids)]).cast(pa.binary())
            columns = [self.doc_ids(np.arange(first, first + len(starts))), pa.array(starts + before), pa.array(ends - starts), raw]
            yield pa.RecordBatch.from_arrays(columns, schema=_SCHEMA)
            first += len(starts)


@dataclass
class Written(WriterCommitMessage):
    files: list[tuple[int, int, str, int, int]]  # task, number, name, documents, token ids


@dataclass
class FilePart(InputPartition):
    name: str
    before: int


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, id_bytes: int, file_ids: int):
        self.path, self.id_bytes, self.file_ids = path, id_bytes, file_ids

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        files: list[tuple[int, int, str, int, int]] = []
        doc_ids: list[int | None] = []
        ends: list[int] = []
        held = bytearray()

        def close() -> None:
            name = f"part-{context.partitionId():06d}-{len(files):05d}-{uuid.uuid4().hex}.ids"
            known = [d for d in doc_ids if d is not None]
            with system.open_output_stream(posixpath.join(folder, name)) as out:
                out.write(file_head(known, len(doc_ids) - len(known), np.array(ends, np.int64), self.id_bytes))
                out.write(held)
            files.append((context.partitionId(), len(files), name, len(ends), ends[-1]))
            doc_ids.clear(), ends.clear(), held.clear()

        for batch in iterator:
            for doc, ids in zip(batch.column("doc_id").to_pylist(), batch.column("ids")):
                ids = ids.as_buffer()
                if ends and (len(held) + ids.size) // self.id_bytes > self.file_ids:
                    close()
                held += ids
                doc_ids.append(doc)
                ends.append(len(held) // self.id_bytes)
        if ends:
            close()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        """Write the index of all files, under another name first."""
        files = sorted(f for message in messages if message for f in message.files)
        totals = np.array([(f[3], f[4]) for f in files], dtype=np.int64).reshape(-1, 2)
        before = np.cumsum(totals, axis=0) - totals
        names = "\n".join(f[2] for f in files).encode()
        content = struct.pack("<4sQ", _MAGIC, len(files)) + elias_fano.encode(before[:, 0]) + elias_fano.encode(before[:, 1]) + names
        system, folder = _place(self.path)
        system.create_dir(folder, recursive=True)
        with system.open_output_stream(posixpath.join(folder, "_index")) as out:
            out.write(content)
        system.move(posixpath.join(folder, "_index"), posixpath.join(folder, "index"))

    def abort(self, messages: list[Written | None]) -> None:
        """Nothing to undo: without an index the files are not part of anything."""


class _Reader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path

    def partitions(self) -> list[FilePart]:
        system, folder = _place(self.path)
        with system.open_input_file(posixpath.join(folder, "index")) as file:
            content = file.read()
        magic, count = struct.unpack_from("<4sQ", content)
        if magic != _MAGIC:
            raise ValueError(f"{self.path} holds no index of token files")
        if not count:
            return [FilePart("", 0)]
        documents = elias_fano.EliasFano(content, 12)
        ids = elias_fano.EliasFano(content, 12 + documents.size)
        names = content[12 + documents.size + ids.size :].decode().split("\n")
        return [FilePart(name, start) for name, start in zip(names, ids.select(np.arange(count)).tolist())]

    def read(self, partition: FilePart) -> Iterator[pa.RecordBatch]:
        if partition.name:
            system, folder = _place(self.path)
            yield from TokenFile(system, posixpath.join(folder, partition.name)).batches(partition.before)


class TokenFiles(DataSource):
    """``token_files``: options ``path``, and when writing ``id_bytes`` and ``file_ids``."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "doc_id long, start long, n_tokens long, ids binary"

    def reader(self, schema) -> _Reader:
        return _Reader(self.options["path"])

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], int(self.options.get("id_bytes", 4)), int(self.options.get("file_ids", FILE_IDS)))


def write(docs: DataFrame, path: str, tokenizer_path: str, end_id: int = 2, file_ids: int = FILE_IDS, task_bytes: int = TASK_BYTES, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the token ids of every row, ``end_id`` behind each, in ascending order of ``doc_id``.

    Rows without an id come first. Rows that share an id are rows of their own, ordered by a hash
    of their text; rows that are equal altogether are spread over tasks by their place in the
    input. A null text is empty and holds the end id alone. The folder must not hold token files.
    """
    with open(tokenizer_path, encoding="utf-8") as file:
        tokenizer = file.read()
    from tokenizers import Tokenizer

    id_bytes = 2 if max(Tokenizer.from_str(tokenizer).get_vocab_size(), end_id) <= 1 << 16 else 4
    tasks = max(1, -(-corpus_bytes(docs, text_col) // task_bytes))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    keys = [F.col("doc_id").asc_nulls_first(), F.col("_hash"), F.col("_row")]
    ordered = (
        rows.withColumns({"_hash": F.xxhash64("text"), "_row": F.monotonically_increasing_id()}).repartitionByRange(tasks, *keys).sortWithinPartitions(*keys)
    )

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = encoder_of(tokenizer)
        for batch in batches:
            first = 0
            for ids, counts in encoder.encode(batch.column("text")):
                ends = np.cumsum(counts)
                whole = np.insert(ids.astype(f"<u{id_bytes}"), ends, end_id)
                offsets = np.concatenate([[0], ends + np.arange(1, len(ends) + 1)]) * id_bytes
                raw = pa.Array.from_buffers(pa.large_binary(), len(ends), [None, pa.py_buffer(offsets), pa.py_buffer(whole)]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(first, len(ends)), raw], names=["doc_id", "ids"])
                first += len(ends)

    docs.sparkSession.dataSource.register(TokenFiles)
    encoded = ordered.select("doc_id", "text").mapInArrow(encode, "doc_id long, ids binary")
    encoded.write.format(FORMAT).mode("append").options(id_bytes=id_bytes, file_ids=file_ids).save(path)


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id``, ``start`` (token ids of all documents before), ``n_tokens`` and ``ids`` (little-endian, 32 bits) of every document."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format(FORMAT).load(path)


def token_file_digest(docs: DataFrame, path: str, tokenizer_path: str) -> DataFrame:
    """The documents' places in the files just written: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``.

    Nulls, repeated rows and empty texts as in ``write``; an empty table gives files without documents.
    """
    write(docs, path, tokenizer_path)
    return read(docs.sparkSession, path).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
