"""Compression of vectors to codes: a codebook for each of their parts, refined over metric trees.

Tasks cut the vectors they read into blocks and build one tree for each part of a block
(``metric_trees``). The blocks are written once to the shared folder; every round reads them, takes
the codebooks along (``entries`` times the vector's components, whatever the table's size) and
returns a sum and a number for each entry and task, which Spark adds up. No vector is shuffled, and
no result depends on how rows fall into blocks, as all sums are whole numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from duelframe.llm.metric_trees import Tree
from duelframe.llm.vectors import is_finite, matrix, scaled_floor, width
from duelframe.session import materialize, small_side

PARTS, ENTRIES, ROUNDS, SCALE = 16, 64, 2, 256
#: Whole numbers beyond this are set to it, so that squared distances stay exact.
MOST = 1 << 28
#: Vectors of a block; a block is one row of the written table, a few MB.
BLOCK_ROWS = 4096

Codebooks = np.ndarray  # parts, entries, components of a part


def whole_vectors(column: pa.Array | pa.ChunkedArray, dims: int, parts: int = PARTS) -> np.ndarray:
    """Vectors as whole numbers, ``(vectors, parts, components of a part)``; zeros fill the last part."""
    values = scaled_floor(matrix(column, dims), SCALE, MOST)
    wide = -(-dims // parts)
    filled = np.zeros((len(values), parts * wide), dtype=np.int64)
    filled[:, :dims] = values
    return filled.reshape(len(values), parts, wide)


def build_trees(vectors: DataFrame, dims: int, keep: list[str], vector_col: str, parts: int = PARTS) -> DataFrame:
    """Blocks of vectors: the columns ``keep`` as arrays, and ``trees``, the fields of one tree for each part."""
    kept = vectors.select(*keep, vector_col)
    schema = ", ".join(f"`{f.name}` array<{f.dataType.simpleString()}>" for f in kept.schema.fields[: len(keep)])

    def block(table: pa.Table) -> pa.RecordBatch:
        cut = whole_vectors(table.column(vector_col), dims, parts)
        fields = [field for part in range(parts) for field in Tree(cut[:, part]).to_bytes()]
        whole = np.array([0, table.num_rows], np.int32)
        lists = [pa.ListArray.from_arrays(whole, pa.concat_arrays(table.column(c).chunks)) for c in keep]
        return pa.RecordBatch.from_arrays([*lists, pa.array([fields], pa.list_(pa.binary()))], names=[*keep, "trees"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(at, BLOCK_ROWS)
                if rows + part.num_rows > BLOCK_ROWS:
                    yield block(pa.Table.from_batches(waiting))
                    waiting, rows = [], 0
                waiting.append(part)
                rows += part.num_rows
        if rows:
            yield block(pa.Table.from_batches(waiting))

    return kept.mapInArrow(run, f"{schema}, trees array<binary>")


def _trees(batch: pa.RecordBatch, row: int, components: int) -> list[Tree]:
    fields = batch.column("trees")[row].as_py()
    step = len(Tree.FIELDS)
    return [Tree.from_bytes(fields[at : at + step], components) for at in range(0, len(fields), step)]


def refine(blocks: DataFrame, codebooks: Codebooks) -> Codebooks:
    """Each entry replaced by the floor of the mean of its parts; an entry without parts stays."""
    parts, entries, components = codebooks.shape

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, counts = np.zeros(codebooks.shape, dtype=np.int64), np.zeros((parts, entries), dtype=np.int64)
        for batch in batches:
            for row in range(batch.num_rows):
                for part, tree in enumerate(_trees(batch, row, components)):
                    _, own, number = tree.assign(codebooks[part])
                    sums[part] += own
                    counts[part] += number
        part, entry = np.nonzero(counts)
        if len(part):
            ends = np.arange(len(part) + 1, dtype=np.int32) * components
            lists = pa.ListArray.from_arrays(ends, pa.array(sums[part, entry].ravel(), pa.int64()))
            columns = [pa.array(part, pa.int32()), pa.array(entry, pa.int32()), pa.array(counts[part, entry], pa.int64()), lists]
            yield pa.RecordBatch.from_arrays(columns, names=["part", "entry", "number", "sums"])

    found = blocks.select("trees").mapInArrow(run, "part int, entry int, number long, sums array<long>")
    totals = found.groupBy("part", "entry").agg(F.sum("number").alias("number"), *[F.sum(F.col("sums")[i]).alias(f"sum{i}") for i in range(components)])
    fresh = codebooks.copy()
    for row in totals.collect():  # at most parts x entries
        fresh[row["part"], row["entry"]] = [row[f"sum{i}"] // row["number"] for i in range(components)]
    return fresh


def encode(blocks: DataFrame, codebooks: Codebooks, keep: list[str]) -> DataFrame:
    """The columns ``keep`` of every vector, its ``code`` (two hex digits a part) and its squared ``error``."""
    parts, entries, components = codebooks.shape
    digits = np.array([f"{i:02x}".encode() for i in range(max(1, entries))], dtype="S2")
    schema = ", ".join(f"`{f.name}` {f.dataType.elementType.simpleString()}" for f in blocks.schema.fields if f.name in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                trees = _trees(batch, row, components)
                chosen = np.zeros((len(trees[0].order), parts), dtype=np.int64)
                error = np.zeros(len(chosen), dtype=np.int64)
                for part, tree in enumerate(trees):
                    nearest, _, _ = tree.assign(codebooks[part])
                    chosen[tree.order, part] = nearest
                    error[tree.order] += ((tree.points - codebooks[part][nearest]) ** 2).sum(axis=1)
                codes = np.ascontiguousarray(digits[chosen]).view(f"S{2 * parts}").ravel().astype(str)
                columns = [batch.column(c)[row].values for c in keep]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(codes, pa.string()), pa.array(error, pa.int64())], names=[*keep, "code", "error"])

    return blocks.select(*keep, "trees").mapInArrow(run, f"{schema}, code string, error long")


def fit(vectors: DataFrame, blocks: DataFrame, dims: int, id_col: str, vector_col: str, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS) -> Codebooks:
    """Codebooks that start as the vectors of the least ids and are refined ``rounds`` times."""
    first = vectors.filter(F.col(id_col).isNotNull()).orderBy(id_col, vector_col).limit(entries).select(vector_col).toArrow()
    codebooks = np.ascontiguousarray(whole_vectors(first.column(0), dims, parts).transpose(1, 0, 2))
    if codebooks.shape[1] == 0:  # no vector has an id
        codebooks = np.zeros((parts, 1, codebooks.shape[2]), dtype=np.int64)
    for _ in range(rounds):
        codebooks = refine(blocks, codebooks)
    return codebooks


def codebooks_digest(codebooks: Codebooks) -> str:
    return hashlib.sha256(",".join(map(str, codebooks.ravel().tolist())).encode()).hexdigest()


def compress(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """``vec_id``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every row with a usable vector.

    Rows whose vector is null or holds a null or non-finite component go. A shorter vector counts as
    if zeros followed, and components beyond ``MOST`` as ``MOST``. Rows without an id, or with the
    same one, are rows of their own; the codebooks start from the least ids that are not null (of
    equal ids the least vectors first), fewer than 64 if there are no more, and from zeros if there
    are none. Null labels count as one label. An empty table gives an empty result.
    """
    usable = vectors.filter(is_finite(vector_col)).select(
        F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), F.col(vector_col).alias("vector")
    )
    dims = width(usable, "vector")
    blocks = materialize(build_trees(usable, dims, ["vec_id", "label"], "vector"), "metric-trees")
    codebooks = fit(usable, blocks, dims, "vec_id", "vector")
    coded = materialize(encode(blocks, codebooks, ["vec_id", "label"]), "vector-codes")
    by_label = small_side(coded.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error")), "label-errors")
    return coded.join(by_label, coded["label"].eqNullSafe(by_label["_label"])).select(
        "vec_id", "code", "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256")
    )
