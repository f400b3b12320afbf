"""Elements of large JSON array files, read by byte ranges.

A file is cut into ranges of bytes. A first pass tells for every range, without knowing what
stands before it, how it changes the state of a reader that enters outside of a string and of one
that enters inside: whether it leaves inside, how deep brackets are then, and how many commas
stand at which depth. Sums over the ranges of a file, one narrow row each, give every range
its true state and the position of its first element. A second pass reads the ranges again;
an element belongs to the range in which the bracket or comma before it stands, and is read to its end beyond
the range.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from duelframe.functions.columns import checked
from duelframe.session import materialize

#: Bytes of a range; files up to this size are no concern of this module.
RANGE_BYTES = 64 << 20
#: Bytes read at a time.
PIECE_BYTES = 1 << 20
#: Bytes read at a time by a range shorter than this, which mostly ends in its first piece.
LEAST_PIECE_BYTES = 64 << 10
#: Bytes of a task; shorter ranges share one.
TASK_BYTES = 8 << 20

_QUOTE, _BACKSLASH, _COMMA = 0x22, 0x5C, 0x2C
_STEP = np.zeros(256, dtype=np.int8)
_STEP[[0x5B, 0x7B]] = 1
_STEP[[0x5D, 0x7D]] = -1
_MARKS = _STEP != 0
_MARKS[_COMMA] = True
_BLANK = b" \t\r\n"


def _open(path: str) -> pa.NativeFile:
    if path.startswith("file:/"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, place = fs.FileSystem.from_uri(path)
    return system.open_input_file(place)


def _escapes_before(file: pa.NativeFile, at: int) -> bool:
    """Whether an odd number of backslashes stands before the byte ``at``."""
    run = 0
    while at > 0:
        step = min(at, 4096)
        data = file.read_at(step, at - step)
        here = len(data) - len(data.rstrip(b"\\"))
        run += here
        if here < step:
            break
        at -= step
    return run % 2 == 1


class _Lexer:
    """Unescaped quotes, and the brackets and commas between them, of one piece after the other."""

    def __init__(self, escaped: bool):
        self.escaped = escaped  # the next byte stands behind an odd number of backslashes

    def piece(self, raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places of unescaped quotes, places of brackets and commas, and the number of quotes before each of those."""
        data = np.frombuffer(raw, np.uint8)
        quotes = np.flatnonzero(data == _QUOTE)
        slashes = np.flatnonzero(data == _BACKSLASH)
        if len(slashes) or self.escaped:
            # Runs of backslashes; the byte behind a run of odd length is escaped.
            first = np.ones(len(slashes), dtype=bool)
            first[1:] = np.diff(slashes) > 1
            begins = slashes[first]
            lengths = np.diff(np.append(np.flatnonzero(first), len(slashes)))
            behind = begins + lengths
            odd = lengths % 2 == 1
            if self.escaped:
                if len(begins) and begins[0] == 0:
                    odd[0] = ~odd[0]
                else:
                    behind, odd = np.append(behind, 0), np.append(odd, True)
            escaped = behind[odd]
            quotes = quotes[~np.isin(quotes, escaped)]
            self.escaped = bool((escaped == len(data)).any())
        marks = np.flatnonzero(_MARKS[data])
        return quotes, marks, np.searchsorted(quotes, marks)


_CHANGES = "path string, begin long, until long, quotes long, deeper0 long, deeper1 long, commas0 map<int,long>, commas1 map<int,long>"


def _changes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What each range does to a reader that enters outside (0) or inside (1) of a string."""
    for batch in batches:
        rows = []
        for path, begin, until in zip(*[batch.column(c).to_pylist() for c in ("path", "begin", "until")]):
            quotes, deeper, commas = 0, [0, 0], [{}, {}]
            with _open(path) as file:
                lexer = _Lexer(_escapes_before(file, begin))
                for at in range(begin, until, PIECE_BYTES):
                    raw = file.read_at(min(PIECE_BYTES, until - at), at)
                    data = np.frombuffer(raw, np.uint8)
                    found, marks, before = lexer.piece(raw)
                    for entered in (0, 1):
                        own = data[marks[(quotes + before + entered) % 2 == 0]]
                        depth = deeper[entered] + np.cumsum(_STEP[own], dtype=np.int64)
                        for level, count in zip(*np.unique(depth[own == _COMMA], return_counts=True)):
                            commas[entered][int(level)] = commas[entered].get(int(level), 0) + int(count)
                        deeper[entered] = int(depth[-1]) if len(depth) else deeper[entered]
                    quotes += len(found)
            rows.append((path, begin, until, quotes, *deeper, *[list(c.items()) for c in commas]))
        kinds = [pa.string(), *[pa.int64()] * 5, *[pa.map_(pa.int32(), pa.int64())] * 2]
        names = [part.split()[0] for part in _CHANGES.split(", ")]
        columns = list(zip(*rows)) if rows else [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, kinds)], names=names)


def _ranges(files: DataFrame, keys: list[str], range_bytes: int) -> DataFrame:
    """Ranges of the files ``(path, length, *keys)`` with ``inside``, ``depth`` and ``first``: their state, and the position of their first element."""
    begins = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(range_bytes).cast("long")))
    cut = files.filter("length > 0").select("path", begins.alias("begin"), "length")
    ranges = materialize(cut.select("path", "begin", F.least(F.col("begin") + range_bytes, "length").alias("until")), "ranges")
    count = _task_count(*ranges.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.col("until") - F.col("begin")), F.lit(0))).first(), files.sparkSession.sparkContext.defaultParallelism)
    changes = materialize(ranges.repartition(count).mapInArrow(_changes, _CHANGES), "range-changes")
    # One row for each range of a file.
    before = Window.partitionBy("path").orderBy("begin").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("path")
    zero = F.lit(0).cast("long")
    entered = F.coalesce(F.sum("quotes").over(before), zero) % 2
    inside = F.col("inside") == 1
    deeper = F.when(inside, F.col("deeper1")).otherwise(F.col("deeper0"))
    commas = F.when(inside, F.col("commas1")).otherwise(F.col("commas0"))
    at_top = F.coalesce(F.element_at(commas, (1 - F.col("depth")).cast("int")), zero)
    # The array's own bracket is an element's beginning too.
    opened = F.when(F.col("begin") == 0, F.lit(1)).otherwise(F.lit(0))
    states = (
        changes.withColumn("inside", entered)
        .withColumns({"depth": F.coalesce(F.sum(deeper).over(before), zero), "_end": F.sum(deeper).over(whole), "_quotes": F.sum("quotes").over(whole)})
        .withColumn("first", F.coalesce(F.sum(at_top + opened).over(before), zero))
    )
    closed = (F.col("_end") == 0) & (F.col("_quotes") % 2 == 0)
    sound = checked(states, closed, F.concat(F.lit("file is not a whole JSON array: "), F.col("path")))
    named = sound.join(files.select(F.col("path").alias("_path"), *keys), F.col("path") == F.col("_path"))
    return materialize(named.select(*keys, "path", "begin", "until", "inside", "depth", "first"), "range-states").repartition(count)


def _task_count(ranges: int, total: int, slots: int) -> int:
    """Tasks for the ranges: one each if they are long, else as many as their bytes fill, but enough for all slots."""
    return max(1, min(ranges, max(-(-total // TASK_BYTES), 2 * slots)))


def _array_begin(raw: bytes, path: str) -> int:
    lead = len(raw) - len(raw.lstrip(_BLANK))
    if raw[lead : lead + 1] != b"[":
        raise ValueError(f"no JSON array in {path}")
    return lead


def _delimiters(file: pa.NativeFile, path: str, begin: int, until: int, inside: int, depth: int) -> Iterator[tuple[int, bytes, list[int], int]]:
    """Pieces from ``begin`` on: place, bytes, the array's own bracket and commas, and its end or -1."""
    lexer, quotes = _Lexer(_escapes_before(file, begin)), inside
    # Blanks may stand before the array, so its beginning is looked for in a whole piece.
    step_bytes = min(PIECE_BYTES, max(until - begin, LEAST_PIECE_BYTES)) if begin else PIECE_BYTES
    for at in range(begin, file.size(), step_bytes):
        raw = file.read_at(step_bytes, at)
        data = np.frombuffer(raw, np.uint8)
        found, marks, before = lexer.piece(raw)
        marks = marks[(quotes + before) % 2 == 0]
        quotes += len(found)
        step = _STEP[data[marks]]
        level = depth + np.cumsum(step, dtype=np.int64)
        depth = int(level[-1]) if len(level) else depth
        own = (level == 1) & (step == 0)
        if at == 0:
            own |= marks == _array_begin(raw, path)
        ends = marks[(level == 0) & (step < 0)]
        end = int(ends[0]) if len(ends) else -1
        yield at, raw, [m for m in marks[own].tolist() if end < 0 or m < end], end
        if end >= 0:
            return


def _require_blank(file: pa.NativeFile, path: str, begin: int, until: int) -> None:
    for at in range(begin, until, PIECE_BYTES):
        if file.read_at(min(PIECE_BYTES, until - at), at).strip(_BLANK):
            raise ValueError(f"text behind the end of the JSON array in {path}")


def _elements(path: str, begin: int, until: int, inside: int, depth: int) -> Iterator[tuple[bytes, list[int]]]:
    """Stretches of whole elements that begin in the range, and where commas stand between them."""
    with _open(path) as file:
        if begin > 0 and depth == 0:
            _require_blank(file, path, begin, until)
            return
        held, cuts, begun = bytearray(), [], False
        for at, raw, places, end in _delimiters(file, path, begin, until, inside, depth):
            if 0 <= end and at + end < until:
                _require_blank(file, path, at + end + 1, until)
            start = 0
            for place in places:
                beyond = at + place >= until
                if begun and not beyond:
                    cuts.append(len(held) + place - start)
                elif begun or beyond:
                    end = place  # the last element of the range ends here, or none begins in it
                    break
                else:
                    begun, start = True, place + 1
            if not begun and (end >= 0 or at + len(raw) >= until):
                return
            if begun:
                held += raw[start:end] if end >= 0 else raw[start:]
            if end >= 0:
                yield bytes(held), cuts
                return
            if cuts and len(held) >= PIECE_BYTES:
                yield bytes(held[: cuts[-1]]), cuts[:-1]
                del held[: cuts[-1] + 1]
                cuts = []
        if begun:
            raise ValueError(f"JSON array without an end in {path}")


def array_elements(files: DataFrame, keys: list[str], texts: bool, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``keys``, ``pos`` and ``value`` of every element of the array files ``(path, length, *keys)``.

    With ``texts`` every element must be a JSON string and ``value`` is its text; else it is the
    element's JSON. Ranges are spread over tasks, short ones several to a task. A file that is not one whole
    JSON array stops the job. Files are opened by their address, so their store must be one
    that pyarrow reads (local or mounted folders, HDFS, object stores).
    """

    kinds = {f.name: f.dataType.simpleString() for f in files.schema.fields if f.name in keys}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                place = row["first"]
                for raw, cuts in _elements(row["path"], row["begin"], row["until"], row["inside"], row["depth"]):
                    if texts:
                        values = json.loads(b"[" + raw + b"]")
                        if not all(isinstance(v, str) for v in values):
                            raise ValueError(f"{row['path']} is not a JSON array of strings")
                    elif raw.strip(_BLANK):
                        bounds = [-1, *cuts, len(raw)]
                        values = [raw[a + 1 : b].decode() for a, b in zip(bounds[:-1], bounds[1:])]
                    else:
                        values = []
                    named = [pa.array([row[key]] * len(values), batch.schema.field(key).type) for key in keys]
                    found = [pa.array(np.arange(place, place + len(values))), pa.array(values, pa.string())]
                    yield pa.RecordBatch.from_arrays([*named, *found], names=[*keys, "pos", "value"])
                    place += len(cuts) + 1

    schema = ", ".join([*[f"`{key}` {kinds[key]}" for key in keys], "pos long, value string"])
    return _ranges(files, keys, range_bytes).mapInArrow(run, schema)
