"""Readers for prompts, response shards, scores, splits and evaluation sets."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from duelframe.functions.columns import checked, evaluated_once, named_key
from duelframe.indexing import index_rows
from duelframe.schema import require_columns
from duelframe.session import materialize, small_side
from duelframe.sources.json_arrays import RANGE_BYTES, array_elements

# Fixed value: name of a shard file, holding the shard and the sample number.
SHARD_FILE = r"responses_(\d+)_(\d+)\.json$"
COMBINED_FILE = r"responses_(\d+)\.json$"
# Fixed value: names of files that Spark's text reader unpacks.
PACKED_FILE = r"\.(gz|bz2|deflate|lz4|snappy|zst)$"


def scan_prompts(df: DataFrame, order_cols: Sequence[str] | None = None) -> DataFrame:
    """``(prompt_idx, prompt)``; positions come from ``order_cols`` when there are none.

    ``order_cols`` must identify a row; two rows that agree in them stop the job. Only these columns are
    sorted, by range, and written with their positions; prompts get theirs by a join on them and
    are neither sorted nor written.
    """
    require_columns(df, "prompt")
    if "prompt_idx" in df.columns:
        return df.select("prompt_idx", "prompt")
    if not order_cols:
        raise ValueError("a prompt table without prompt_idx needs order_cols")
    keys = [f"_key{i}" for i in range(len(order_cols))]
    named = {key: F.col(column) for key, column in zip(keys, order_cols)}
    places = index_rows(df.select(*[column.alias(key) for key, column in named.items()]), keys, "prompt_idx")
    counted = places.groupBy(*keys).agg(F.min("prompt_idx").alias("prompt_idx"), F.count(F.lit(1)).alias("_rows"))
    places = checked(counted, F.col("_rows") == 1, named_key("order_cols do not identify a row", *keys)).drop("_rows")
    same = [F.col(f"_own{key}").eqNullSafe(F.col(key)) for key in keys]
    prompts = df.select("prompt", *[column.alias(f"_own{key}") for key, column in named.items()])
    return prompts.join(places, reduce(lambda a, b: a & b, same)).select("prompt_idx", "prompt")


def scan_response_shards(spark: SparkSession, path: str, partitioned: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows ``(shard, sample_id, pos, response)`` from files of JSON string arrays.

    Reads files named ``responses_{shard}_{sample}.json``, or with ``partitioned`` the
    folders ``write_response_shards`` makes. A file is one shard of one sample. Files up to
    ``range_bytes`` are read by one task each, larger ones by a task for every range
    (``json_arrays``). A file that is not a whole JSON array of strings stops the job.
    """

    def keys(file: Column) -> list[Column]:
        if partitioned:
            return [F.col(key).cast("int").alias(key) for key in ("shard", "sample_id")]
        return [F.regexp_extract(file, SHARD_FILE, i).cast("int").alias(key) for i, key in ((1, "shard"), (2, "sample_id"))]

    pattern = None if partitioned else "responses_*_*.json"
    rows = _array_rows(spark, path, pattern, keys, ("shard", "sample_id"), range_bytes)
    return rows.select("shard", "sample_id", F.col("pos").cast("int").alias("pos"), "response")


def _array_rows(
    spark: SparkSession, path: str, pattern: str | None, keys: Callable[[Column], list[Column]], names: Sequence[str], range_bytes: int
) -> DataFrame:
    """``names``, ``pos`` and ``response`` of all files; ``keys`` makes the names from a file's address.

    Files for which a name is null are passed over. The folder is listed once; only packed files take a
    second listing, by the text reader.
    """
    reader = spark.read if pattern is None else spark.read.option("pathGlobFilter", pattern)
    address, length = F.col("_metadata.file_path"), F.col("_metadata.file_size")
    packed = F.col("_metadata.file_name").rlike(PACKED_FILE)
    files = reader.format("binaryFile").load(path)
    texts = files.filter((length <= range_bytes) & ~packed).select(F.col("content").cast("string").alias("value"), *keys(address))
    if files.filter((length <= range_bytes) & packed).limit(1).count():
        unpacked = reader.text(path, wholetext=True).filter((length <= range_bytes) & packed)
        texts = texts.unionByName(unpacked.select("value", *keys(address)))
    parsed = evaluated_once(texts.dropna(subset=list(names)), {"_responses": F.from_json("value", "array<string>", {"mode": "FAILFAST"})})
    sound = F.col("_responses").isNotNull() & ~F.exists("_responses", lambda text: text.isNull())
    parsed = checked(parsed, sound, named_key("response file is not a JSON array of strings", *names))
    rows = parsed.select(*names, F.posexplode("_responses").alias("pos", "response")).withColumn("pos", F.col("pos").cast("long"))
    large = files.filter(length > range_bytes).select("path", "length", *keys(F.col("path"))).dropna(subset=list(names))
    if not large.limit(1).count():
        return rows
    return rows.unionByName(array_elements(large, list(names), True, range_bytes).withColumnRenamed("value", "response"))


def scan_combined_responses(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """``(prompt_idx, sample_id, response)`` from files ``responses_{sample}.json``.

    Such a file holds the responses of one sample for all prompts, in prompt order. Files
    beyond ``range_bytes`` are read in ranges.
    """

    def keys(file: Column) -> list[Column]:
        sample = F.regexp_extract(file, COMBINED_FILE, 1)
        return [F.when(sample != "", sample).cast("int").alias("sample_id")]

    rows = _array_rows(spark, path, "responses_*.json", keys, ("sample_id",), range_bytes)
    return rows.select(F.col("pos").alias("prompt_idx"), "sample_id", "response")


def parse_shard_ids(text: str) -> list[int]:
    """Shard ids of a list such as ``(0,5,6)``, in its order."""
    return [int(part) for part in text.strip("()").split(",")]


def _shard_position(order: Sequence[int] | None) -> Column:
    """Place of a shard in the given order; ids count as places without one."""
    if order is None:
        return F.col("shard")
    place = F.array_position(F.array(*[F.lit(s) for s in order]), F.col("shard"))
    return F.when(place > 0, place - 1).otherwise(
        F.raise_error(F.concat(F.lit("shard is not in the given order: "), F.col("shard").cast("string")))
    )


def combine_shards(shards: DataFrame, order: Sequence[int] | None = None, short_end: bool = False) -> DataFrame:
    """``(prompt_idx, sample_id, response)`` with the shards of a sample laid end to end.

    Offsets come from a table with one row per file, so the responses are neither
    shuffled nor rewritten. Every sample must have the same shards (those of ``order``,
    else 0, 1, 2, ... without a gap) with as many responses in each; anything else would
    give responses another prompt and is an error. With ``short_end`` a sample may lack responses
    of the last prompts: its last shard may be shorter or missing, as nothing is laid behind it.
    """
    placed = shards.withColumn("shard_pos", _shard_position(order).cast("long"))
    before = (
        Window.partitionBy("sample_id")
        .orderBy("shard_pos")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    sizes = materialize(
        placed.groupBy("sample_id", "shard_pos").agg(F.count(F.lit(1)).alias("_rows"), F.max("pos").alias("_last")), "sizes"
    )
    _require_full_grid(sizes, None if order is None else len(order), short_end)
    offsets = small_side(
        sizes.select(
            "sample_id",
            "shard_pos",
            F.coalesce(F.sum("_rows").over(before), F.lit(0)).alias("_offset"),
        ),
        "offsets",
    )
    return placed.join(offsets, ["sample_id", "shard_pos"]).select(
        (F.col("_offset") + F.col("pos")).alias("prompt_idx"), "sample_id", "response"
    )


def _require_full_grid(sizes: DataFrame, n_shards: int | None, short_end: bool) -> None:
    """Raise unless every sample has every shard, of one length over the samples; ``short_end`` excepts the last one."""
    samples = sizes.select("sample_id").distinct().count()
    shards = sizes.groupBy("shard_pos").agg(
        F.count(F.lit(1)).alias("_samples"), F.min("_rows").alias("_least"), F.max("_rows").alias("_most"), F.max("_last").alias("_last")
    )
    count, last = shards.agg(F.count(F.lit(1)), F.max("shard_pos")).first()
    differs = (F.col("_samples") != samples) | (F.col("_least") != F.col("_most"))
    if short_end:
        differs &= F.col("shard_pos") != F.lit(last)
    odd = shards.filter(differs | (F.col("_last") + 1 != F.col("_most")))
    found = odd.orderBy("shard_pos").limit(5).collect()
    if found:
        raise ValueError("shards that differ between samples: " + ", ".join(f"place {row['shard_pos']}" for row in found))
    expected = n_shards if n_shards is not None else (last or 0) + (last is not None)
    if count != expected:
        raise ValueError(f"{expected} shards expected for every sample, {count} found")


def scan_scores(shards: DataFrame, frac_len: int, n_shards: int) -> DataFrame:
    """``(prompt_idx, sample_id, score)`` from rows ``(shard_pos, pos, sample_id, score)``.

    Several shards without a shard length would all start at row 0 and overwrite each
    other, so that is refused. A position past the shard length belongs to the next shard's
    rows and stops the job.
    """
    if frac_len <= 0 and n_shards > 1:
        raise ValueError("several score shards need a positive frac_len")
    if frac_len > 0:
        inside = (F.col("pos") >= 0) & (F.col("pos") < frac_len)
        shards = checked(shards, inside, named_key(f"score position outside its shard of {frac_len} rows", "shard_pos", "pos"))
    return shards.select(
        (F.col("shard_pos") * frac_len + F.col("pos")).alias("prompt_idx"), "sample_id", "score"
    )


def read_split(spark: SparkSession, folder: str, split: str = "train") -> DataFrame:
    """The split of a dataset folder: ``{split}.parquet``, else rows of a ``split`` column.

    A folder with neither is all training rows; any other split of it is an error.
    """
    try:
        return spark.read.parquet(f"{folder}/{split}.parquet")
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
    whole = spark.read.parquet(folder)
    if "split" in whole.columns:
        return whole.filter(F.col("split") == split)
    if split != "train":
        raise ValueError(f"{folder} has no split {split}")
    return whole


def scan_eval_set(spark: SparkSession, path: str, schema: str, one_array: bool = False, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Instruction records from JSON: one record per line, or one array per file.

    Lines are split over tasks; so are array files beyond ``range_bytes``, by ranges. A malformed
    record and one without an instruction stop the job.
    """
    records = spark.read.schema(schema).option("multiLine", one_array).option("mode", "FAILFAST").json(path)
    if one_array:
        names = records.columns
        large = spark.read.format("binaryFile").load(path).filter(F.col("length") > range_bytes).select("path", "length")
        if large.limit(1).count():
            elements = array_elements(large, [], False, range_bytes)
            parsed = evaluated_once(elements, {"_record": F.from_json("value", schema, {"mode": "FAILFAST"})})
            records = records.filter(F.col("_metadata.file_size") <= range_bytes).select(*names).unionByName(parsed.select("_record.*"))
    return checked(require_columns(records, "instruction"), F.col("instruction").isNotNull(), "evaluation record without an instruction")
