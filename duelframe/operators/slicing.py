"""Shards, slices, samples, splits and the mixing of datasets."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from duelframe.functions.columns import hash_order, quotient
from duelframe.indexing import index_rows

# Prompt rows one generation round may cover, the size of the sampled
# test split, the shuffle seed, and the number of prompt sets rounds cycle through.
ROUND_ROWS = 20_800
TEST_ROWS = 500
SHUFFLE_SEED = 42
PROMPT_SETS = 3


def shard_slice(
    df: DataFrame, frac_len: int, data_frac: int, index_col: str = "prompt_idx"
) -> DataFrame:
    """Rows of one contiguous shard; everything when ``frac_len`` is not positive."""
    if frac_len <= 0:
        return df
    index = F.col(index_col)
    return df.filter((index >= frac_len * data_frac) & (index < frac_len * (data_frac + 1)))


def shard_ids(df: DataFrame, frac_len: int, index_col: str = "prompt_idx") -> DataFrame:
    """Add the number of the shard every row falls into."""
    if frac_len <= 0:
        return df.withColumn("shard_id", F.lit(0).cast("long"))
    return df.withColumn("shard_id", quotient(F.col(index_col), frac_len))


def shard_length(n_shards: int, round_rows: int = ROUND_ROWS) -> int:
    """Rows per shard."""
    return round_rows // n_shards


def shard_plan(
    df: DataFrame, n_shards: int, round_rows: int = ROUND_ROWS, index_col: str = "prompt_idx"
) -> DataFrame:
    """Rows per shard, with ``covered`` false for rows past the last planned shard."""
    length = shard_length(n_shards, round_rows)
    return (
        shard_ids(df, length, index_col)
        .groupBy("shard_id")
        .agg(F.count(F.lit(1)).alias("n_rows"))
        .withColumn("covered", F.col("shard_id") < n_shards)
    )


def head_n(df: DataFrame, n: int, index_col: str = "prompt_idx") -> DataFrame:
    """First ``n`` rows; everything when ``n`` is not positive."""
    return df if n <= 0 else df.filter(F.col(index_col) < n)


# Hexadecimal digits of a hash by which one pass narrows the range of the last sampled row.
RANGE_DIGITS = 4


def row_hash(df: DataFrame) -> Column:
    """128 bits over all columns of a row, as hexadecimal digits."""
    # Maps cannot be hashed; as text they can.
    hashable = [F.to_json(F.struct(f"`{f.name}`")) if "map<" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in df.schema.fields]
    halves = [F.lpad(F.hex(F.xxhash64(F.lit(salt), *hashable)), 16, "0") for salt in (1, 2)]
    return F.concat(*halves)


def _ranges(hashes: DataFrame, prefix: str, digits: int) -> list[Row]:
    """Rows, least and largest hash of every range below ``prefix``, named by ``digits`` more digits: at most ``16 ** digits``."""
    leading = F.substring("_hash", 1, len(prefix) + digits)
    inside = hashes.filter(F.startswith(F.col("_hash"), F.lit(prefix))) if prefix else hashes
    counts = inside.groupBy(leading.alias("_range")).agg(F.count(F.lit(1)).alias("_n"), F.min("_hash").alias("_least"), F.max("_hash").alias("_most"))
    return sorted(counts.collect(), key=lambda row: row["_range"])


def _last_place(hashes: DataFrame, n: int, digits: int, ranges: list[Row]) -> tuple[str, int]:
    """A prefix and a number: the ``n`` least hashes are those below the prefix and that many that begin with it.

    The number is 0 where all that begin with the prefix are meant. Every pass over the column
    ``_hash`` counts the range found before by its next digits; ``ranges`` are the first counts.
    """
    needed = n
    while True:
        for found in ranges:
            if needed <= found["_n"]:
                break
            needed -= found["_n"]
        if needed == found["_n"]:
            return found["_range"], 0
        if found["_least"] == found["_most"]:
            return found["_least"], needed
        ranges = _ranges(hashes, found["_range"], digits)


def sample_n(
    df: DataFrame, n: int, keys: Sequence[str], seed: int = SHUFFLE_SEED, strict: bool = True, range_digits: int = RANGE_DIGITS
) -> DataFrame:
    """Exactly ``n`` rows without replacement, the same ones for the same seed.

    The rows with the ``n`` least hashes of ``keys``; of rows that share the last hash, as
    repeated keys do, those with the least hashes of the whole row. Rows that are equal altogether
    stand for each other. The last row is found by counting: the range of hashes that holds it is
    narrowed digit by digit, mostly in one pass or two, and the sample is then a filter on the
    hash. Nothing is joined, sorted or sent to the driver but the counts of one level. Null
    keys hash like any other. ``strict`` fails on a table with fewer than ``n`` rows.
    """
    hashed = df.select(hash_order(seed, *keys).alias("_hash"))
    ranges = _ranges(hashed, "", range_digits)
    total = sum(row["_n"] for row in ranges)
    if strict and total < n:
        raise ValueError(f"cannot sample {n} rows from a smaller table")
    if n >= total:
        return df
    if n <= 0:
        return df.limit(0)
    own = hash_order(seed, *keys)
    last, needed = _last_place(hashed, n, range_digits, ranges)
    if not needed:
        return df.filter(F.substring(own, 1, len(last)) <= last)
    alike, content = df.filter(own == last), row_hash(df)
    contents = alike.select(content.alias("_hash"))
    last_row, copies = _last_place(contents, needed, range_digits, _ranges(contents, "", range_digits))
    below = df.filter(own < last)
    if not copies:
        return below.unionByName(alike.filter(F.substring(content, 1, len(last_row)) <= last_row))
    return below.unionByName(alike.filter(content < last_row)).unionByName(alike.filter(content == last_row).limit(copies))


def random_rows(df: DataFrame, k: int, keys: Sequence[str], seed: int = SHUFFLE_SEED) -> DataFrame:
    """``k`` repeatable random rows for display; all of them from a smaller table."""
    return sample_n(df, k, keys, seed, strict=False)


def seeded_shuffle(
    df: DataFrame, keys: Sequence[str], seed: int = SHUFFLE_SEED, position: str | None = None
) -> DataFrame:
    """Rows in a repeatable random order; ``position`` stores the place of each row.

    Places are counted inside the 65,536 ranges of the hash's first four digits, which
    are of even size whatever the keys, plus the range's start from a count of the keys.
    """
    order = hash_order(seed, *keys)
    if position is None:
        return df.orderBy(order, *keys)
    leading = F.substring("_hash", 1, 4)
    counts = (
        df.select(order.alias("_hash")).groupBy(leading.alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    )
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_range", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("_hash", *keys)) - 1
    return (
        df.withColumn("_hash", order)
        .withColumn("_range", leading)
        .withColumn("_within", within)
        .join(F.broadcast(starts), "_range")  # at most 65,536 rows
        .withColumn(position, F.col("_start") + F.col("_within"))
        .drop("_hash", "_range", "_within", "_start")
    )


def route_split(name: Column) -> Column:
    """``train`` or ``test`` by what the split name contains; anything else is an error."""
    return (
        F.when(F.contains(name, F.lit("train")), "train")
        .when(F.contains(name, F.lit("test")), "test")
        .otherwise(
            F.raise_error(F.concat(F.lit("split is neither train nor test: "), name)).cast("string")
        )
    )


def _route_name(name: str) -> str:
    for kind in ("train", "test"):
        if kind in name:
            return kind
    raise ValueError(f"split {name} is neither train nor test")


def validate_fractions(mixer: Mapping[str, float]) -> None:
    """Every fraction must lie in 0..1."""
    bad = {name: frac for name, frac in mixer.items() if not 0 <= frac <= 1}
    if bad:
        raise ValueError(f"dataset fractions must lie between 0 and 1: {bad}")


def kept_rows(frac: float, n: Column) -> Column:
    """``int(frac * n)`` in doubles."""
    return (F.lit(float(frac)) * n.cast("double")).cast("long")


def mix_datasets(
    frames: Mapping[str, Mapping[str, DataFrame]],
    mixer: Mapping[str, float],
    index_col: str = "row_idx",
    shuffle_seed: int | None = SHUFFLE_SEED,
) -> dict[str, DataFrame]:
    """Leading share of every training split and whole test splits, in mixer order.

    ``frames[name][split]`` holds a table with dense row positions ``index_col``.
    The share becomes a filter on that column, so it reaches the file scan. Output
    rows carry ``source_pos`` and ``source``; ``shuffle_seed=None`` leaves the order.
    """
    validate_fractions(mixer)
    parts: dict[str, list[DataFrame]] = {}
    for place, (name, frac) in enumerate(mixer.items()):
        for split, frame in frames[name].items():
            kind = _route_name(split)
            if kind == "train" and frac < 1:
                # A count of a stored table reads file footers only.
                frame = frame.filter(F.col(index_col) < int(frac * frame.count()))
            tagged = frame.withColumns(
                {"source_pos": F.lit(place), "source": F.lit(name)}
            )
            parts.setdefault(kind, []).append(tagged)
    if not parts:
        raise ValueError("the mixer names no dataset")
    mixed = {}
    for kind, tables in parts.items():
        whole = tables[0]
        for table in tables[1:]:
            whole = whole.unionByName(table)
        if shuffle_seed is not None:
            whole = seeded_shuffle(whole, ["source_pos", index_col], shuffle_seed)
        mixed[kind] = whole
    return mixed


def mix_by_source(
    df: DataFrame, source_col: str, mixer: Mapping[str, float], order_col: str, position: str | None = None
) -> DataFrame:
    """As ``mix_datasets`` for sources held in one table without positions.

    Only source and order value are indexed, over all sources at once, so a source that
    holds most rows is still spread over all tasks. The order value at each source's last
    kept place then filters the table itself: texts are neither sorted nor written.
    ``order_col`` must be unique within a source. ``position`` adds each row's place in its
    source, by a join with the index.
    """
    validate_fractions(mixer)
    place = F.lit(None).cast("int")
    for i, name in enumerate(mixer):
        place = F.when(F.col(source_col) == name, F.lit(i)).otherwise(place)
    tagged = df.withColumn("source_pos", place).filter(F.col("source_pos").isNotNull())
    indexed = index_rows(tagged.select("source_pos", F.col(order_col).alias("_order")), ["source_pos", "_order"], "_global")
    # One row per name in the mixer.
    sizes = indexed.groupBy("source_pos").agg(
        F.min("_global").alias("_first"), F.count(F.lit(1)).alias("_n"), F.count("_order").alias("_named")
    )
    shares = list(mixer.values())
    cuts = {row["source_pos"]: (row["_first"], int(shares[row["source_pos"]] * row["_n"]), row["_n"] - row["_named"]) for row in sizes.collect()}
    if any(unnamed for _, _, unnamed in cuts.values()):
        raise ValueError(f"{order_col} is null in some rows, which then have no place")
    last_places = [first + kept - 1 for first, kept, _ in cuts.values() if kept]
    last = {row["source_pos"]: row["_order"] for row in indexed.filter(F.col("_global").isin(last_places)).collect()}
    kept_here = F.lit(False)
    for pos, value in last.items():
        kept_here = kept_here | ((F.col("source_pos") == pos) & (F.col("_order") <= F.lit(value)))
    admitted = indexed.filter(kept_here).count()
    if admitted != sum(kept for _, kept, _ in cuts.values()):
        raise ValueError(f"{order_col} repeats a value at the end of a source's share")
    mixed = tagged.withColumn("_order", F.col(order_col)).filter(kept_here).drop("_order")
    if position is None:
        return mixed
    first = F.create_map(*[F.lit(x) for pos, (start, _, _) in cuts.items() for x in (pos, start)])
    places = indexed.filter(kept_here).select(
        F.col("source_pos").alias("_pos"), "_order", (F.col("_global") - F.element_at(first, F.col("source_pos"))).alias(position)
    )
    joined = mixed.join(places, (mixed["source_pos"] == places["_pos"]) & (mixed[order_col] == places["_order"]))
    return joined.drop("_pos", "_order")


def dataset_counts(df: DataFrame, *by: str) -> DataFrame:
    """Rows per split (or any other columns)."""
    return df.groupBy(*by).agg(F.count(F.lit(1)).alias("n_rows"))


def prompt_schedule(iteration: Column, n_sets: int = PROMPT_SETS) -> Column:
    """Prompt set of a training round: 1, 2, ..., n, 1, 2, ..."""
    return F.pmod(iteration - 1, F.lit(n_sets)) + 1


def fixed_prompt_schedule(iteration: Column, prompt_set: int = 1) -> Column:
    """The same prompt set in every round."""
    return F.when(iteration.isNotNull(), F.lit(prompt_set))


def iteration_of(output_dir: Column) -> Column:
    """Round number at the end of an output directory name, all digits of it."""
    return F.regexp_extract(output_dir, r"(\d+)\z", 1).cast("int")


def reference_set(output_dir: Column, n_sets: int = PROMPT_SETS, compat: bool = False) -> Column:
    """Reference response set used by a round: its number modulo n, n instead of 0.

    ``compat`` reads only the last digit of the name, so round 10 counts as round 0.
    """
    if compat:
        return prompt_schedule(F.substring(output_dir, -1, 1).cast("int"), n_sets)
    return prompt_schedule(iteration_of(output_dir), n_sets)


def batch_assign(index: Column, per_device: int, accumulate: int = 1, processes: int = 1) -> Column:
    """Number of the batch a row position falls into."""
    return quotient(index, per_device * accumulate * processes)
