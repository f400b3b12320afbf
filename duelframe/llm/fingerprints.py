"""Document fingerprints: one-permutation MinHash in column expressions.

Every shingle is hashed once. The leading bits of the hash name its bin, the rest is its
rank there, and each bin keeps its least rank. A bin without a shingle takes over the rank
of another one, chosen by a random walk over bins that depends only on the empty bin and
ends at the first filled one (optimal densification). Of each rank the low ``BITS`` bits
are kept, 16 bins to a long. Two bins that differ still agree in those bits with
probability ``2 ** -BITS``; the likeness is corrected for that.

Intermediate arrays are columns used more than once, so the optimizer keeps each as a step
of its own and no lambda computes one anew for every element.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from duelframe.indexing import index_rows
from duelframe.llm.names import unused

SHINGLE_WORDS = 5
BINS = 256
BITS = 4
_RANK_BITS = 55  # hashes have 63 bits, the leading 8 name the bin
_EMPTY_RANK = (1 << _RANK_BITS) - 1
_PER_LONG = 64 // BITS
# Steps of the walk written out; only a walk longer than that is computed for all bins.
_STEPS = 8
_LOW_OF_EACH = 0x1111111111111111


def _rank(value: Column) -> Column:
    return value.bitwiseAND(F.lit(_EMPTY_RANK))


def _bin(value: Column) -> Column:
    return F.shiftright(value, _RANK_BITS)


def _walk(empty_bin: Column, ranks: str) -> Column:
    """Rank of the first filled bin on the walk from ``empty_bin``; null when all are empty."""
    steps = [F.get(ranks, F.pmod(F.xxhash64(empty_bin, F.lit(step)), F.lit(BINS)).cast("int")) for step in range(_STEPS)]
    # Behind those steps the walk goes through the bins in a random order of its own.
    rest = F.array_min(
        F.filter(
            F.transform(ranks, lambda rank, b: F.when(rank.isNotNull(), F.struct(F.xxhash64(empty_bin, b, F.lit("order")), rank.alias("rank")))),
            lambda x: x.isNotNull(),
        )
    )["rank"]
    return F.coalesce(*steps, rest)


def add_fingerprint(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``, an array of 16 longs, or an empty array for a text without words.

    Shingles are five consecutive lower-cased words; fewer words are one shingle. Equal
    texts have equal fingerprints. A null text counts as empty.
    """
    words_col, sorted_col, ranks_col, dense_col = (unused(df, name) for name in ("_words", "_sorted", "_ranks", "_dense"))
    text = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    words = F.array_remove(F.split(text, "[\\x20\\x09-\\x0D]+"), "")
    step = df.withColumn(words_col, F.transform(words, lambda w: F.xxhash64(w)))
    positive = lambda h: F.shiftrightunsigned(h, 1)
    count = F.size(words_col)
    shingles = (
        F.when(
            count >= SHINGLE_WORDS,
            F.transform(
                F.slice(words_col, F.lit(1), count - (SHINGLE_WORDS - 1)),
                lambda w, i: positive(F.xxhash64(w, *[F.get(words_col, i + j) for j in range(1, SHINGLE_WORDS)])),
            ),
        )
        .when(count > 0, F.array(positive(F.xxhash64(words_col))))
        .otherwise(F.expr("CAST(array() AS array<bigint>)"))
    )
    # One value above all ranks for each bin: after sorting, the first value of a bin is its
    # least rank or that mark.
    marks = F.array(*[F.lit((b << _RANK_BITS) | _EMPTY_RANK) for b in range(BINS)])
    step = step.withColumn(sorted_col, F.sort_array(F.concat(shingles, marks)))
    first = F.filter(sorted_col, lambda v, i: (i == 0) | (_bin(v) != _bin(F.get(sorted_col, i - 1))))
    step = step.withColumn(ranks_col, F.transform(first, lambda v: F.when(_rank(v) != _EMPTY_RANK, _rank(v))))
    # A rank is hashed with its bin, so that a rank taken over by many bins does not bring the
    # same low bits to all of them.
    step = step.withColumn(dense_col, F.transform(ranks_col, lambda rank, b: F.xxhash64(F.coalesce(rank, _walk(b, ranks_col)), b)))
    packed = F.transform(
        F.sequence(F.lit(0), F.lit(BINS // _PER_LONG - 1)),
        lambda g: F.aggregate(
            F.slice(dense_col, g * _PER_LONG + 1, F.lit(_PER_LONG)),
            F.lit(0).cast("long"),
            lambda acc, rank: F.shiftleft(acc, BITS).bitwiseOR(rank.bitwiseAND(F.lit((1 << BITS) - 1))),
        ),
    )
    empty = F.expr("CAST(array() AS array<bigint>)")
    value = F.when((F.size(words_col) > 0) & (F.size(dense_col) > 0), packed).otherwise(empty)
    # Given out as the one element of an array: a later filter on the result then stays above
    # this step, instead of being rewritten in terms of the texts, lambda by lambda.
    kept = [column for column in df.columns if column != out]
    return step.select(*kept, F.explode(F.array(value)).alias(out))


def likeness(left: str, right: str) -> Column:
    """Estimated Jaccard similarity of two fingerprints, from 0 to 1.

    Two texts without words are alike (1), one without and one with words are not (0).
    """
    differing = F.aggregate(
        F.zip_with(left, right, _differing_bins),
        F.lit(0),
        lambda acc, n: acc + F.coalesce(n, F.lit(0)),
    )
    chance = 2.0**-BITS
    corrected = ((1 - differing / BINS) - chance) / (1 - chance)
    both, one = (F.size(left) == 0) & (F.size(right) == 0), (F.size(left) == 0) | (F.size(right) == 0)
    return F.when(both, 1.0).when(one, 0.0).otherwise(F.greatest(F.lit(0.0), corrected))


def _differing_bins(left: Column, right: Column) -> Column:
    other = left.bitwiseXOR(right)
    any_bit = other
    for shift in range(1, BITS):
        any_bit = any_bit.bitwiseOR(F.shiftrightunsigned(other, shift))
    return F.bit_count(any_bit.bitwiseAND(F.lit(_LOW_OF_EACH)))


def as_hex(fingerprint: str) -> Column:
    return F.lower(F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.hex(x), 16, "0")), ""))


def fingerprint(docs: DataFrame, text_col: str = "text", out: str = "fingerprint") -> DataFrame:
    """All columns of ``docs`` with the hexadecimal fingerprint as ``out``."""
    packed = unused(docs, "_packed")
    return add_fingerprint(docs, text_col, packed).withColumn(out, as_hex(packed)).drop(packed)


def edit_and_compare(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text, of its edited text, and of the next document.

    The edited text has its last ``floor(n_chars / 3)`` code points replaced by as many of
    the next document's first. Next is the next smaller ``doc_id``, after the smallest the
    greatest; a null id comes last of all. Every row gives a row; where rows share an id,
    the least of their texts stands for the id as the next document. Null texts are empty.

    Texts are shuffled once by id; from a next document only the part its predecessor
    needs travels on.
    """
    # The id travels inside the key, so that both uses of the texts share one shuffle.
    key = F.coalesce(F.concat(F.lit("#"), F.col("doc_id").cast("string")), F.lit(""))
    keyed = docs.select(F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("_key"))
    doc_id = F.when(F.col("_key") != "", F.substr("_key", F.lit(2))).cast(docs.schema["doc_id"].dataType).alias("doc_id")
    ids = keyed.groupBy("_key").agg(F.max(F.length("text")).alias("_most")).select("*", doc_id)
    placed = index_rows(ids, [F.col("doc_id").desc_nulls_last()], "_place")
    total = placed.count()
    following = placed.select((F.pmod(F.col("_place") - 1, F.lit(max(total, 1)))).alias("_place"), F.col("_key").alias("_next"))
    pairs = placed.select("_place", F.col("_key").alias("_previous"), "_most").join(following, "_place").drop("_place")

    texts = keyed.repartition("_key")
    standing = texts.groupBy("_key").agg(F.min("text").alias("text"))
    heads = standing.join(pairs, standing["_key"] == pairs["_next"]).drop("_key")
    heads = add_fingerprint(heads, "text", "_next_print").select(
        "_previous", "_next_print", F.substring("text", F.lit(1), F.floor(F.col("_most") / 3).cast("int")).alias("_head")
    )
    joined = texts.join(heads, texts["_key"] == heads["_previous"])
    length = F.length("text")
    third = F.floor(length / 3).cast("int")
    joined = joined.select(
        doc_id,
        "text",
        length.cast("long").alias("n_chars"),
        F.concat(F.substring("text", F.lit(1), length - third), F.substring("_head", F.lit(1), third)).alias("_edited"),
        "_next_print",
    )
    printed = add_fingerprint(joined.withColumn("edited_sha256", F.sha2(F.col("_edited"), 256)), "text", "_print").drop("text")
    printed = add_fingerprint(printed, "_edited", "_edited_print").drop("_edited")
    return printed.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex("_print").alias("fingerprint"),
        as_hex("_edited_print").alias("edited_fingerprint"),
        likeness("_print", "_edited_print").alias("near_edited"),
        likeness("_print", "_next_print").alias("near_next"),
    )
