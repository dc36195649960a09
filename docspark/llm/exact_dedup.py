"""Operator 5: exact dedup behind a two-pass Bloom filter, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, pick, text_or_empty, written

BITS_PER_ROW = 16
#: The largest filter that is broadcast: 2**27 bits are 16 MB. Beyond it the
#: filter gets fuller and lets more rows pass to the shuffle; results stay exact.
MAX_BITS = 1 << 27
_BLOCK = 32768  # bits in a block of Spark's bitmap functions


def _filter_of_repeats(keys: DataFrame, position: Column) -> DataFrame:
    """Blocks of a bitmap of the positions that occur twice or more."""
    twice = keys.groupBy(position.alias("p")).count().where("count > 1")
    return twice.groupBy(F.bitmap_bucket_number(F.col("p") + 1).alias("block")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(F.col("p") + 1)).alias("bits")
    )


def _maybe_repeated(keys: DataFrame, position: Column, blocks: DataFrame) -> DataFrame:
    """``keys`` with ``hit``: the filter holds the row's position."""
    at = F.pmod(F.col("p"), F.lit(_BLOCK)).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10)
    bit = F.expr("p").isNotNull() & (
        F.floor(byte.cast("int") / F.pow(F.lit(2), at % 8)).cast("int") % 2 == 1
    )
    return (
        keys.withColumn("p", position)
        .withColumn("block", F.bitmap_bucket_number(F.col("p") + 1))
        .join(F.broadcast(blocks), "block", "left")  # MAX_BITS bounds it
        .withColumn("hit", F.coalesce(bit, F.lit(False)))
        .drop("p", "block", "bits")
    )


def exact_dedup(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    bits_per_row: int = BITS_PER_ROW,
    max_bits: int = MAX_BITS,
) -> DataFrame:
    """Groups of texts that are equal after lower-casing A-Z; the largest id stays.

    Pass one hashes each text's SHA-256 to a position and keeps a bitmap of the
    positions met twice; pass two does the same, with another hash, for the
    rows that pass one let through. Rows outside either bitmap are unique and
    go straight to the result; only the rest is shuffled by its SHA-256, so
    false positives cost a little shuffle and no correctness. Grouping combines
    on the map side, and the join back can be split by adaptive execution, so
    a group may hold any share of the rows.

    Nulls: a null text counts as the empty text; of equal texts a row with a
    null id stays only if there is no other. Of repeated rows with the same id
    one stays. An empty table gives no rows. Other columns are ignored.

    Returns doc_id, keep_id, group_size, kept, text_sha256.
    """
    keys = written(
        pick(docs, doc_id=id_col, text=text_col).select(
            F.monotonically_increasing_id().alias("row"),
            "doc_id",
            F.unhex(F.sha2(ascii_lower(text_or_empty("text")), 256)).alias("sha"),
        ),
        "dedup_keys",
    )
    bits = max(_BLOCK, min(max_bits, 1 << max(1, bits_per_row * keys.count() - 1).bit_length()))

    def position(seed: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(seed), F.col("sha")), F.lit(bits))

    first = _maybe_repeated(keys, position(1), _filter_of_repeats(keys, position(1)))
    first = first.withColumnRenamed("hit", "hit_1")
    survivors = first.where("hit_1").drop("hit_1")
    both = _maybe_repeated(first, position(2), _filter_of_repeats(survivors, position(2)))
    both = written(
        both.select("row", "doc_id", "sha", (F.col("hit_1") & F.col("hit")).alias("shuffles")),
        "dedup_marked",
    )
    maybe = both.where("shuffles")
    groups = written(
        maybe.groupBy("sha")
        .agg(
            F.max(F.struct("doc_id", "row")).alias("stays"),
            F.count("*").alias("group_size"),
        )
        .where("group_size > 1"),
        "dedup_groups",
    )
    sha = F.lower(F.hex("sha")).alias("text_sha256")
    alone = both.where("not shuffles").select(
        "doc_id",
        F.col("doc_id").alias("keep_id"),
        F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"),
        sha,
    )
    shuffled = maybe.join(groups, "sha", "left").select(
        "doc_id",
        F.when(F.col("stays").isNull(), F.col("doc_id")).otherwise(F.col("stays.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"),
        F.coalesce(F.col("stays.row") == F.col("row"), F.lit(True)).alias("kept"),
        sha,
    )
    return alone.unionByName(shuffled)
