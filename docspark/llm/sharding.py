"""Operator 2: contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import pick, written


def assign_shards(
    docs: DataFrame, n_shards: int = 8, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Cut the documents, in order of their id, into ``n_shards`` runs of near equal bytes.

    Law ``bytes``: a document's size is its UTF-8 bytes plus one; its shard is
    the ``n_shards``-th of the total in which its middle byte falls, so each
    shard's bytes differ from the target by at most one document.

    Only (id, size, crc32) is shuffled, by range. Each range partition is
    summed; the prefix sum over these totals (one row per partition) places
    every partition, a running sum inside it places every row.

    Nulls: a null text has 0 bytes and the crc32 of the empty string; null ids
    come first. Repeated rows are placed one by one. An empty table gives no
    rows. Other columns are ignored.

    Returns doc_id, size, text_crc32, law, shard, slot, grown_shard (null).
    """
    if n_shards < 1:
        raise ValueError("n_shards must be positive")
    order = ["doc_id", "text_crc32", "size"]
    rows = pick(docs, doc_id=id_col, text=text_col).select(
        "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1).alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
    )
    ranged = written(
        rows.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn("part", F.spark_partition_id()),
        "shard_rows",
    )
    up_to = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    all_parts = Window.partitionBy()
    offsets = (
        ranged.groupBy("part")
        .agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
        .select(
            "part",
            (F.sum("bytes").over(up_to) - F.col("bytes")).alias("bytes_before"),
            (F.sum("rows").over(up_to) - F.col("rows")).alias("rows_before"),
            F.sum("bytes").over(all_parts).alias("total"),
        )
    )
    inside = Window.partitionBy("part").orderBy(*order)
    running = inside.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = ranged.join(F.broadcast(offsets), "part").select(  # one row per range partition
        *order,
        (F.col("rows_before") + F.row_number().over(inside) - 1).alias("nth"),
        (F.col("bytes_before") + F.sum("size").over(running)).alias("end"),
        "total",
    )
    middle = 2 * F.col("end") - F.col("size")
    placed = placed.withColumn(
        "shard",
        F.least(F.lit(n_shards - 1), F.floor(middle * n_shards / (2 * F.col("total")))).cast("int"),
    )
    firsts = placed.groupBy("shard").agg(F.min("nth").alias("first"))  # n_shards rows
    return placed.join(F.broadcast(firsts), "shard").select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("nth") - F.col("first")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
