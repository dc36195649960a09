"""Change-log replay: committed transactions only, the last write of a record wins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def committed(frames: DataFrame) -> DataFrame:
    """The operations of committed transactions, with their place (``commit_seq``, ``seq``).

    ``frames``: seq, tx, type (begin, operation or commit) and the operation's
    columns. An operation counts if the nearest control frame of its
    transaction before it is a begin, and the nearest after it a commit.
    """
    order = Window.partitionBy("tx").orderBy("seq")
    control = F.when(F.col("type") != "operation", F.col("type"))
    at = F.when(F.col("type") != "operation", F.col("seq"))
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    after = order.rowsBetween(1, Window.unboundedFollowing)
    placed = frames.select(
        "*",
        F.last(control, True).over(before).alias("_before"),
        F.first(control, True).over(after).alias("_after"),
        F.first(at, True).over(after).alias("commit_seq"),
    )
    keep = (F.col("type") == "operation") & (F.col("_before") == "begin") & (F.col("_after") == "commit")
    return placed.where(keep).drop("_before", "_after", "type")


def live(ops: DataFrame, place: list[str] | None = None) -> DataFrame:
    """The records that the operations leave: (collection, id, doc).

    ``ops``: op (put, delete or drop), collection, id, doc and the columns of
    ``place``, which order them. Each record's last operation is found by an
    aggregate, which combines before the shuffle, so a record with most of
    the log is no burden; a drop removes what its collection had before it.
    Replaying a log twice changes nothing.
    """
    at = F.struct(*(place or ["commit_seq", "seq"]))
    drops = ops.where("op = 'drop'").groupBy("collection").agg(F.max(at).alias("dropped"))
    last = (
        ops.where("op in ('put', 'delete')")
        .groupBy("collection", "id")
        .agg(F.max_by(F.struct("op", "doc"), at).alias("last"), F.max(at).alias("at"))
    )
    kept = last.join(drops, "collection", "left").where("last.op = 'put' and (dropped is null or at > dropped)")
    return kept.select("collection", "id", F.col("last.doc").alias("doc"))
