"""Change logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.snapshots import LOG_SCHEMA


def changes(spark: SparkSession, path: str) -> DataFrame:
    """The log's batches as they arrive."""
    return spark.readStream.schema(LOG_SCHEMA).parquet(path)


def latest(ops: DataFrame) -> DataFrame:
    """The last operation of each record so far, as a streaming aggregate (update or complete mode).

    Its state is one row per record. Operations may come late or twice: their
    own ``seq`` decides, so replay is safe.
    """
    return ops.where("op in ('put', 'delete')").groupBy("collection", "id").agg(
        F.max_by(F.struct("op", "doc"), "seq").alias("last"), F.max("seq").alias("seq")
    )


def event_counts(events: DataFrame, time: str, kind: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts by tumbling window and kind; windows close when the watermark passes them."""
    return events.withWatermark(time, late).groupBy(F.window(time, window).alias("window"), kind).agg(
        F.count("*").alias("n")
    )
