"""Record writes as set operations: each takes the collection and a batch, and returns the new collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

STAMPS = ("createdAt", "updatedAt")


def get(records: DataFrame, record_id: object, key: str = "id") -> DataFrame:
    """The record with this id, or no row; the condition reaches the scan."""
    return records.where(F.col(key) == F.lit(record_id)).limit(1)


def insert(records: DataFrame, new: DataFrame, now: Column | None = None, key: str = "id") -> DataFrame:
    """Add records; a row whose id exists already, or comes twice, fails the job."""
    stamped = _stamped(new, now, created=True) if now is not None else new
    both = records.select(key).withColumn("_new", F.lit(0)).unionByName(new.select(key).withColumn("_new", F.lit(1)))
    clash = both.groupBy(key).agg(F.sum("_new").alias("n"), F.count("*").alias("all")).where("n > 0 and `all` > 1")
    return records.unionByName(stamped.join(clash.select(key, F.lit(True).alias("_clash")), key, "left").select(
        F.when(F.col("_clash"), F.raise_error(F.concat(F.lit("record exists: "), F.col(key).cast("string"))))
        .otherwise(F.col(key)).cast(stamped.schema[key].dataType).alias(key),
        *[c for c in stamped.columns if c != key],
    ).select(*records.columns))


def _once(new: DataFrame, key: str) -> DataFrame:
    """``new``; an id that comes twice in it fails the job, as the batch has no order that could decide."""
    twice = new.groupBy(key).agg(F.count("*").alias("_n")).where("_n > 1")
    said = F.raise_error(F.concat(F.lit("id twice in one batch: "), F.col(key).cast("string")))
    checked = F.when(F.col("_n").isNotNull(), said.cast(new.schema[key].dataType)).otherwise(F.col(key))
    return new.join(twice, key, "left").withColumn(key, checked).drop("_n")


def put(records: DataFrame, new: DataFrame, now: Column | None = None, key: str = "id") -> DataFrame:
    """Insert or replace whole records; a replaced record keeps its ``createdAt``. An id twice in ``new`` fails."""
    new = _once(new, key)
    fresh = _stamped(new, now, created=True) if now is not None else new
    if "createdAt" in records.columns:
        old = records.select(key, F.col("createdAt").alias("_created"))
        fresh = fresh.join(old, key, "left").withColumn("createdAt", F.coalesce("_created", "createdAt")).drop("_created")
    kept = records.join(new.select(key), key, "left_anti")
    return kept.unionByName(fresh.select(*records.columns))


def update(records: DataFrame, patch: DataFrame, now: Column | None = None, key: str = "id") -> DataFrame:
    """Shallow merge. ``patch`` has the key, ``present`` (array of the names it sets) and new values.

    A name in ``present`` is set, to null as well; other columns stay. The id
    and the stamps cannot be set. A patch of a missing record, or two of one
    record, fail the job.
    """
    patch = _once(patch, key)
    names = [c for c in patch.columns if c not in (key, "present", *STAMPS)]
    news = patch.select(F.col(key).alias("_id"), "present", *[F.col(c).alias(f"_new_{c}") for c in names])
    joined = records.join(news, F.col(key) == F.col("_id"), "full")
    columns = []
    for c in records.columns:
        value = F.col(c)
        if c == key:
            missing = F.raise_error(F.concat(F.lit("no record: "), F.col("_id").cast("string")))
            value = F.when(F.col(key).isNull(), missing.cast(records.schema[key].dataType)).otherwise(value)
        elif c in names:
            value = F.when(F.array_contains("present", c), F.col(f"_new_{c}")).otherwise(value)
        elif c == "updatedAt" and now is not None:
            value = F.when(F.col("_id").isNotNull(), now).otherwise(value)
        columns.append(value.alias(c))
    return joined.select(*columns)


def with_ids(new: DataFrame, key: str = "id") -> DataFrame:
    """``new`` with a random id wherever it has none; write it before it is used twice."""
    given = F.col(key).cast("string") if key in new.columns else F.lit(None).cast("string")
    return new.withColumn(key, F.coalesce(given, F.expr("uuid()")))


def delete(records: DataFrame, ids: DataFrame, key: str = "id") -> DataFrame:
    return records.join(ids.select(key), key, "left_anti")


def _stamped(rows: DataFrame, now: Column, created: bool) -> DataFrame:
    out = rows.withColumn("updatedAt", now)
    return out.withColumn("createdAt", now) if created else out
