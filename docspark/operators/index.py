"""Equality indexes as inverted tables, and what a query log says about hot lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import resolve


def build_index(records: DataFrame, path: str, key: str = "id") -> DataFrame:
    """(value, id) in buckets of the value: one row per record, never one list per value."""
    x, _ = resolve(records.schema, path)
    return records.select(x.alias("value"), F.col(key).alias("id")).repartition("value").sortWithinPartitions("value", "id")


def index_sizes(records: DataFrame, path: str, key: str = "id") -> DataFrame:
    x, _ = resolve(records.schema, path)
    return records.groupBy(x.alias("value")).agg(F.count("*").alias("n"), F.min(key).alias("first_id"))


def lookup(records: DataFrame, index: DataFrame, value: object, key: str = "id") -> DataFrame:
    """The records that the index lists under ``value``."""
    ids = index.where(F.col("value").eqNullSafe(F.lit(value))).select(F.col("id").alias(key))
    return records.join(ids, key, "left_semi")


def normal_query(collection: Column, field: Column, value: Column) -> Column:
    """``collection:field=value``, lower-cased and trimmed: one text for one equality lookup."""
    parts = [F.lower(F.trim(c)) for c in (collection, field, value)]
    return F.concat(parts[0], F.lit(":"), parts[1], F.lit("="), parts[2])


def hot_queries(log: DataFrame, query: str, least_hits: int = 3) -> DataFrame:
    """Lookups seen ``least_hits`` times or more: what is worth keeping cached."""
    return log.groupBy(query).agg(F.count("*").alias("hits")).where(F.col("hits") >= least_hits)
