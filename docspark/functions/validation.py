"""Checks of names, ids and documents on ingest, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: what names of collections and ids of records may be
COLLECTION = r"^[A-Za-z][A-Za-z0-9_:-]{0,63}$"
RECORD_ID = r"^[A-Za-z0-9][A-Za-z0-9_.:-]{0,127}$"


def is_collection_name(name: Column) -> Column:
    return F.coalesce(name.rlike(COLLECTION), F.lit(False))


def is_record_id(record_id: Column) -> Column:
    return F.coalesce(record_id.rlike(RECORD_ID), F.lit(False))


def is_document(doc: Column) -> Column:
    """Whether the text is one JSON object; JSON has no numbers that are not finite."""
    kind = F.schema_of_variant(F.try_parse_json(doc))
    return F.coalesce(kind.startswith("OBJECT"), F.lit(False))


def faults(records: DataFrame, id_col: str = "id", doc_col: str = "doc") -> DataFrame:
    """The rows that may not be stored, with ``fault``: what is wrong first."""
    fault = F.when(~is_record_id(F.col(id_col)), "invalid record id").when(~is_document(F.col(doc_col)), "not a JSON object")
    return records.withColumn("fault", fault).where(F.col("fault").isNotNull())


def checked(records: DataFrame, id_col: str = "id", doc_col: str = "doc") -> DataFrame:
    """``records``; one that may not be stored fails the job."""
    bad = F.raise_error(F.concat(F.lit("may not be stored: "), F.coalesce(F.col(id_col), F.lit("null"))))
    fine = is_record_id(F.col(id_col)) & is_document(F.col(doc_col))
    return records.withColumn(id_col, F.when(fine, F.col(id_col)).otherwise(bad.cast("string")))
