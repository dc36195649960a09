"""Conditions on decimal and time columns, and on documents that are not JSON."""

from __future__ import annotations

import datetime
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from docspark.functions import documents
from docspark.functions.predicates import predicate


def ids(df, *test):
    return sorted(r.id for r in df.where(predicate(df.schema, *test)).collect())


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [(">", Decimal("5"), [2]), ("==", Decimal("9.00"), [2]), ("in", [Decimal("1"), 9], [1, 2]), ("<", 5, [1, 3]), (">", "s", [1, 2]), ("!=", Decimal(1), [2, 3])],
)
def test_decimals_are_numbers(spark, op, value, expected):
    df = spark.createDataFrame([(1, Decimal("1.00")), (2, Decimal("9.00")), (3, None)], "id int, x decimal(10,2)")
    assert ids(df, "x", op, value) == expected


TIME = datetime.datetime(2020, 1, 1)


@pytest.mark.parametrize(
    ("op", "value", "expected"),
    [("<", None, [1, 2, 3]), (">", None, []), ("<", 5, [1, 2, 3]), (">", 5, []), (">", -5, [1, 2]), ("<", -5, [3]), ("==", 5, []), ("!=", 5, [1, 2, 3]),
     (">", TIME, [2]), ("<=", "2020-01-01", [1, 3]), ("in", ["2020-01-01 00:00:00", None], [1, 3]), ("in", [TIME, 4], [1])],
)
def test_times_have_a_place_in_the_order_of_classes(spark, op, value, expected):
    rows = [(1, TIME), (2, TIME + datetime.timedelta(days=1)), (3, None)]
    assert ids(spark.createDataFrame(rows, "id int, x timestamp"), "x", op, value) == expected


def test_a_malformed_document_has_nothing_at_any_path(spark):
    df = spark.createDataFrame([(1, '{"k": 5}'), (2, '{"k": '), (3, ""), (4, None)], "id int, doc string")
    for op, value, expected in ((">", 1, [1]), ("==", None, [2, 3, 4]), ("<", 9, [1, 2, 3, 4])):
        rows = df.where(documents.doc_predicate(F.col("doc"), "k", op, value)).collect()
        assert sorted(r.id for r in rows) == expected
