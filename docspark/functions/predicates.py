"""Conditions on typed columns: two-valued logic, a missing value being SQL NULL.

All values stand in one order of classes: missing, negative number, string,
array, object, non-negative number, false, null, true. Inside a class numbers
compare as numbers, strings by Unicode collation, arrays and objects by their
JSON text. Equality is strict on type and binary on text, and does not tell a
missing value from null. As the types of column and literal are known when the
plan is made, comparisons across classes fold to constants or to sign tests.
"""

from __future__ import annotations

import datetime
import decimal
import json

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

OPERATORS = ("=", "==", "!=", ">", ">=", "<", "<=", "contains", "startsWith", "endsWith", "in")
NEGATIVE, STRING, ARRAY, OBJECT, POSITIVE, FALSE, NULL, TRUE = range(1, 9)


def resolve(schema: T.StructType, path: str) -> tuple[Column, T.DataType | None]:
    """The column at a dotted path; a path through anything but structs is missing everywhere."""
    column, kind = None, schema
    for part in path.split("."):
        field = next((f for f in kind.fields if f.name == part), None) if isinstance(kind, T.StructType) else None
        if field is None:
            return F.lit(None), None
        column = F.col(f"`{part}`") if column is None else column.getField(part)
        kind = field.dataType
    return column, kind


def class_of_type(kind: T.DataType | None) -> str:
    if kind is None or isinstance(kind, T.NullType):
        return "missing"
    if isinstance(kind, T.NumericType):
        return "number"
    if isinstance(kind, T.BooleanType):
        return "boolean"
    if isinstance(kind, T.ArrayType):
        return "array"
    if isinstance(kind, (T.StructType, T.MapType)):
        return "object"
    return "string" if isinstance(kind, T.StringType) else "native"


def class_of_value(value: object) -> str:
    if value is None:
        return "null"
    if isinstance(value, bool):
        return "boolean"
    if isinstance(value, (int, float, decimal.Decimal)):
        if value != value or value in (float("inf"), float("-inf")):
            raise ValueError("numbers must be finite")
        return "number"
    if isinstance(value, str):
        return "string"
    if isinstance(value, (list, tuple)):
        return "array"
    return "object" if isinstance(value, dict) else "native"


def rank_of_value(value: object) -> int:
    kind = class_of_value(value)
    if kind == "number":
        return NEGATIVE if value < 0 else POSITIVE
    if kind == "boolean":
        return TRUE if value else FALSE
    return {"string": STRING, "native": STRING, "array": ARRAY, "object": OBJECT, "null": NULL}[kind]


def _is_moment(value: object) -> bool:
    """Whether a date or timestamp column can be compared with the value as such: a date, or text that Spark casts."""
    return isinstance(value, (str, datetime.date, datetime.datetime, bytes))


def compact_json(value: object) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def collated(text: Column) -> Column:
    return F.collate(text, "UNICODE")


def _equal(x: Column, kind: str, value: object) -> Column:
    if value is None:
        return x.isNull()
    if kind == "native":
        return x.eqNullSafe(F.lit(value)) if _is_moment(value) else F.lit(False)
    if kind != class_of_value(value):
        return F.lit(False)
    if kind in ("array", "object"):
        return F.to_json(x).eqNullSafe(F.lit(compact_json(value)))
    return x.eqNullSafe(F.lit(value))


def _compare(x: Column, kind: str, op: str, value: object) -> Column:
    below = op in ("<", "<=")

    def plain(left: Column, right: Column) -> Column:
        return {"<": left < right, "<=": left <= right, ">": left > right, ">=": left >= right}[op]

    if kind == "missing":
        return F.lit(below)
    if kind == class_of_value(value) or (kind == "native" and _is_moment(value)):
        if kind == "string":
            found = plain(collated(x), collated(F.lit(value)))
        elif kind in ("array", "object"):
            found = plain(collated(F.to_json(x)), collated(F.lit(compact_json(value))))
        else:
            found = plain(x, F.lit(value))
    else:
        rank = rank_of_value(value)

        def holds(own: int) -> bool:
            return own < rank if below else own > rank

        parts = {
            "number": [(x < 0, NEGATIVE), (x >= 0, POSITIVE)],
            "boolean": [(~x, FALSE), (x, TRUE)],
            "string": [(x.isNotNull(), STRING)],
            "native": [(x.isNotNull(), STRING)],  # dates stand as their text does
            "array": [(x.isNotNull(), ARRAY)],
            "object": [(x.isNotNull(), OBJECT)],
        }[kind]
        true = [test for test, own in parts if holds(own)]
        if len(true) == len(parts):
            found = F.lit(True) if below else x.isNotNull()
        else:
            found = true[0] if true else F.lit(False)
    return (x.isNull() | found) if below else found


def _contains(x: Column, kind: str, data_type: T.DataType | None, value: object) -> Column:
    if kind == "string" and isinstance(value, str):
        return x.contains(value)
    if kind == "array":
        element = class_of_type(data_type.elementType)
        return F.exists(x, lambda e: _equal(e, element, value))
    return F.lit(False)


def predicate(schema: T.StructType, path: str, op: str, value: object, projected: bool = False) -> Column:
    """A condition as a Column.

    As a filter it stays bare, so that it reaches the scan; where its value is
    shown or negated, ask for ``projected``, which turns NULL into false.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown operator {op!r}")
    x, data_type = resolve(schema, path)
    kind = class_of_type(data_type)
    if op in ("=", "=="):
        out = _equal(x, kind, value)
    elif op == "!=":
        out = ~_equal(x, kind, value)
    elif op in ("<", "<=", ">", ">="):
        out = _compare(x, kind, op, value)
    elif op == "contains":
        out = _contains(x, kind, data_type, value)
    elif op in ("startsWith", "endsWith"):
        fits = kind == "string" and isinstance(value, str)
        out = (x.startswith(value) if op == "startsWith" else x.endswith(value)) if fits else F.lit(False)
    elif not isinstance(value, (list, tuple)):
        out = F.lit(False)
    else:
        fits = _is_moment if kind == "native" else lambda v: class_of_value(v) == kind
        own = [v for v in value if v is not None and fits(v)]
        if kind in ("array", "object"):
            out = F.to_json(x).isin([compact_json(v) for v in own]) if own else F.lit(False)
        else:
            out = x.isin(own) if own else F.lit(False)
        if None in value:
            out = x.isNull() | out
    return F.coalesce(out, F.lit(False)) if projected else out
