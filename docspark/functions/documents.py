"""Document mode: conditions and sort keys on paths into JSON text.

A path's value is reduced to a key (rank, number, text): the rank of its class,
see ``predicates``, its number, and its text (the string itself, or the JSON
text of an array or object, which keeps the order of keys).
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .predicates import (
    ARRAY,
    FALSE,
    NEGATIVE,
    NULL,
    OBJECT,
    POSITIVE,
    STRING,
    TRUE,
    class_of_value,
    collated,
    compact_json,
    rank_of_value,
)


def _json_path(path: str) -> str:
    # fixed value: what a field path may be
    if not re.fullmatch(r"[A-Za-z_][A-Za-z0-9_.-]{0,127}", path):
        raise ValueError(f"invalid field path {path!r}")
    return "$" + "".join(f'["{part}"]' for part in path.split("."))


def rank(doc: Column, path: str) -> Column:
    """The rank of the value's class; 0 (missing) where there is none or the document is not JSON."""
    kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(doc), _json_path(path), "variant"))
    text = F.get_json_object(doc, "$." + path)
    number = F.when(text.cast("double") < 0, NEGATIVE).otherwise(POSITIVE)
    return (
        F.when(kind.isNull(), 0)
        .when(kind == "VOID", NULL)
        .when(kind == "BOOLEAN", F.when(text == "true", TRUE).otherwise(FALSE))
        .when(kind == "STRING", STRING)
        .when(kind.startswith("ARRAY"), ARRAY)
        .when(kind.startswith("OBJECT"), OBJECT)
        .otherwise(number)
    )


def key(doc: Column, path: str) -> tuple[Column, Column, Column]:
    """(rank, number, text) of the value at ``path``."""
    own, text = rank(doc, path), F.get_json_object(doc, "$." + path)
    number = F.when(own.isin(NEGATIVE, POSITIVE), text.cast("double"))
    return own, number, F.when(own.isin(STRING, ARRAY, OBJECT), text)


def order(doc: Column, path: str, descending: bool = False) -> list[Column]:
    """Sort columns for a path; ties are left to the caller's last key."""
    own, number, text = key(doc, path)
    parts = [own, number, collated(text)]
    return [p.desc_nulls_last() if descending else p.asc_nulls_first() for p in parts]


def doc_predicate(doc: Column, path: str, op: str, value: object) -> Column:
    own, number, text = key(doc, path)

    def equal(v: object) -> Column:
        kind, r = class_of_value(v), rank_of_value(v)
        if kind == "null":
            return own.isin(0, NULL)
        if kind == "boolean":
            return own == r
        if kind == "number":
            return own.isin(NEGATIVE, POSITIVE) & (number == float(v))
        return (own == r) & (text == (v if kind == "string" else compact_json(v)))

    if op in ("=", "=="):
        return F.coalesce(equal(value), F.lit(False))
    if op == "!=":
        return ~F.coalesce(equal(value), F.lit(False))
    if op == "in":
        out = F.lit(False)
        for v in value if isinstance(value, (list, tuple)) else ():
            out |= F.coalesce(equal(v), F.lit(False))
        return out
    if op in ("contains", "startsWith", "endsWith"):
        if not isinstance(value, str) and op != "contains":
            return F.lit(False)
        inside = F.lit(False)
        if isinstance(value, str):
            found = {"contains": F.contains, "startsWith": F.startswith, "endsWith": F.endswith}[op](text, F.lit(value))
            inside = (own == STRING) & found
        if op == "contains":
            items = F.from_json(F.when(own == ARRAY, text), "array<variant>")
            member = F.exists(items, lambda e: F.to_json(e) == compact_json(value))
            inside |= F.coalesce(member, F.lit(False))
        return F.coalesce(inside, F.lit(False))
    r, kind = rank_of_value(value), class_of_value(value)
    if kind == "number":
        left, right = number, F.lit(float(value))
    elif kind in ("string", "array", "object"):
        left, right = collated(text), collated(F.lit(value if kind == "string" else compact_json(value)))
    else:
        left = right = F.lit(0)
    less, more = (own < r) | ((own == r) & (left < right)), (own > r) | ((own == r) & (left > right))
    same = (own == r) & (left == right)
    out = {"<": less, "<=": less | same, ">": more, ">=": more | same}[op]
    return F.coalesce(out, F.lit(False))
