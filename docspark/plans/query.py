"""Queries over one collection: filter, sort, skip, take and count, as DataFrame plans."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.predicates import class_of_type, collated, predicate, resolve


@dataclass(frozen=True)
class Query:
    """An immutable builder; every step returns a new one, ``find`` gives a lazy DataFrame.

    ``ties`` are the columns that decide between equal sort keys, ascending
    in either direction: the collection's own order, usually its key.
    """

    rows: DataFrame
    ties: tuple[str, ...] = ()
    conditions: tuple[tuple[str, str, object], ...] = ()
    order: tuple[str, bool] | None = None
    most: int | None = None
    skipped: int = 0
    columns: tuple[str, ...] = field(default=())

    def where(self, path: str, *test: object) -> Query:
        """``where(path, op, value)``, or ``where(path, value)`` for equality; all conditions must hold."""
        op, value = test if len(test) == 2 else ("==", *test)
        predicate(self.rows.schema, path, op, value)
        return replace(self, conditions=(*self.conditions, (path, op, value)))

    and_ = where

    def sort(self, path: str, direction: str = "asc") -> Query:
        if direction not in ("asc", "desc"):
            raise ValueError("direction must be asc or desc")
        return replace(self, order=(path, direction == "desc"))

    order_by = sort

    def take(self, n: int) -> Query:
        return replace(self, most=_count(n, "limit"))

    limit = take

    def skip(self, n: int) -> Query:
        return replace(self, skipped=_count(n, "offset"))

    offset = skip

    def select(self, *columns: str) -> Query:
        """Only these columns; pruned in the scan."""
        return replace(self, columns=columns)

    def matching(self) -> DataFrame:
        out = self.rows
        for path, op, value in self.conditions:
            out = out.where(predicate(self.rows.schema, path, op, value))
        return out

    def find(self) -> DataFrame:
        out = self.matching()
        if self.order:
            path, descending = self.order
            x, kind = resolve(self.rows.schema, path)
            key = collated(x) if class_of_type(kind) == "string" else x
            key = key.desc_nulls_last() if descending else key.asc_nulls_first()
            out = out.orderBy(key, *[F.col(c).asc_nulls_first() for c in self.ties])
        elif self.most is not None or self.skipped:
            out = out.orderBy(*[F.col(c).asc_nulls_first() for c in self.ties]) if self.ties else out
        if self.skipped:
            out = out.offset(self.skipped)
        if self.most is not None:
            out = out.limit(self.most)
        return out.select(*self.columns) if self.columns else out

    def first(self) -> DataFrame:
        return self.take(1).find()

    def count(self) -> DataFrame:
        """One row ``n``: all matches, whatever the limit and offset; reads only the conditions' columns."""
        return self.matching().agg(F.count("*").alias("n"))


def _count(n: object, name: str) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or n < 0:
        raise ValueError(f"{name} must be a whole number, 0 or more")
    return n
