"""Rows of a Spark query and of its SQL, as sorted lists that can be compared."""

from __future__ import annotations

import datetime
import decimal
import math
from pathlib import Path

import duckdb


def value(x):
    if isinstance(x, decimal.Decimal):
        x = float(x)
    if isinstance(x, float):
        return "nan" if math.isnan(x) else f"{x:.9g}"
    if isinstance(x, datetime.datetime):
        return x.replace(tzinfo=None).isoformat()
    if isinstance(x, list | tuple):
        return [value(y) for y in x]
    if isinstance(x, bool) or x is None:
        return str(x)
    if isinstance(x, int):
        return f"{float(x):.9g}" if abs(x) < 1 << 53 else str(x)
    return str(x)


def rows(columns: list[str], found) -> tuple[list[str], list[str]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(repr([value(r[i]) for i in order]) for r in found)


def of_spark(df):
    return rows(df.columns, [tuple(r) for r in df.collect()])


def of_sql(sql: str, sf_dir: str):
    con = duckdb.connect()
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    found = con.execute(sql)
    return rows([c[0] for c in found.description], found.fetchall())
