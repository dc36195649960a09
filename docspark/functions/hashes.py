"""Checksums of UTF-8 text as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# fixed values of the 32-bit FNV-1a hash
FNV_OFFSET, FNV_PRIME = 0x811C9DC5, 0x01000193


def fnv1a32(text: Column) -> Column:
    """Unsigned 32-bit FNV-1a; use it for keys, not for whole documents (it folds byte by byte)."""
    hexed = F.hex(F.encode(text, "UTF-8"))
    places = F.when(F.length(hexed) > 0, F.sequence(F.lit(1), F.length(hexed), F.lit(2))).otherwise(
        F.array().cast("array<int>")
    )
    octets = F.transform(places, lambda i: F.conv(F.substring(hexed, i, F.lit(2)), 16, 10).cast("long"))
    step = lambda h, b: (h.bitwiseXOR(b) * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF))
    return F.aggregate(octets, F.lit(FNV_OFFSET).cast("long"), step)


def crc32(text: Column) -> Column:
    return F.crc32(text)
