"""Encryption at rest of payload columns: AES-256 in GCM, keys from passwords by scrypt."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Cost settings of scrypt, kept beside the data with the salt.
SCRYPT = {"n": 16384, "r": 8, "p": 1}
LEAST_PASSWORD = 16


def derive_key(password: str, salt: bytes) -> bytes:
    if len(password) < LEAST_PASSWORD:
        raise ValueError(f"a password needs {LEAST_PASSWORD} characters")
    return hashlib.scrypt(password.encode(), salt=salt, dklen=32, **SCRYPT)


def _secret(rows: DataFrame, key: bytes) -> DataFrame:
    """The key as a one-row table, so that it is no literal in plans and logs."""
    return rows.crossJoin(F.broadcast(rows.sparkSession.createDataFrame([(key,)], "_key binary")))


def seal(rows: DataFrame, columns: list[str], key: bytes, about: str = "") -> DataFrame:
    """``columns`` (text) become sealed binary; each value gets a fresh nonce; ``about`` is authenticated, too."""
    out = _secret(rows, key)
    for c in columns:
        sealed: Column = F.aes_encrypt(F.col(c), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(b""), F.lit(about.encode()))
        out = out.withColumn(c, sealed)
    return out.drop("_key")


def unseal(rows: DataFrame, columns: list[str], key: bytes, about: str = "") -> DataFrame:
    """The text again; a wrong key, another ``about`` or a changed byte fails the job."""
    out = _secret(rows, key)
    for c in columns:
        text = F.aes_decrypt(F.col(c), F.col("_key"), F.lit("GCM"), F.lit("DEFAULT"), F.lit(about.encode()))
        out = out.withColumn(c, text.cast("string"))
    return out.drop("_key")


def rotate(rows: DataFrame, columns: list[str], old: bytes, new: bytes, about: str = "") -> DataFrame:
    return seal(unseal(rows, columns, old, about), columns, new, about)
