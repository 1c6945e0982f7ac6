"""Keyed tokens and masks for personal data."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DEFAULT_KEY = "demo-key-not-for-production"


def secret_key() -> bytes:
    return os.environ.get("QUARRYSTONE_TOKEN_KEY", DEFAULT_KEY).encode()


def pads(key: bytes) -> tuple[bytes, bytes]:
    """Inner and outer pad of HMAC-SHA256."""
    import hashlib

    key = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key), bytes(b ^ 0x5C for b in key)


def token(value: Column, kind: str, key: bytes | None = None) -> Column:
    """tok_ and 24 hex digits of HMAC-SHA256(key, kind:value); null stays null.  Two nested sha2 calls, no UDF."""
    inner, outer = (F.unhex(F.lit(p.hex())) for p in pads(secret_key() if key is None else key))
    message = F.concat(F.lit(f"{kind}:"), value).cast("binary")
    digest = F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message), 256))), 256)
    return F.concat(F.lit("tok_"), F.substring(digest, 1, 24))


def mask_phone(p: Column) -> Column:
    return F.concat(F.substring(p, 1, 3), F.repeat(F.lit("*"), F.greatest(F.length(p) - 7, F.lit(0))), F.right(p, F.lit(4)))


def mask_email(e: Column) -> Column:
    first = F.concat(F.substring(e, 1, 1), F.lit("***"))
    return F.when(F.contains(e, F.lit("@")), F.concat(first, F.lit("@"), F.substring_index(e, "@", -1))).otherwise(first)


def mask_bank(b: Column) -> Column:
    return F.concat(F.lit("****"), F.right(b, F.lit(4)))


def leaking_columns(df: DataFrame, vault: DataFrame, least: int = 6) -> DataFrame:
    """(column, n): string columns of df that contain raw values of the vault of `least` characters or more."""
    text = [n for n, t in df.dtypes if t == "string"]
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(n).alias("column"), F.col(n).alias("value")) for n in text])).alias("x")).select("x.*")
    raw = vault.where(F.length("raw_value") >= least).select(F.col("raw_value").alias("value")).distinct()
    return cells.join(raw, "value", "left_semi").groupBy("column").agg(F.count("*").alias("n"))
