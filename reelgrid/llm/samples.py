"""Bounded, repeatable samples of labelled rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(key: str, parts: int) -> Column:
    """crc32 of the key as text modulo ``parts``; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % parts


def thin(rows: DataFrame, key: str, about: int, seed: int) -> DataFrame:
    """``rows`` when there are at most ``about``, else the share of them whose key
    hashes low, which leaves about so many; the same ones on every run."""
    n = rows.count()
    if n <= about:
        return rows
    return rows.where(F.xxhash64(F.lit(seed), F.col(key)) < F.lit(int(-(1 << 63) + (1 << 64) * (about / n))))
