"""Keyed hashes: stable seeds, and train/validation assignment by position."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def stable_seed(*parts: object) -> int:
    """64 bits from any parts: BLAKE2b of their texts, colon-joined, read big-endian."""
    return int.from_bytes(hashlib.blake2b(":".join(map(str, parts)).encode(), digest_size=8).digest(), "big")


def _unit_interval(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: int.from_bytes(hashlib.blake2b(k.encode(), digest_size=8).digest(), "big") / 2**64)


def blake2b_share(source: Column, index: Column, seed: int) -> Column:
    """A number in [0, 1) fixed by seed, source and document index (Arrow-batched UDF)."""
    key = F.concat_ws(":", F.lit(str(seed)), source, index.cast("string"))
    return F.pandas_udf(_unit_interval, "double")(key)


def md5_share(source: Column, index: Column, seed: int) -> Column:
    """The same idea with the first 32 bits of MD5: inside generated code, portable to any SQL."""
    key = F.concat_ws(":", F.lit(str(seed)), source, index.cast("string"))
    return F.conv(F.substring(F.md5(key.cast("binary")), 1, 8), 16, 10).cast("double") / 2.0**32


def split_name(share: Column, fraction: float) -> Column:
    return F.when(share < fraction, "val").otherwise("train")
