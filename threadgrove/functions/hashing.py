"""Seeded hashes that give the same value in any SQL engine with md5."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

HASH_BITS = 32


def portable_hash(seed, *keys) -> Column:
    """Uniform integer in [0, 2^32) from the first eight hex digits of md5('seed:key1:key2…')."""
    parts = [F.lit(str(seed))] + [k if isinstance(k, Column) else F.col(k) for k in keys]
    digest = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
