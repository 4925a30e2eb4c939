"""Deterministic draws: a hash of (seed, tag, key), the same in any partitioning and in DuckDB."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column
from pyspark.sql import functions as F


def u32(seed: int, tag: str | Column, key: Column) -> Column:
    """A number below 2**32."""
    tag = F.lit(tag) if isinstance(tag, str) else tag.cast("string")
    return F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(str(seed)), tag, key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def below(seed: int, tag: str | Column, key: Column, n: int | Column) -> Column:
    """Uniform in 0 .. n-1."""
    return u32(seed, tag, key) % n


def between(seed: int, tag: str | Column, key: Column, low: int, high: int) -> Column:
    """Uniform in low .. high, both included."""
    return below(seed, tag, key, high - low + 1) + low


def plain_u32(seed: int, tag: str, key: object) -> int:
    """u32 outside of Spark, for kernels: the same number."""
    return int(hashlib.md5(f"{seed}:{tag}:{key}".encode(), usedforsecurity=False).hexdigest()[:8], 16)


def plain_between(seed: int, tag: str, key: object, low: int, high: int) -> int:
    return plain_u32(seed, tag, key) % (high - low + 1) + low


def sql_u32(seed: int, tag: str, key: str) -> str:
    """u32 as DuckDB SQL; tag and key are SQL expressions."""
    return f"('0x' || substr(md5('{seed}:' || {tag} || ':' || ({key})::varchar), 1, 8))::bigint"
