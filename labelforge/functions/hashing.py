"""Seeded, partition-independent randomness.

Every random choice is a function of (salt, row key) through md5, so a split
or a sample is reproducible on any partitioning and has a plain-SQL oracle.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO32 = 4294967296.0


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def hkey(idx, salt: str) -> Column:
    """md5 hex of ``salt-idx``: the sort key of a seeded shuffle."""
    return F.md5(F.concat(F.lit(f"{salt}-"), _c(idx).cast("string")))


def h32(idx, salt: str) -> Column:
    """First 32 bits of the md5 of ``salt-idx`` as a bigint in [0, 2^32)."""
    return F.conv(F.substring(hkey(idx, salt), 1, 8), 16, 10).cast("bigint")


def u(idx, salt: str) -> Column:
    """Uniform in [0, 1) keyed by (salt, idx)."""
    return h32(idx, salt) / F.lit(TWO32)


def split_key(idx, seed: int, salt: str = "") -> Column:
    """Sort key of the split/sampling order for ``seed``."""
    return hkey(idx, f"s{seed}" + (f"-{salt}" if salt else ""))


def hash_bucket(hex_key, buckets: int) -> Column:
    """Monotone bucket of an md5 hex key: equal prefixes share a bucket, and
    bucket order agrees with the string order of the key."""
    h = F.conv(F.substring(_c(hex_key), 1, 8), 16, 10).cast("bigint")
    return F.floor(h * F.lit(float(buckets)) / F.lit(TWO32)).cast("int")
