"""Seeded draws which depend on a row's key only, never on partitioning."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def uniform(key: Column, seed: int | str) -> Column:
    """A stable number in [0, 1): the first 52 bits of an MD5 digest of key and seed."""
    digest = F.md5(F.concat(key.cast("string"), F.lit(f":{seed}")))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("bigint") / F.lit(float(2**52))
