"""Joins on group keys in which null is a key like any other."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

RIGHT = "__right_"


def join_null_safe(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", broadcast: bool = False) -> DataFrame:
    """Join on equal keys, with null equal to null; the keys come from the left side."""
    renamed = right.select(*[F.col(c).alias(RIGHT + c) if c in keys else F.col(c) for c in right.columns])
    same = reduce(lambda a, b: a & b, [F.col(c).eqNullSafe(F.col(RIGHT + c)) for c in keys])
    joined = left.join(F.broadcast(renamed) if broadcast else renamed, same, how)
    return joined.drop(*[RIGHT + c for c in keys])
