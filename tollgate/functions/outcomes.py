"""Labels over a pair of graded answers."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def need_strong(weak: Column, strong: Column) -> Column:
    """Only the strong model is right: the one case where paying for it helps."""
    return ~weak & strong


def outcome(weak: Column, strong: Column) -> Column:
    return (
        F.when(weak & strong, "both_right")
        .when(weak, "weak_only")
        .when(strong, "need_strong")
        .otherwise("both_wrong")
    )


def share(condition: Column) -> Column:
    """Fraction of rows that satisfy the condition, from exact counts."""
    return F.try_divide(F.count_if(condition), F.count(condition))


def half_even(col: Column, decimals: int) -> Column:
    return F.bround(col, decimals)
