"""Helpers for expressions over arrays."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with the value computed once even if f uses it often or inside other lambdas."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def in_lists(array: Column, size: int | Column) -> Column:
    """The array cut into arrays of ``size`` elements."""
    starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), size if isinstance(size, Column) else F.lit(size))
    return F.when(F.size(array) > 0, F.transform(starts, lambda i: F.slice(array, i, size)))


def last_not_above(lists: Column, value: Column, key: Callable[[Column], Column] = lambda x: x) -> Column:
    """How many elements of sorted ``lists`` (see ``in_lists``) have a key of at most ``value``: lists that begin so are counted by
    their first element, then the last of them is walked."""
    full = F.size(F.get(lists, F.lit(0)))
    begun = F.size(F.filter(lists, lambda x: key(F.get(x, F.lit(0))) <= value))

    def count(n: Column) -> Column:
        inside = F.size(F.filter(F.get(lists, n - 1), lambda x: key(x) <= value))
        return F.when(n > 0, (n - 1) * full + inside).otherwise(0)

    return once(begun, count)
