"""Column functions that Spark has not: bindings inside an expression and running values along an array."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), value being worked out once for each row."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, join: Callable[[Column, Column], Column], doublings: int = 20) -> Column:
    """What join, which must be associative, makes of all values up to each place. After each step a place has twice as many
    values; 20 steps reach over a million, which geometries and token sequences don't have."""

    def doubled(step: int) -> Callable[[Column], Column]:
        return lambda a: F.when(F.size(a) <= step, a).otherwise(F.transform(a, lambda x, i: F.when(i >= step, join(F.get(a, i - step), x)).otherwise(x)))

    for k in range(doublings):
        values = let(values, doubled(1 << k))
    return values


def neighbours(values: Column) -> Column:
    """(a, b) for each two values side by side; none of fewer than two."""
    n = F.greatest(F.lit(0), F.size(values) - 1)
    return F.arrays_zip(F.slice(values, F.lit(1), n).alias("a"), F.slice(values, F.lit(2), n).alias("b"))
