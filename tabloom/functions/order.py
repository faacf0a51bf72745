"""Places in a short order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers up to which a place is found by nested comparisons.
NESTED = 64


def below(ordered: list[float], x: Column) -> Column:
    """How many of some rising numbers are at or below x, which is a column of a table and neither null nor NaN.

    Nested comparisons compile to code, which a lambda over an array does not.
    """

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(x < float(ordered[mid]), between(low, mid)).otherwise(between(mid + 1, high))

    return between(0, len(ordered))
