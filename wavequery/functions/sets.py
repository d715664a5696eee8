"""Set comparisons of answer lists."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def set_equal(a, b) -> Column:
    """Equality of two lists as sets: order and duplicates ignored (PRJ-9)."""
    return F.sort_array(F.array_distinct(_c(a))) == F.sort_array(F.array_distinct(_c(b)))


def dice(a, b) -> Column:
    """Dice agreement: distinct common elements x 2 over the two list *lengths* (PRJ-10).

    Duplicates lower the score ([a,a] vs [a] = 2/3). Both empty -> null.
    """
    common = F.size(F.array_intersect(_c(a), _c(b))).cast("double") * 2.0
    return F.try_divide(common, (F.size(_c(a)) + F.size(_c(b))).cast("double"))
