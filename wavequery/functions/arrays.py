"""Array (vector / sequence) expressions built from higher-order functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def dot(a, b) -> Column:
    """Inner product of two equal-length double arrays."""
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda acc, x: acc + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda acc, x: acc + x * x))


def normalize(v) -> Column:
    """Unit vector; a zero vector becomes all-null (the reference yields NaN) (VEC-2)."""
    # the norm is bound once per row; inside the element loop it would be computed for every element
    return F.transform(F.array(l2_norm(v)), lambda n: F.transform(_c(v), lambda x: F.try_divide(x, n)))[0]


def pad_left(arr, length, pad) -> Column:
    """Left-pad ``arr`` with ``pad`` up to ``length`` (WIN-7)."""
    missing = F.greatest(_c(length) - F.size(_c(arr)), F.lit(0))
    return F.concat(F.array_repeat(pad if isinstance(pad, Column) else F.lit(pad), missing), _c(arr))


def replicate_pad(v, n: int) -> Column:
    """Append the last element ``n`` times (WIN-3)."""
    return F.concat(_c(v), F.array_repeat(F.element_at(_c(v), -1), F.lit(n)))
