"""Column expressions over ``array<float>`` vectors, computed in double."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from addrloom.vocab import NORM_TOLERANCE


def _total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0).cast("double"), lambda acc, x: acc + x)


def squared_l2(a: Column, b: Column) -> Column:
    def gap_squared(x: Column, y: Column) -> Column:
        gap = x.cast("double") - y.cast("double")
        return gap * gap

    return _total(F.zip_with(a, b, gap_squared))


def l2_distance(a: Column, b: Column) -> Column:
    return F.sqrt(squared_l2(a, b))


def cosine_from_l2(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors from their distance: 1 - d^2 / 2."""
    return 1.0 - squared_l2(a, b) / 2.0


def l2_norm(v: Column) -> Column:
    return F.sqrt(_total(F.transform(v, lambda x: x.cast("double") * x.cast("double"))))


def l2_normalize(v: Column) -> Column:
    """Unit vector; a zero vector has no direction and becomes NULL."""
    norm = l2_norm(v)
    return F.when(norm > 0, F.transform(v, lambda x: (x.cast("double") / norm).cast("float")))


def norm_is_off(v: Column, tolerance: float = NORM_TOLERANCE) -> Column:
    """True where a vector is not unit length; a missing vector counts as off."""
    return F.coalesce(F.abs(l2_norm(v) - 1.0) > tolerance, F.lit(True))


def self_product_ok(v: Column, tolerance: float = NORM_TOLERANCE) -> Column:
    """Check of stored vectors: the product of a vector with itself is about 1."""
    product = _total(F.transform(v, lambda x: x.cast("double") * x.cast("double")))
    return F.coalesce(F.abs(product - 1.0) < tolerance, F.lit(False))


def vector_text(v: Column) -> Column:
    """``[x,y,..]`` with eight decimals, the text form of vector columns."""
    numbers = F.transform(v, lambda x: F.format_string("%.8f", x.cast("double")))
    return F.concat(F.lit("["), F.array_join(numbers, ","), F.lit("]"))
