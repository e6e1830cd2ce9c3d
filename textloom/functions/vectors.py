"""Vector columns (arrays of numbers) and hyperbolic coordinates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (norm(a) * norm(b))


def is_valid(vector: Column) -> Column:
    """Present, and free of nulls and NaN."""
    return vector.isNotNull() & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))


def lorentz_distance(x: Column, y: Column) -> Column:
    """acosh(-<x,y>) with the time-like coordinate first."""
    inner = dot(x, y) - F.lit(2.0) * x[0].cast("double") * y[0].cast("double")
    return F.acosh(F.greatest(F.lit(1.0), -inner))


def to_hyperboloid(vector: Column) -> Column:
    """Lift Euclidean coordinates: time-like coordinate sqrt(1 + |v|^2) put first."""
    time = F.sqrt(F.lit(1.0) + dot(vector, vector))
    return F.concat(F.array(time), F.transform(vector, lambda v: v.cast("double")))


def hyperboloid_to_disk(vector: Column) -> Column:
    """All but the last coordinate, over one plus the last."""
    last = F.element_at(vector, -1).cast("double")
    return F.transform(
        F.slice(vector, F.lit(1), F.size(vector) - 1), lambda v: v.cast("double") / (F.lit(1.0) + last)
    )


def disk_to_half_plane(x: Column, y: Column) -> Column:
    """-i (z - i) / (z + i) for z = x + iy, as real and imaginary part."""
    below = x * x + (y + 1) * (y + 1)
    return F.struct(
        ((F.lit(-2.0) * x) / below).alias("re"), ((F.lit(1.0) - x * x - y * y) / below).alias("im")
    )
