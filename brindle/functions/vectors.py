"""Dense vectors in array columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, v: s + v)


def finite(v: Column) -> Column:
    """Whether a vector has components and all of them are finite numbers."""
    good = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & good, F.lit(False))


def normalised(v: Column) -> Column:
    """The vector at length 1; a vector of length 0 stays."""
    length = F.sqrt(dot(v, v))
    return F.transform(v, lambda x: x.cast("double") / F.when(length == 0, F.lit(1.0)).otherwise(length))
