"""Column functions on vectors, in double precision."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 if a side is null or zero."""
    size = norm(a) * norm(b)
    return F.coalesce(F.when(size > 0, dot(a, b) / size), F.lit(0.0))


def normalise(a: Column) -> Column:
    """a over its norm, which is bound once, so that it isn't computed anew for each component."""
    over = lambda n: F.transform(a, lambda x: F.when(n > 0, x.cast("double") / n).otherwise(x.cast("double")))
    return F.get(F.transform(F.array(norm(a)), over), F.lit(0))
