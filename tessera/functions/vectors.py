"""Vector functions on array columns."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Up to so many dimensions, products with a given vector are written out term by term, which Spark compiles.
_WRITTEN_OUT = 256


def _dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: str | Column, values: Sequence[float]) -> Column:
    """Product of a vector column with a given vector of the same length."""
    a = F.col(a) if isinstance(a, str) else a
    if len(values) > _WRITTEN_OUT:
        return _dot(a, vector(values))
    return reduce(lambda s, x: s + x, (F.get(a, F.lit(i)).cast("double") * F.lit(float(v)) for i, v in enumerate(values)), F.lit(0.0))


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 on unequal lengths or a zero norm."""
    norms = F.sqrt(_dot(a, a)) * F.sqrt(_dot(b, b))
    return F.when((F.size(a) != F.size(b)) | (norms == 0), 0.0).otherwise(_dot(a, b) / norms)


def vector(values: Sequence[float]) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))
