"""Vector functions over arrays as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Inner product; the longer vector is cut to the length of the shorter."""
    n = F.least(F.size(a), F.size(b))
    products = F.zip_with(F.slice(a, F.lit(1), n), F.slice(b, F.lit(1), n), lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(products, F.lit(0.0), lambda s, x: s + x)


def magnitude(a: Column) -> Column:
    """Euclidean norm."""
    return F.sqrt(F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))


def cosine_of(product: Column, norm_a: Column, norm_b: Column) -> Column:
    """Cosine from a product and two norms; 0 where a norm is 0."""
    both = norm_a * norm_b
    return F.when(both == 0, F.lit(0.0)).otherwise(product / both)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two vectors; 0 where one has no length."""
    return cosine_of(dot(a, b), magnitude(a), magnitude(b))
