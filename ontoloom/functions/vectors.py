"""Vectors as arrays of float or double."""

from pyspark.sql import Column
from pyspark.sql import functions as F


def inner_product(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def l2_normalised(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    # Repeated into an array, the length is worked out once and not for each element.
    lengths = F.array_repeat(F.sqrt(inner_product(v, v)), F.size(v))
    return F.zip_with(v, lengths, lambda x, n: F.when(n > 0, x.cast("double") / n).otherwise(F.lit(0.0)))


def token_cosine(a: Column, b: Column) -> Column:
    """Cosine of two sets of words as 0/1 vectors; 0 if either is empty."""
    n = F.sqrt(F.size(a).cast("double") * F.size(b).cast("double"))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)
