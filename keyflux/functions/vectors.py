"""Functions of numeric arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def let(value: Column, f) -> Column:
    """f(value), with value computed once, also where f uses it within a lambda."""
    return F.element_at(F.transform(F.array(value), f), 1)


def _fold(v: Column, f) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + f(x))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda acc, x: acc + x)


def mean(v: Column) -> Column:
    return _fold(v, lambda x: x.cast("double")) / F.size(v)


def stddev(v: Column, centre: Column | None = None) -> Column:
    """Population standard deviation, around centre if given."""
    squares = lambda m: F.sqrt(_fold(v, lambda x: (x.cast("double") - m) * (x.cast("double") - m)) / F.size(v))
    return let(mean(v) if centre is None else centre, squares)


def binarize(v: Column, threshold: float = 30.0) -> Column:
    return F.transform(v, lambda x: F.when(x > threshold, 1).otherwise(0))


def normalize(v: Column) -> Column:
    """Mean 0, then divided by the population standard deviation around 0."""
    centred = let(mean(v), lambda m: F.transform(v, lambda x: x.cast("double") - m))
    return let(centred, lambda c: let(stddev(c, F.lit(0.0)), lambda s: F.transform(c, lambda x: x / s)))


def one_hot(label: Column, classes: int = 10) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda i: (i == label).cast("int"))


def byte_sum(data: Column) -> Column:
    """Sum of a binary's bytes."""
    return F.aggregate(F.sequence(F.lit(1), F.octet_length(data)), F.lit(0).cast("long"), lambda acc, i: acc + F.conv(F.hex(F.substring(data, i, F.lit(1))), 16, 10).cast("long"))
