"""Vector arithmetic on array columns, in doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-8


def doubles(v: Column) -> Column:
    return v.cast("array<double>")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def unit(v: Column) -> Column:
    """``v`` over its length, or over a tiny number if that is less."""
    n = F.greatest(norm(v), F.lit(TINY))
    return F.zip_with(v, F.array_repeat(n, F.size(v)), lambda x, y: x / y)  # within a lambda the length would be taken anew for each number


def cosine(a: Column, b: Column) -> Column:
    return dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))


def squared_distance(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (x - y) * (x - y)), F.lit(0.0), lambda s, x: s + x)


def pad(frames: Column, length: int, width: int) -> Column:
    """Exactly ``length`` frames: cut, or filled with zero frames."""
    zero = F.array_repeat(F.array_repeat(F.lit(0.0), width), length)
    return F.slice(F.concat(frames, zero), 1, length)


def top_k(v: Column, k: int) -> Column:
    """The ``k`` greatest values with their places, greatest first, earlier places first among equals."""
    pairs = F.transform(v, lambda x, i: F.struct((-x).alias("v"), i.alias("i")))
    return F.transform(F.slice(F.sort_array(pairs), 1, k), lambda p: F.struct(p["i"].alias("idx"), (-p["v"]).alias("val")))


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def log_loss(x: Column, y: Column) -> Column:
    """Cross entropy of a logit, stable for any size."""
    return F.greatest(x, F.lit(0.0)) - x * y + F.log1p(F.exp(-F.abs(x)))
