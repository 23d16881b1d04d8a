"""Vector and bit-hash expressions on array columns, all in the JVM."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import col


def dot(a: str | Column, b: str | Column) -> Column:
    return F.aggregate(F.zip_with(col(a), col(b), lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: str | Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: str | Column) -> Column:
    """The vector by its length; a zero vector stays."""
    length = norm(a)
    return F.transform(col(a), lambda x: F.when(length > 0, x / length).otherwise(x.cast("double")))


def cosine_distance(a: str | Column, b: str | Column) -> Column:
    """1 - dot product, for vectors of unit length."""
    return F.lit(1.0) - dot(a, b)


def is_unit(a: str | Column, tolerance: float = 1e-5) -> Column:
    return F.abs(norm(a) - 1) <= tolerance


def median_bits(coefficients: str | Column) -> Column:
    """64 bits of an 8 x 8 block of coefficients: each is compared with the median of the 63 that are not the first."""
    c = col(coefficients)
    middle = F.sort_array(F.slice(c, 2, 63))[31]
    return F.transform(c, lambda x: x > middle)


def hamming(a: str | Column, b: str | Column) -> Column:
    """Number of differing bits of two boolean arrays."""
    return F.size(F.filter(F.zip_with(col(a), col(b), lambda x, y: x != y), lambda d: d)).cast("bigint")


def packed(bits: str | Column) -> Column:
    """64 booleans as one bigint; differing bits are then bit_count(a ^ b)."""
    b = col(bits)
    return reduce(lambda x, y: x.bitwiseOR(y), (F.shiftleft(b[k].cast("bigint"), 63 - k) for k in range(64)))


def hamming_packed(a: str | Column, b: str | Column) -> Column:
    return F.bit_count(col(a).bitwiseXOR(col(b))).cast("bigint")


def grid_stats(values: str | Column, width: int = 8, height: int = 8) -> Column:
    """struct(mean, var, lap_var) of a grid given as an array: population variances of values and of their Laplacian,
    whose borders are reflected without repeating the edge."""
    v = col(values)
    n = width * height

    def inside(k: Column, size: int) -> Column:
        return F.when(k < 0, -k).when(k >= size, F.lit(2 * size - 2) - k).otherwise(k)

    def at(x: Column, y: Column) -> Column:
        return F.element_at(v, (inside(y, height) * width + inside(x, width) + 1).cast("int")).cast("double")

    def laplace(p: Column) -> Column:
        x, y = p % width, F.floor(p / width)
        return at(x - 1, y) + at(x + 1, y) + at(x, y - 1) + at(x, y + 1) - at(x, y) * 4

    edges = F.transform(F.sequence(F.lit(0), F.lit(n - 1)), laplace)

    def moments(a: Column) -> Column:
        """Mean and variance in one pass; the array is evaluated once."""
        start = F.struct(F.lit(0.0).alias("s"), F.lit(0.0).alias("q"))
        return F.aggregate(a, start, lambda z, x: F.struct((z["s"] + x).alias("s"), (z["q"] + x * x).alias("q")), lambda z: F.struct((z["s"] / n).alias("mean"), (z["q"] / n - (z["s"] / n) * (z["s"] / n)).alias("var")))

    plain = F.transform(v, lambda x: x.cast("double"))
    own, edge = moments(plain), moments(edges)
    return F.struct(own["mean"].alias("mean"), own["var"].alias("var"), edge["var"].alias("lap_var"))
