"""Vector functions over arrays, in double precision and index order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """0 where the lengths differ."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.lit(0.0))


def norm(v: Column) -> Column:
    return F.sqrt(dot(v, v))


def cosine(a: Column, b: Column) -> Column:
    scale = norm(a) * norm(b)
    return F.when(scale > 0, dot(a, b) / scale).otherwise(F.lit(0.0))


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    n = norm(v)
    return F.when(n > 0, F.transform(v, lambda x: x.cast("double") / n)).otherwise(F.transform(v, lambda x: x.cast("double")))


def is_zero(v: Column) -> Column:
    return ~F.exists(v, lambda x: x != 0)


def quantize(v: Column) -> Column:
    """struct(q: 8-bit steps, scale: the step), halves rounded up."""
    scale = F.array_max(F.transform(v, lambda x: F.abs(x.cast("double")))) / 127
    steps = F.transform(v, lambda x: F.when(scale > 0, F.least(F.greatest(F.floor(x.cast("double") / scale + 0.5), F.lit(-127)), F.lit(127))).otherwise(F.lit(0)).cast("tinyint"))
    return F.struct(steps.alias("q"), scale.alias("scale"))


def dequantize(q: Column, scale: Column) -> Column:
    return F.transform(q, lambda x: x.cast("double") * scale)


def int8_dot(a: Column, a_scale: Column, b: Column, b_scale: Column) -> Column:
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("int") * y.cast("int")), F.lit(0), lambda s, x: s + x)
    return total * a_scale * b_scale
