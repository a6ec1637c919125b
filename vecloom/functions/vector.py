"""Vector expressions. All are columns over ``array`` columns and stay in the JVM.

Accumulation is in double precision. Lengths must agree: a pair of vectors of different
lengths raises an error instead of being padded. Null vectors give null.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

EPSILON_100 = 1.1920929e-5
"""A hundred times the f32 machine epsilon: the limit up to which two elements count as the same."""


def _doubles(v: Column) -> Column:
    return v.cast("array<double>")


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with the value worked out once, however often it occurs (also within lambdas, where the optimizer shares nothing)."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _same_length(x: Column, y: Column, value: Column) -> Column:
    return F.when(F.size(x) == F.size(y), value).otherwise(F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("double")))


def dot(x: Column, y: Column) -> Column:
    """Inner product in double precision."""
    product = F.aggregate(F.zip_with(_doubles(x), _doubles(y), lambda a, b: a * b), F.lit(0.0), lambda s, p: s + p)
    return _same_length(x, y, product)


def norm(v: Column) -> Column:
    """L2 norm."""
    return F.sqrt(F.aggregate(_doubles(v), F.lit(0.0), lambda s, a: s + a * a))


def dimension(v: Column) -> Column:
    return F.size(v)


def normalize(v: Column) -> Column:
    """The vector divided by its norm; a zero vector stays as it is."""
    return let(_doubles(v), lambda d: let(norm(d), lambda n: F.when(n > 0, F.transform(d, lambda a: a / n)).otherwise(d)))


def max_abs(v: Column) -> Column:
    """The scale of quantization: the greatest absolute component, 127 for an empty vector."""
    return F.coalesce(F.array_max(F.transform(v.cast("array<float>"), lambda a: F.abs(a))), F.lit(127.0).cast("float"))


def quantize(v: Column) -> Column:
    """Components scaled to [-127, 127] and cut to whole numbers, with f32 arithmetic throughout; a zero vector becomes zeros."""
    scaled = lambda a, top: ((a * F.lit(127.0).cast("float")).cast("float") / top).cast("float")
    zeros = lambda f: F.transform(f, lambda a: F.lit(0).cast("tinyint"))
    return let(v.cast("array<float>"), lambda f: let(max_abs(f), lambda top: F.when(top > 0, F.transform(f, lambda a: scaled(a, top).cast("tinyint"))).otherwise(zeros(f))))


def angular(x: Column, y: Column) -> Column:
    """Distance of two unit vectors: 1 minus their inner product, 0 at least."""
    return F.greatest(F.lit(0.0), 1 - dot(x, y))


def angular_any(x: Column, y: Column) -> Column:
    """Distance 1 - cosine of vectors of any length; 1 if either is zero."""
    cosine = dot(x, y) / F.nullif(norm(x) * norm(y), F.lit(0.0))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(cosine, F.lit(0.0))))


def angular_int(x: Column, y: Column) -> Column:
    """Distance of quantized vectors from whole-number sums; 1 if either is zero."""
    ints = lambda v: v.cast("array<int>")
    total = lambda a, b: F.aggregate(F.zip_with(ints(a), ints(b), lambda p, q: p * q), F.lit(0), lambda s, p: s + p)
    scale = F.sqrt(total(x, x).cast("double")) * F.sqrt(total(y, y).cast("double"))
    cosine = _same_length(x, y, total(x, y).cast("double")) / F.nullif(scale, F.lit(0.0))
    return F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(F.greatest(F.lit(0.0), 1 - F.coalesce(cosine, F.lit(0.0))))


def distance(kind: str, x: Column, y: Column) -> Column:
    """Distance of two raw vectors by element type: ``angular`` (normalized first) or ``angular_int`` (quantized first)."""
    kind = kind.lower()
    if kind == "angular":
        return angular(normalize(x), normalize(y))
    if kind == "angular_int":
        return angular_int(quantize(x), quantize(y))
    raise ValueError(f"unknown element type: {kind}")


def indexable(v: Column) -> Column:
    """Whether an element can be linked: its distance from itself is (nearly) zero. False for zero vectors."""
    return angular_any(v, v) <= EPSILON_100


def plus(x: Column, y: Column) -> Column:
    """Component-wise sum; lengths that differ raise an error."""
    added = F.zip_with(_doubles(x), _doubles(y), lambda a, b: a + b)
    return F.when(F.size(x) == F.size(y), added).otherwise(F.when(x.isNull() | y.isNull(), F.lit(None)).otherwise(F.raise_error(F.lit("vectors of different lengths")).cast("array<double>")))


def delta_encode(ids: Column) -> Column:
    """First value, then the difference from the value before."""
    return F.transform(ids, lambda x, i: F.when(i == 0, x).otherwise(x - F.try_element_at(ids, F.greatest(i, F.lit(1)))))


def delta_decode(deltas: Column) -> Column:
    """Running sums."""
    return F.transform(deltas, lambda _, i: F.aggregate(F.slice(deltas, F.lit(1), i + 1), F.lit(0).cast("long"), lambda s, x: s + x))


def elements_in_layer(total: int, multiplier: float, layer: int) -> int:
    """Elements of a layer: the last has all, each above a ``multiplier``-th of the one below, rounded up.

    The logarithms are divided as floats and the multiplier is an f32, as the sizes depend on it.
    """
    m = struct.unpack("f", struct.pack("f", multiplier))[0]
    if total <= 0:
        return 0
    last = math.floor(math.log(total) / math.log(m))
    return min(math.ceil(total / m ** (last - layer)), total)


def layer_sizes(total: int, multiplier: float) -> list[int]:
    """The sizes of all layers, the last of which has all elements."""
    sizes: list[int] = []
    while total > 0 and (not sizes or sizes[-1] < total):
        sizes.append(elements_in_layer(total, multiplier, len(sizes)))
    return sizes
