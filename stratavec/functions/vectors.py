"""Vector arithmetic on fixed-width arrays.

A vector that does not have the stated width is an error in every function here,
however wide it is; a null vector gives null.

Products and rotations of narrow vectors are written out, which keeps them inside
generated code.  Written out for wide vectors they make a method too long for the
JVM to compile, so wide ones use higher-order functions; results are the same.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

# widest vector whose arithmetic is written out
UNROLL_LIMIT = 16


def of_width(vector: Column, dim: int, value: Column, kind: str) -> Column:
    """``value``, of SQL type ``kind``, if the vector has ``dim`` entries."""
    wrong = F.raise_error(
        F.concat(F.lit(f"vector of {dim} entries expected, got "), F.size(vector).cast("string"))
    ).cast(kind)
    return F.when(F.size(vector) == dim, value).when(vector.isNotNull(), wrong)


def _item(vector: Column, i: int) -> Column:
    return vector.getItem(i).cast("double")


def _with_value(value: Column, build: Callable[[Column], Column]) -> Column:
    """``build(value)`` with the value worked out once, not once per entry."""
    return F.flatten(F.transform(F.array(value), build))


def head_slice(flat: Column, head: Column, head_dim: int, n_heads: int | Column) -> Column:
    """One head of a flat projection of exactly ``n_heads`` heads."""
    width = (n_heads if isinstance(n_heads, Column) else F.lit(n_heads)) * F.lit(head_dim)
    wrong = F.raise_error(
        F.concat(
            F.lit("flat vector of "), width.cast("string"), F.lit(" entries expected, got "),
            F.size(flat).cast("string"),
        )
    )
    start = F.when(F.size(flat) == width, head * F.lit(head_dim) + F.lit(1)).when(
        flat.isNotNull(), wrong.cast("int")
    )
    return F.slice(flat, start, F.lit(head_dim))


def dot(left: Column, right: Column, dim: int) -> Column:
    if dim <= UNROLL_LIMIT:
        product = reduce(add, [_item(left, i) * _item(right, i) for i in range(dim)])
    else:
        products = F.zip_with(left, right, lambda x, y: x.cast("double") * y.cast("double"))
        product = F.aggregate(products, F.lit(0.0), lambda total, x: total + x)
    return of_width(left, dim, of_width(right, dim, product, "double"), "double")


def to_float32(vector: Column) -> Column:
    return vector.cast("array<float>")


def frequencies(dim: int, theta: Column | float) -> Column:
    """Angle per position of each pair of a rotation of ``dim`` entries."""
    if isinstance(theta, Column):
        power = lambda i: F.pow(theta, F.lit(-2.0) * i / F.lit(dim))
        return F.transform(F.sequence(F.lit(0), F.lit(dim // 2 - 1)), power)
    return F.array(*[F.lit(float(theta) ** (-2.0 * i / dim)) for i in range(dim // 2)])


def _turned(position: Column, rates: Column, build: Callable[[Column], Column]) -> Column:
    """``build(turns)``: sine and cosine worked out once per pair of entries."""
    turns = F.transform(
        rates,
        lambda rate: F.struct(
            F.cos(position.cast("double") * rate).alias("c"),
            F.sin(position.cast("double") * rate).alias("s"),
        ),
    )
    return _with_value(turns, build)


def rotate_halves(vector: Column, position: Column, dim: int, theta: Column | float) -> Column:
    """Rotary transform where entry i is paired with entry i + dim/2."""
    return rotate_halves_by(vector, position, dim, frequencies(dim, theta))


def rotate_halves_by(vector: Column, position: Column, dim: int, rates: Column) -> Column:
    """The same with the frequencies at hand, an array of ``dim / 2``."""
    half = dim // 2
    low = lambda v, t: v[0] * t["c"] - v[1] * t["s"]
    high = lambda v, t: v[1] * t["c"] + v[0] * t["s"]

    def build(turns: Column) -> Column:
        pairs = F.arrays_zip(
            F.slice(vector, 1, half).cast("array<double>").alias("a"),
            F.slice(vector, half + 1, half).cast("array<double>").alias("b"),
        )
        both = lambda f: F.zip_with(pairs, turns, lambda p, t: f((p["a"], p["b"]), t))
        return F.concat(both(low), both(high))

    return of_width(vector, dim, _turned(position, rates, build), "array<double>")


def rotate_pairs(
    vector: Column, position: Column, dim: int, rotary_dim: int, theta: Column | float
) -> Column:
    """Rotary transform of neighbours (2i, 2i+1) in the first ``rotary_dim`` entries."""
    return rotate_pairs_by(vector, position, dim, rotary_dim, frequencies(rotary_dim, theta))


def rotate_pairs_by(
    vector: Column, position: Column, dim: int, rotary_dim: int, rates: Column
) -> Column:
    """The same with the frequencies at hand, an array of ``rotary_dim / 2``."""

    def build(turns: Column) -> Column:
        numbers = F.sequence(F.lit(0), F.lit(rotary_dim // 2 - 1))

        def pair(i: Column, t: Column) -> Column:
            a, b = (F.get(vector, i * 2 + k).cast("double") for k in range(2))
            return F.array(a * t["c"] - b * t["s"], b * t["c"] + a * t["s"])

        turned = F.flatten(F.zip_with(numbers, turns, pair))
        rest = F.slice(vector, rotary_dim + 1, dim - rotary_dim).cast("array<double>")
        return F.concat(turned, rest) if rotary_dim < dim else turned

    return of_width(vector, dim, _turned(position, rates, build), "array<double>")


def turn_arrays(position: Column, rates: Column, neighbours: bool = False) -> tuple[Column, Column]:
    """Cosines and signed sines by which the entries at a position and their partners are
    multiplied.  They are the same for all heads, so work them out before heads are split."""
    angle = lambda rate: position.cast("double") * rate
    cosines = F.transform(rates, lambda rate: F.cos(angle(rate)))
    sines = F.transform(rates, lambda rate: F.sin(angle(rate)))
    if neighbours:
        both = lambda values, build: F.flatten(F.transform(values, build))
        return both(cosines, lambda c: F.array(c, c)), both(sines, lambda s: F.array(-s, s))
    return F.concat(cosines, cosines), F.concat(F.transform(sines, lambda s: -s), sines)


def turned_entries(
    vector: Column, cosines: Column, sines: Column, dim: int, neighbours: bool = False
) -> Column:
    """Rotary transform of a double vector whose width is known to be right.

    ``vector`` has to be a column: each of its entries is read twice.  There is no
    condition around the entries, so generated code shares what they have in common.
    """
    rotated = range(dim)
    partner = (lambda i: i ^ 1) if neighbours else (lambda i: (i + dim // 2) % dim)
    if dim <= UNROLL_LIMIT:
        item = lambda array, i: array.getItem(i)
        return F.array(
            *[
                item(vector, i) * item(cosines, i) + item(vector, partner(i)) * item(sines, i)
                for i in rotated
            ]
        )
    if neighbours:
        swapped = F.transform(vector, lambda _, i: F.get(vector, i.bitwiseXOR(F.lit(1))))
    else:
        swapped = F.concat(F.slice(vector, dim // 2 + 1, dim // 2), F.slice(vector, 1, dim // 2))
    product = lambda x, y: x * y
    return F.zip_with(
        F.zip_with(vector, cosines, product), F.zip_with(swapped, sines, product), lambda x, y: x + y
    )


def scale_vector(vector: Column, factor: Column) -> Column:
    return _with_value(factor, lambda f: F.transform(vector, lambda x: x.cast("double") * f))


def query_scale(position: Column, beta: float, max_position: int) -> Column:
    """1 + beta * ln(1 + floor(position / max_position))."""
    step = F.floor(position / F.lit(max_position)).cast("double")
    return F.lit(1.0) + F.lit(float(beta)) * F.log(F.lit(1.0) + step)


def rms_norm(
    vector: Column, weights: list[float], eps: float, one_plus_weight: bool = False
) -> Column:
    """Root-mean-square norm of one head vector."""
    dim = len(weights)
    inverse = F.lit(1.0) / F.sqrt(dot(vector, vector, dim) / F.lit(float(dim)) + F.lit(float(eps)))
    factors = F.lit([1.0 + w if one_plus_weight else w for w in weights])
    normed = _with_value(
        inverse,
        lambda scale: F.zip_with(vector, factors, lambda x, w: x.cast("double") * scale * w),
    )
    return of_width(vector, dim, normed, "array<double>")


def soft_cap(value: Column, cap: float) -> Column:
    return F.lit(float(cap)) * F.tanh(value / F.lit(float(cap)))
