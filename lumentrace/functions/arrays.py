"""Small array expressions shared by the operators. All positions are 0-based."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def lit(c: Column | float | int) -> Column:
    return c if isinstance(c, Column) else F.lit(c)


def at(trace: Column, i: Column | int) -> Column:
    """Element or null when the position does not exist (negative positions too)."""
    i = lit(i).cast("int")
    return F.when(i >= 0, F.get(trace, i))


def span(trace: Column, first: Column | int, last: Column | int) -> Column:
    """Elements first..last, both included, clipped to the trace."""
    first = F.greatest(lit(first).cast("int"), F.lit(0))
    return F.slice(trace, first + 1, F.greatest(lit(last).cast("int") - first + 1, F.lit(0)))


def usable(trace: Column) -> Column:
    """Drop nulls and NaN."""
    return F.filter(trace, lambda v: v.isNotNull() & ~F.isnan(v))


def total(trace: Column) -> Column:
    return F.aggregate(trace, F.lit(0.0), lambda acc, v: acc + v)


def mean(trace: Column) -> Column:
    """Mean of all elements; null for an empty array."""
    return let(trace, lambda a: F.try_divide(total(a), F.size(a).cast("double")))


def against(trace: Column, scalar: Column, combine) -> Column:
    """Combine every element with one per-row value, which is computed once per row."""
    return F.zip_with(trace, F.array_repeat(scalar, F.size(trace)), combine)


def let(value: Column, use) -> Column:
    """Compute ``value`` once per row and build an expression on it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def nanmean(trace: Column) -> Column:
    return mean(usable(trace))


def nanmedian(trace: Column) -> Column:

    def middle(ordered: Column) -> Column:
        n = F.size(ordered)
        return (at(ordered, F.floor((n - 1) / 2)) + at(ordered, F.floor(n / 2))) / 2

    return let(F.array_sort(usable(trace)), middle)


def first_argmax(trace: Column) -> Column:
    """Position of the first maximum; null for an empty array."""
    return let(trace, lambda a: F.array_position(a, F.array_max(a)).cast("int") - 1)


def first_argmin(trace: Column) -> Column:
    return let(trace, lambda a: F.array_position(a, F.array_min(a)).cast("int") - 1)


def around(trace: Column, i: Column | int) -> Column:
    """Mean of the three elements centred on ``i``; null at the borders."""
    i = lit(i).cast("int")
    return (at(trace, i - 1) + at(trace, i) + at(trace, i + 1)) / 3


def fold_index(i: Column, n: Column, edge: str) -> Column:
    """Map an out-of-range position into 0..n-1: ``nearest`` clamps, ``reflect`` mirrors
    including the border element."""
    if edge == "nearest":
        return F.greatest(F.lit(0), F.least(i, n - 1))
    if edge == "reflect":
        m = F.pmod(i, 2 * n)
        return F.when(m < n, m).otherwise(2 * n - 1 - m)
    raise ValueError(f"no edge rule {edge!r}")


def unrolled(df: DataFrame, *keep: Column | str, trace: Column | str = "trace", names=("t", "v")) -> DataFrame:
    """One row per element of a computed trace, with its position.

    The outer form is used on purpose: for the inner form the optimizer adds a filter on
    the array's size, which would compute the whole trace expression a second time.
    """
    rows = df.select(*keep, F.posexplode_outer(trace).alias(*names))
    return rows.filter(F.col(names[0]).isNotNull())


def convolved(trace: Column, weights: list[float], low: int, edge: str) -> Column:
    """Correlate a trace with ``weights`` whose first weight belongs to offset ``low``.

    The trace is extended at both ends once; every output is then a plain weighted sum
    over a slice.
    """
    n, k = F.size(trace), len(weights)
    left, right = max(0, -low), max(0, low + k - 1)

    def outside(first: Column | int, count: int) -> Column:
        if not count:
            return F.slice(trace, 1, 0)
        positions = F.transform(F.array(*[F.lit(i) for i in range(count)]), lambda i: i + first)
        return F.transform(positions, lambda i: F.get(trace, fold_index(i, n, edge).cast("int")))

    extended = F.concat(outside(F.lit(-left), left), trace, outside(n, right))
    kernel = F.array(*[F.lit(float(w)) for w in weights])
    skip = max(0, low)  # kernels that start to the right of their target

    def one(start: Column) -> Column:
        return total(F.zip_with(F.slice(extended, start + skip, k), kernel, lambda v, w: v * w))

    return F.transform(F.sequence(F.lit(1), n), one)


def gaussian_weights(sigma: float, truncate: float = 4.0) -> list[float]:
    """Normalised Gaussian weights with radius int(truncate * sigma + 0.5)."""
    import math

    radius = int(truncate * sigma + 0.5)
    raw = [math.exp(-0.5 * (d / sigma) ** 2) for d in range(-radius, radius + 1)]
    norm = sum(raw)
    return [w / norm for w in raw]
