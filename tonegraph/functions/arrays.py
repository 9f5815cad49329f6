"""Column expressions over arrays and bins, all evaluated by the JVM."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TINY = 1e-9


def total(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda a, x: a + x)


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with value worked out once however often use names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def over(values: Column, divisor: Column) -> Column:
    """Each value over divisor, which is worked out once for the array."""
    return F.zip_with(values, F.array_repeat(divisor, F.size(values)), lambda x, d: x / d)


def share(values: Column) -> Column:
    """Each value over (sum + 1e-9)."""
    return bound(F.transform(values, lambda x: x.cast("double")), lambda v: over(v, total(v) + TINY))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: Column) -> Column:
    """a over its L2 norm; the zero vector stays as it is."""
    return bound(a, lambda v: over(v, bound(norm(v), lambda n: F.when(n > 0, n).otherwise(1.0))))


def first_argmax(values: Column) -> Column:
    """Zero-based place of the first largest value."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def equal_width_bin(value: Column, low: Column, high: Column, bins: int, closed: bool = True) -> Column:
    """Bin of value among `bins` equal ones between low and high, decided against the edges
    low + i * (high - low) / bins.  The last bin is closed if `closed`; without it the largest value has no bin (null).
    A constant sample is spread over [v - 0.5, v + 0.5] if closed, and has no bin otherwise."""
    flat = high == low
    lo = F.when(flat, low - 0.5).otherwise(low) if closed else low
    hi = F.when(flat, high + 0.5).otherwise(high) if closed else high
    width = (hi - lo) / bins
    guess = F.floor(F.try_divide(value - lo, width)).cast("int")
    edge = lambda i: F.when(i == bins, hi).otherwise(lo + i * width)
    place = guess - (value < edge(guess)).cast("int") + (value >= edge(guess + 1)).cast("int")
    inside = F.least(place, F.lit(bins - 1)) if closed else F.when(place < bins, place)
    return F.when(F.lit(True) if closed else ~flat, inside)


def edge_counts(value: Column, edges: Sequence[float]) -> list[Column]:
    """Aggregates: counts of value between consecutive edges, the last one closed."""
    last = len(edges) - 2
    return [
        F.count_if((value >= a) & ((value <= b) if k == last else (value < b)))
        for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False))
    ]


def pitch_class_counts(pitch: Column, where: Column) -> Column:
    """Aggregate: array of twelve counts of pitch modulo 12 among the rows where."""
    return F.array(*[F.count_if(where & (F.pmod(pitch, F.lit(12)) == c)) for c in range(12)])


def all_of(conditions: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a & b, conditions)
