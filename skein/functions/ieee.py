"""Float arithmetic with IEEE results.

Spark in ANSI mode raises on x/0 and gives null for logarithms outside their domain; comparisons order NaN above all numbers.
The query languages want infinities, NaN and NaN-aware comparisons, so every float operation goes through here.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

INF = float("inf")


def nan() -> Column:
    return F.lit(float("nan"))


def div(a: Column, b: Column) -> Column:
    safe = F.when(b == 0, F.lit(1.0)).otherwise(b)
    negative = (a < 0) != (F.lit(1.0) * F.signum(b) < 0)
    at_zero = F.when((a == 0) | F.isnan(a), nan()).when(negative, F.lit(-INF)).otherwise(F.lit(INF))
    return F.when(b == 0, at_zero).otherwise(a / safe)


def mod(a: Column, b: Column) -> Column:
    """The remainder with the sign of the dividend."""
    safe = F.when((b == 0) | F.isnan(b), F.lit(1.0)).otherwise(b)
    return F.when((b == 0) | F.isnan(a) | F.isnan(b) | (F.abs(a) == INF), nan()).when(F.abs(b) == INF, a).otherwise(a % safe)


def power(a: Column, b: Column) -> Column:
    return F.when((b == 0) | (a == 1), F.lit(1.0)).otherwise(F.pow(a, b))


def compare(op: str, a: Column, b: Column) -> Column:
    """NaN equals nothing and is neither above nor below anything."""
    fine = ~F.isnan(a) & ~F.isnan(b)
    plain = {"==": lambda: a == b, ">": lambda: a > b, "<": lambda: a < b, ">=": lambda: a >= b, "<=": lambda: a <= b}
    return ~fine | (a != b) if op == "!=" else fine & plain[op]()


def log(a: Column, base: float | None = None) -> Column:
    inside = F.when(a > 0, F.when(F.isnan(a), F.lit(1.0)).otherwise(a)).otherwise(F.lit(1.0))
    value = F.log(inside) if base is None else F.log2(inside) if base == 2 else F.log10(inside)
    return F.when(F.isnan(a) | (a < 0), nan()).when(a == 0, F.lit(-INF)).otherwise(value)


def within(a: Column, low: float, high: float, value: Column) -> Column:
    """value where a lies in its domain, else NaN."""
    return F.when(F.isnan(a) | (a < low) | (a > high), nan()).otherwise(value)


def least_of(v: Column) -> Column:
    """Aggregate: minimum without NaN, NaN if there is nothing else."""
    return F.coalesce(F.min(F.when(~F.isnan(v), v)), F.max(v))


def most_of(v: Column) -> Column:
    return F.coalesce(F.max(F.when(~F.isnan(v), v)), F.max(v))


def interpolated(q: Column, ordered: Column) -> Column:
    """The q-quantile of a sorted array by linear interpolation; -Inf and +Inf outside 0..1, NaN of nothing."""
    n = F.size(ordered)
    rank = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(F.isnan(q), F.lit(0.0)).otherwise(q))) * (n - 1)
    low = F.floor(rank).cast("int")
    weight = rank - low
    a, b = F.get(ordered, low), F.get(ordered, F.least(low + 1, n - 1))
    return F.when((n == 0) | F.isnan(q), nan()).when(q < 0, F.lit(-INF)).when(q > 1, F.lit(INF)).otherwise(a * (1 - weight) + b * weight)


#: Bounds of magnitude classes that are summed apart, so that small numbers survive large ones that cancel; fixed values.
_CLASSES = (2.0**-30, 2.0**40, 2.0**110)
_SHRINK = 2.0**-128


def _class_sums(v: Column) -> tuple[Column, list[Column]]:
    """The sum of the largest class, shrunk so that it cannot overflow, and the sums of the others from large to small."""
    size, zero = F.abs(v), F.lit(0.0)
    big = F.sum(F.when((size >= _CLASSES[2]) | F.isnan(v), v * F.lit(_SHRINK)).otherwise(zero))
    bounds = [0.0, *_CLASSES]
    return big, [F.sum(F.when((size >= low) & (size < high), v).otherwise(zero)) for low, high in reversed(list(zip(bounds, bounds[1:], strict=False)))]


def sum_of(v: Column) -> Column:
    """Aggregate: the sum, where 1e100 + 1 - 1e100 is 1; partial sums combine as plain ones do."""
    big, rest = _class_sums(v)
    return big / F.lit(_SHRINK) + (rest[0] + (rest[1] + rest[2]))


def mean_of(v: Column) -> Column:
    """Aggregate: the mean, also where the sum is beyond the largest number."""
    big, rest = _class_sums(v)
    n = F.count(v)
    return big / n / F.lit(_SHRINK) + (rest[0] + (rest[1] + rest[2])) / n
