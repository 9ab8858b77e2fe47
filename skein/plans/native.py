"""Native histograms in the metric language.

Where the samples table has a column `h`, a vector's rows hold either a number (h null) or a histogram (value null). Functions
of numbers leave histograms out; a window or a group that mixes both gives nothing where both would be added up.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions import native_histogram as nh
from ..functions.labels import labels_of
from .grid import Grid

PROPERTIES = {
    "histogram_count": lambda h: h["count"], "histogram_sum": lambda h: h["sum"], "histogram_avg": nh.average,
    "histogram_stdvar": nh.variance, "histogram_stddev": lambda h: F.sqrt(nh.variance(h)),
}
#: Range functions that add histograms up.
SUMMING = {"rate", "increase", "delta", "irate", "idelta", "sum_over_time", "avg_over_time"}
#: Range functions of any samples.
ANY = {"count_over_time", "present_over_time", "ts_of_first_over_time", "ts_of_last_over_time"}
#: Range functions that take one of the window's samples, or compare neighbours.
ENDS, PAIRS = {"first_over_time", "last_over_time"}, {"changes", "resets"}


def has_native(df: DataFrame) -> bool:
    return "h" in df.columns


def floats(vector: DataFrame) -> DataFrame:
    """The rows that hold numbers."""
    return vector.filter(F.col("h").isNull()).drop("h") if has_native(vector) else vector


def histograms(vector: DataFrame) -> DataFrame:
    return vector.filter(F.col("h").isNotNull())


def both(numbers: DataFrame, native: DataFrame) -> DataFrame:
    """One vector of rows with numbers and rows with histograms."""
    none = F.lit(None).cast(nh.TYPE).alias("h")
    columns = ["labels", "key", "step"]
    return numbers.select(*columns, "value", none).unionByName(native.select(*columns, F.lit(None).cast("double").alias("value"), "h"))


def windows(name: str, rows: DataFrame, window: int, grid: Grid, of_numbers) -> DataFrame:
    """labels, key, step, value, h of a range function; of_numbers(rows) gives it for samples that are all numbers."""
    labels = labels_of(F.col("key")).alias("labels")
    if name in ANY:
        return of_numbers(rows.withColumn("value", F.coalesce("value", F.lit(0.0))).drop("h")).withColumn("h", F.lit(None).cast(nh.TYPE))
    seen = grid.windows(rows, window)
    if name in ENDS:
        take = F.min_by if name == "first_over_time" else F.max_by
        return seen.groupBy("key", "step").agg(labels, take(F.struct("value", "h"), F.col("ts")).alias("s")).select("labels", "key", "step", "s.value", "s.h")
    if name in PAIRS:
        return _pairs(name, rows, window, grid).withColumn("h", F.lit(None).cast(nh.TYPE))
    numbers = of_numbers(floats(rows))
    if name not in SUMMING:
        return numbers.select("labels", "key", "step", "value").withColumn("h", F.lit(None).cast(nh.TYPE))
    mixed = seen.groupBy("key", "step").agg(F.count("h").alias("nh"), F.count("*").alias("n")).filter("nh > 0 and nh < n").select("key", "step")
    native = _summed(name, histograms(rows).select("key", "ts", "h"), window, grid).withColumn("labels", labels)
    out = both(numbers, native)
    return out.join(mixed, ["key", "step"], "left_anti").select("labels", "key", "step", "value", "h")


def _summed(name: str, rows: DataFrame, window: int, grid: Grid) -> DataFrame:
    """key, step, h."""
    if name in ("rate", "increase", "delta"):
        return nh.increase(rows, grid, window, name == "rate", name != "delta")
    if name in ("irate", "idelta"):
        near = nh.with_before(rows.filter((F.col("ts") > grid.start - window) & (F.col("ts") <= grid.end)))
        seen = grid.windows(near, window).filter(F.col("before_ts").isNotNull())
        last = seen.groupBy("key", "step").agg(F.max_by(F.struct("h", "before", "ts", "before_ts"), F.col("ts")).alias("s")).filter(F.col("s.before_ts") > F.col("step") - window)
        h, before = F.col("s.h"), F.col("s.before")
        gained = nh.combined(h, before, -1)
        if name == "idelta":
            return last.select("key", "step", nh.compacted(gained).alias("h"))
        gained = F.when(nh.is_reset(h, before), h).otherwise(gained)
        return last.select("key", "step", nh.scaled(nh.compacted(gained), 1e9 / (F.col("s.ts") - F.col("s.before_ts"))).alias("h"))
    seen = grid.windows(rows, window)
    total = nh.summed(seen, ["key", "step"])
    if name == "avg_over_time":
        total = total.join(seen.groupBy("key", "step").agg(F.count("*").alias("n")), ["key", "step"]).select("key", "step", nh.scaled(F.col("h"), 1 / F.col("n")).alias("h"))
    return total


def _pairs(name: str, rows: DataFrame, window: int, grid: Grid) -> DataFrame:
    series = Window.partitionBy("key").orderBy("ts")
    near = rows.filter((F.col("ts") > grid.start - window) & (F.col("ts") <= grid.end))
    near = near.withColumn("b", F.lag(F.struct("value", "h", "ts")).over(series))
    kinds = F.col("h").isNull() != F.col("b.h").isNull()
    if name == "resets":
        hit = F.when(kinds, True).when(F.col("h").isNull(), ieee.compare("<", F.col("value"), F.col("b.value"))).otherwise(nh.is_reset(F.col("h"), F.col("b.h")))
    else:
        hit = F.when(kinds, True).when(F.col("h").isNull(), ieee.compare("!=", F.col("value"), F.col("b.value")) & ~(F.isnan("value") & F.isnan("b.value"))).otherwise(~nh.equal(F.col("h"), F.col("b.h")))
    counted = F.when((F.col("b.ts") > F.col("step") - window) & F.coalesce("hit", F.lit(False)), 1.0).otherwise(0.0)
    return grid.windows(near.withColumn("hit", hit), window).groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), F.sum(counted).alias("value")).select("labels", "key", "step", "value")


def aggregated(op: str, rows: DataFrame, numbers: DataFrame) -> DataFrame:
    """sum and avg of groups (key, step) that hold histograms only, beside those of numbers only."""
    kinds = rows.groupBy("key", "step").agg(F.count("h").alias("nh"), F.count("*").alias("n"))
    native = histograms(rows).join(kinds.filter("nh = n"), ["key", "step"], "left_semi")
    total = nh.summed(native.select("key", "step", "h"), ["key", "step"])
    if op == "avg":
        total = total.join(kinds.select("key", "step", "n"), ["key", "step"]).select("key", "step", nh.scaled(F.col("h"), 1 / F.col("n")).alias("h"))
    plain = numbers.join(kinds.filter("nh = 0"), ["key", "step"], "left_semi")
    return both(plain, total.withColumn("labels", labels_of(F.col("key"))))


def paired(op: str, a: tuple[Column, Column], b: tuple[Column, Column], is_bool: bool) -> tuple[Column, Column, Column]:
    """Whether a pair of operands (value, h) that has a histogram gives a row, and its value and h."""
    (v, g), (w, h) = a, b
    left, right = g.isNotNull(), h.isNotNull()
    none, no_number = F.lit(None).cast(nh.TYPE), F.lit(None).cast("double")
    if op in ("</", ">/"):
        return left & ~right, no_number, nh.trimmed(g, w, op == "</")
    if op == "*":
        return left != right, no_number, nh.compacted(F.when(left, nh.scaled(g, w)).otherwise(nh.scaled(h, v)))
    if op == "/":
        return left & ~right, no_number, _divided(g, w)
    if op in ("+", "-"):
        return left & right, no_number, nh.compacted(nh.combined(g, h, 1 if op == "+" else -1))
    if op in ("==", "!="):
        hit = nh.equal(g, h) if op == "==" else ~nh.equal(g, h)
        return (left & right, hit.cast("double"), none) if is_bool else (left & right & hit, no_number, g)
    return F.lit(False), no_number, none


def _divided(h: Column, by: Column) -> Column:
    """By zero, the buckets go and the totals are infinite or NaN."""
    no_buckets = F.create_map().cast("map<int,double>")
    at_zero = nh.struct(h["schema"], h["zero_threshold"], *[ieee.div(h[c], F.lit(0.0) * F.signum(by) + by) for c in ("zero_count", "count", "sum")], no_buckets, no_buckets)
    return F.when(by == 0, at_zero).otherwise(nh.compacted(nh.scaled(h, 1 / F.when(by != 0, by))))
