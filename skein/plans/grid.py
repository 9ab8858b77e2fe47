"""The step grid of a query and windows over it."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ieee

#: In how many slices of time a series is read.
SLICES = 1_024


@dataclass(frozen=True)
class Grid:
    """Evaluation times start, start + step, ... up to end, in nanoseconds."""

    start: int
    end: int
    step: int

    @property
    def count(self) -> int:
        return (self.end - self.start) // self.step + 1 if self.end >= self.start else 0

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.range(self.count).select((F.lit(self.start) + F.col("id") * self.step).alias("step"))

    def steps_of(self, ts: Column, window: int) -> Column:
        """The steps t with t - window < ts <= t, as an array; whole numbers only, as doubles cannot hold nanoseconds."""
        first = F.greatest(F.lit(0).cast("long"), _div(ts - self.start + (self.step - 1), self.step))
        last = F.least(F.lit(self.count - 1).cast("long"), _div(ts - self.start + (window - 1), self.step))
        at = lambda i: i * self.step + self.start
        return F.when((first <= last) & (ts + (window - 1) >= self.start), F.sequence(at(first), at(last), F.lit(self.step).cast("long")))

    def windows(self, samples: DataFrame, window: int) -> DataFrame:
        """A row for each sample and step whose window has it. Samples no step can see are left out before, so that the scan can skip them."""
        near = samples.filter((F.col("ts") > self.start - window) & (F.col("ts") <= self.end))
        return near.withColumn("step", F.explode(self.steps_of(F.col("ts"), window)))


def _div(a: Column, b: int) -> Column:
    """Whole division that rounds down."""
    return F.call_function("div", a - F.pmod(a, F.lit(b).cast("long")), F.lit(b).cast("long"))


def with_before(rows: DataFrame, order: list[str], low: int, high: int) -> DataFrame:
    """Samples (key, ts, value, ...) of low..high with the value and ts before them in their series, and lost, all that the series fell from up to them.

    A series is sorted in slices of time, as one task does not hold a long one; the ends of slices are put together by series.
    """
    width, v = (high - low) // SLICES + 1, F.col("value")
    own, series = Window.partitionBy("key", "slice").orderBy(*order), Window.partitionBy("key").orderBy("slice")
    fall = lambda x, b: F.when(ieee.compare("<", x, b), b).otherwise(F.lit(0.0))
    names = [c for c in rows.columns if c not in ("before", "before_ts", "lost")]
    # Neither can be null, so that the join's sides have no filters of their own, which would shuffle samples for each; with a number
    # of partitions these stay apart.
    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    key, slice_ = F.coalesce("key", F.lit("")), F.coalesce(_div(F.col("ts") - low, width), F.lit(0).cast("long"))
    rows = rows.withColumn("key", key).withColumn("slice", slice_).repartition(n, "key", "slice").withColumn("before", F.lag("value").over(own)).withColumn("before_ts", F.lag("ts").over(own))
    rows = rows.withColumn("fall", fall(v, F.col("before")))
    rows = rows.withColumn("lost", F.sum("fall").over(own.rowsBetween(Window.unboundedPreceding, 0)))
    ends = rows.groupBy("key", "slice").agg(F.min_by("value", F.struct(*order)).alias("first"), F.max_by("value", F.struct(*order)).alias("last"), F.max("ts").alias("last_ts"), F.sum("fall").alias("fell"))
    ends = ends.withColumn("edge", F.lag("last").over(series)).withColumn("edge_ts", F.lag("last_ts").over(series)).withColumn("edge_fall", fall(F.col("first"), F.col("edge")))
    earlier = F.coalesce(F.sum(F.col("fell") + F.col("edge_fall")).over(series.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    ends = ends.select("key", "slice", "edge", "edge_ts", (earlier + F.col("edge_fall")).alias("earlier"))
    before = F.when(F.col("before_ts").isNull(), F.col("edge")).otherwise(F.col("before"))
    return rows.join(ends, ["key", "slice"]).select(*names, before.alias("before"), F.coalesce("before_ts", "edge_ts").alias("before_ts"), (F.col("lost") + F.col("earlier")).alias("lost"))
