"""Materialised rollups and the queries that may read them, layouts, and retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.labels import key_of, labels_of
from ..plans.grid import Grid

MINUTE, HOUR = 60 * 10**9, 3600 * 10**9
#: Range functions that the hour rollup answers.
HOURLY = {"rate", "increase", "delta", "min_over_time", "max_over_time", "first_over_time", "last_over_time", "count_over_time", "present_over_time", "changes", "resets"}


def log_minutes(logs: DataFrame, with_meta: bool = False) -> DataFrame:
    """key, stream, minute (its end: minutes are open on the left), count, bytes; with meta a row for each set of metadata too, so that queries can read it."""
    minute = F.col("ts") - 1 - F.pmod(F.col("ts") - 1, F.lit(MINUTE)) + MINUTE
    if with_meta:
        rows = logs.groupBy("key", key_of(F.col("meta")).alias("meta_key"), minute.alias("minute")).agg(F.count("*").alias("count"), F.sum(F.octet_length("line")).alias("bytes"))
        return rows.select("key", labels_of(F.col("key")).alias("stream"), labels_of(F.col("meta_key")).alias("meta"), "minute", "count", "bytes")
    return logs.groupBy("key", minute.alias("minute")).agg(F.first("stream").alias("stream"), F.count("*").alias("count"), F.sum(F.octet_length("line")).alias("bytes"))


def eligible(grid: Grid, window: int, unit: int = MINUTE) -> bool:
    """Whether all windows of a query begin and end where rollups do."""
    return not (grid.start % unit or grid.step % unit or window % unit)


def count_over_time(minutes: DataFrame, grid: Grid, window: int, what: str = "count") -> DataFrame:
    """key, step, value from the minute rollup: the same as from raw entries, where the windows are eligible."""
    if not eligible(grid, window):
        raise ValueError("windows must fall on minutes")
    rows = grid.windows(minutes.withColumnRenamed("minute", "ts"), window)
    return rows.groupBy("key", "step").agg(F.sum(what).cast("double").alias("value"))


def stale_minutes(minutes: DataFrame, logs: DataFrame) -> DataFrame:
    """Minutes whose stored count no longer equals that of the entries: late data opens them again."""
    now = log_minutes(logs).select("key", "minute", F.col("count").alias("now"))
    return now.join(minutes.select("key", "minute", "count"), ["key", "minute"], "full_outer").filter(~F.col("now").eqNullSafe(F.col("count"))).select("key", "minute")


def metric_hours(samples: DataFrame) -> DataFrame:
    """One row for each series and hour (by its end): what rate, increase, delta, changes, resets, min, max, first, last and count need."""
    hour = F.col("ts") - 1 - F.pmod(F.col("ts") - 1, F.lit(HOUR)) + HOUR
    own = Window.partitionBy("key", "hour").orderBy("ts")
    v, before = F.col("value"), F.lag("value").over(own)
    rows = samples.filter(~F.col("stale")).withColumn("hour", hour).withColumn("before", before)
    fall = ieee.compare("<", v, F.col("before"))
    change = ieee.compare("!=", v, F.col("before")) & ~(F.isnan(v) & F.isnan("before"))
    return rows.groupBy("key", "hour").agg(
        labels_of(F.col("key")).alias("labels"), F.count("*").alias("count"), F.min_by(v, F.col("ts")).alias("first"), F.max_by(v, F.col("ts")).alias("last"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), ieee.least_of(v).alias("min"), ieee.most_of(v).alias("max"),
        F.sum(F.when(F.col("before").isNotNull() & change, 1).otherwise(0)).alias("changes"), F.sum(F.when(fall, 1).otherwise(0)).alias("resets"), F.sum(F.when(fall, F.col("before")).otherwise(F.lit(0.0))).alias("lost"),
    )


def hours_over_time(hours: DataFrame, name: str, grid: Grid, window: int) -> DataFrame:
    """key, labels, step, value of a range function over whole hours; hours meet with one more pair of samples at each edge."""
    if not eligible(grid, window, HOUR):
        raise ValueError("windows must fall on hours")
    series = Window.partitionBy("key").orderBy("hour")
    near = hours.withColumn("ts", F.col("hour")).filter((F.col("ts") > grid.start - window) & (F.col("ts") <= grid.end))
    last = F.lag("last").over(series)
    fall = ieee.compare("<", F.col("first"), last)
    rows = near.withColumn("edge_ts", F.lag("hour").over(series)).withColumn("edge_lost", F.when(fall, last).otherwise(F.lit(0.0))).withColumn("edge_reset", F.when(fall, 1).otherwise(0)).withColumn("edge_change", F.when(last.isNotNull() & ieee.compare("!=", F.col("first"), last) & ~(F.isnan("first") & F.isnan(last)), 1).otherwise(0))
    rows = grid.windows(rows, window)
    inside = F.col("edge_ts") > F.col("step") - window
    edge = lambda c, zero: F.when(inside, F.col(c)).otherwise(F.lit(zero))
    if name in ("rate", "increase", "delta"):
        out = rows.groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), F.min_by("first", "ts").alias("a"), F.max_by("last", "ts").alias("b"), F.sum(F.col("lost") + edge("edge_lost", 0.0)).alias("lost"), F.min("first_ts").alias("t0"), F.max("last_ts").alias("t1"), F.sum("count").alias("n")).filter("n > 1 and t1 > t0")
        gain = F.col("b") - F.col("a") + (F.col("lost") if name != "delta" else F.lit(0.0))
        span = (F.col("t1") - F.col("t0")) / F.lit(1e9)
        gap = span / (F.col("n") - 1)
        left, right = (F.col("t0") - (F.col("step") - window)) / F.lit(1e9), (F.col("step") - F.col("t1")) / F.lit(1e9)
        left, right = (F.when(x >= gap * 1.1, gap / 2).otherwise(x) for x in (left, right))
        if name != "delta":
            left = F.when((gain > 0) & (F.col("a") >= 0), F.least(left, span * F.col("a") / F.when(gain > 0, gain).otherwise(F.lit(1.0)))).otherwise(left)
        value = gain * ((span + left + right) / span) / (window / 1e9 if name == "rate" else 1.0)
        return out.select("labels", "key", "step", value.alias("value"))
    agg = {"min_over_time": lambda: ieee.least_of(F.col("min")), "max_over_time": lambda: ieee.most_of(F.col("max")), "first_over_time": lambda: F.min_by("first", "ts"), "last_over_time": lambda: F.max_by("last", "ts"), "count_over_time": lambda: F.sum("count").cast("double"), "present_over_time": lambda: F.max(F.lit(1.0)), "changes": lambda: F.sum(F.col("changes") + edge("edge_change", 0)).cast("double"), "resets": lambda: F.sum(F.col("resets") + edge("edge_reset", 0)).cast("double")}
    return rows.groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), agg[name]().alias("value")).select("labels", "key", "step", "value")


def write_layout(df: DataFrame, path: str, by: list[str], day: Column, mode: str = "append") -> None:
    """Parquet by day, ranged and sorted by some columns, so that statistics skip row groups; small files of a day merge into ranges."""
    rows = df.withColumn("day", day)
    rows.repartitionByRange("day", *by).sortWithinPartitions("day", *by).write.mode(mode).option("compression", "zstd").partitionBy("day").parquet(path)


def retained(df: DataFrame, floor: int) -> DataFrame:
    """Rows at or above the retention floor; below it they are invisible even before they are deleted."""
    return df.filter(F.col("ts") >= floor)


def compact(spark: SparkSession, path: str, by: list[str], most_files: int = 8) -> list[str]:
    """Rewrites the days of a layout that have more than most_files files, ranged and sorted anew; gives their folders.

    A day is written beside the layout first, then takes the place of the old files; days are small enough to be one job each.
    """
    fs, base = _filesystem(spark, path)
    done = []
    for day in _days(fs, base):
        files = [f for f in fs.listStatus(day) if f.getPath().getName().startswith("part-")]
        if len(files) <= most_files:
            continue
        name, staging = day.getName(), f"{path.rstrip('/')}.compacting/{day.getName()}"
        rows = spark.read.parquet(str(day.toString()))
        size = sum(f.getLen() for f in files)
        rows.repartitionByRange(max(1, min(most_files, size // (128 << 20) + 1)), *by).sortWithinPartitions(*by).write.mode("overwrite").option("compression", "zstd").parquet(staging)
        fresh = spark._jvm.org.apache.hadoop.fs.Path(staging)
        for f in fs.listStatus(fresh):
            if f.getPath().getName().startswith("part-"):
                fs.rename(f.getPath(), spark._jvm.org.apache.hadoop.fs.Path(day, f.getPath().getName()))
        for f in files:
            fs.delete(f.getPath(), False)
        fs.delete(fresh, True)
        done.append(name)
    return done


def expire(spark: SparkSession, path: str, floor: int) -> list[str]:
    """Deletes the days of a layout that end before the retention floor (ns); gives their folders. The floor's own day stays, `retained` hides its older rows."""
    import datetime

    fs, base = _filesystem(spark, path)
    first = datetime.datetime.fromtimestamp(floor // 10**9, datetime.timezone.utc).date().isoformat()
    gone = [d for d in _days(fs, base) if d.getName().removeprefix("day=") < first]
    for d in gone:
        fs.delete(d, True)
    return [d.getName() for d in gone]


def _filesystem(spark: SparkSession, path: str):
    base = spark._jvm.org.apache.hadoop.fs.Path(path)
    return base.getFileSystem(spark._jsc.hadoopConfiguration()), base


def _days(fs, base) -> list:
    return sorted((f.getPath() for f in fs.listStatus(base) if f.getPath().getName().startswith("day=")), key=lambda p: p.getName())
