"""Error issues, jumps of their rates, and reliability windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUTE = 60 * 10**9


def normalised(message: Column) -> Column:
    """The message with numbers and addresses taken out."""
    return F.regexp_replace(F.lower(message), r"0x[0-9a-f]+|\d+", "#")


def fingerprint(project: Column, kind: Column, place: Column, message: Column) -> Column:
    """What makes two errors the same issue: project, type, and the last own frame or else the normalised message."""
    return F.sha2(F.to_json(F.array(*[F.coalesce(c, F.lit("")) for c in (project, kind, F.coalesce(place, normalised(message)))])), 256)


def issues(errors: DataFrame) -> DataFrame:
    """From (ts, project, kind, place, message): fingerprint, count, first_ts, last_ts, latest message."""
    rows = errors.withColumn("fingerprint", fingerprint(*map(F.col, ("project", "kind", "place", "message"))))
    return rows.groupBy("fingerprint").agg(F.count("*").alias("count"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.max_by("message", F.struct("ts", "message")).alias("latest"))


def rate_jumps(errors: DataFrame, by: list[str], width: int = 5 * MINUTE, least: int = 5, factor: float = 3.0, started: int | None = None, emitted: DataFrame | None = None) -> DataFrame:
    """by, window (its start), baseline, current where a tumbling window has factor times the one before it, which has least at least.

    started: when watching began; windows whose baseline began before it are incomplete, and give nothing. emitted (by, window):
    what was told before; a window is told once.
    """
    out = _jumps(errors, by, width, least, factor)
    if started is not None:
        out = out.filter(F.col("window") - width >= started)
    return out if emitted is None else out.join(emitted.select(*by, "window").distinct(), [*by, "window"], "left_anti")


def _jumps(errors: DataFrame, by: list[str], width: int, least: int, factor: float) -> DataFrame:
    window = F.col("ts") - F.pmod("ts", F.lit(width))
    counts = errors.groupBy(*by, window.alias("window")).agg(F.count("*").alias("current"))
    before = counts.select(*by, (F.col("window") + width).alias("window"), F.col("current").alias("baseline"))
    return counts.join(before, [*by, "window"]).filter((F.col("baseline") >= least) & (F.col("current") >= factor * F.col("baseline"))).select(*by, "window", "baseline", "current")


def reliability_bins(logs: DataFrame, spans: DataFrame, service: str = "service") -> DataFrame:
    """service, minute, errors, span_count, span_errors, span_ns and a histogram of durations (6 buckets of a decade, from 1 ms)."""
    minute = lambda c: (F.col(c) - F.pmod(c, F.lit(MINUTE))).alias("minute")
    a = logs.groupBy(service, minute("ts")).agg(F.count_if(F.col("error")).alias("errors"), F.count("*").alias("entries"))
    took = F.col("end") - F.col("start")
    bucket = F.least(F.lit(5), F.greatest(F.lit(0), F.ceil(F.log10(F.greatest(took, F.lit(1)) / 1e6)))).cast("int")
    b = spans.filter("kind = 2").groupBy(service, minute("start")).agg(F.count("*").alias("span_count"), F.count_if(F.col("status") == 2).alias("span_errors"), F.sum(took).alias("span_ns"), F.min(took).alias("span_min"), F.max(took).alias("span_max"), F.array(*[F.count_if(bucket == i) for i in range(6)]).alias("durations"))
    return a.join(b, [service, "minute"], "full_outer")


def reliability_windows(bins: DataFrame, at: int, service: str = "service", baseline: int = 30, current: int = 5) -> DataFrame:
    """For each service the sums over the current minutes before `at` and over the baseline before those."""
    low, mid = at - (baseline + current) * MINUTE, at - current * MINUTE
    rows = bins.filter((F.col("minute") >= low) & (F.col("minute") < at))
    now = F.col("minute") >= mid
    total = lambda c, when: F.coalesce(F.sum(F.when(when, F.col(c))), F.lit(0)).cast("long")
    spread = lambda w: F.array(*[F.coalesce(F.sum(F.when(w, F.get("durations", F.lit(i)))), F.lit(0)).cast("long") for i in range(6)])
    return rows.groupBy(service).agg(spread(~now).alias("baseline_durations"), spread(now).alias("current_durations"), *[total(c, w).alias(f"{p}_{c}") for c in ("errors", "entries", "span_count", "span_errors", "span_ns") for p, w in (("baseline", ~now), ("current", now))])


def shape(message: Column) -> Column:
    """A short signature of what a message looks like, whatever numbers and addresses it names."""
    return F.substring(F.sha2(normalised(message), 256), 1, 16)


def shape_windows(logs: DataFrame, at: int, service: str = "service", baseline: int = 30, current: int = 5, n: int = 3) -> DataFrame:
    """service, signature, sample, baseline and current counts of the n shapes of error lines that grew most in the current minutes; logs have ts, line, error."""
    low, mid = at - (baseline + current) * MINUTE, at - current * MINUTE
    rows = logs.filter(F.col("error") & (F.col("ts") >= low) & (F.col("ts") < at)).withColumn("signature", shape(F.col("line")))
    counts = rows.groupBy(service, "signature").agg(F.min("line").alias("sample"), F.count_if(F.col("ts") < mid).alias("baseline"), F.count_if(F.col("ts") >= mid).alias("current"))
    grown = F.col("current") * baseline - F.col("baseline") * current
    rank = F.row_number().over(Window.partitionBy(service).orderBy(grown.desc(), "signature"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= n)


def newest_issue_events(errors: DataFrame, by: list[str], n: int = 3) -> DataFrame:
    """The newest n events of each group, as evidence."""
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(F.col("ts").desc(), "message"))
    return errors.withColumn("rank", rank).filter(F.col("rank") <= n).drop("rank")
