"""Streams: live tail, rollups with watermarks, rate jumps, and the threshold lifecycle with state for each series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.rules import State, Threshold, advance
from ..plans.grid import Grid
from ..plans.logql import LogPlanner
from ..plans.logql_parser import parse

MINUTE = 60 * 10**9


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Adds `at`, a timestamp for watermarks; arithmetic stays on nanoseconds."""
    return df.withColumn("at", F.timestamp_micros((F.col(ts) / F.lit(1000)).cast("long")))


def tail(logs: DataFrame, query: str) -> DataFrame:
    """Entries of a log stream as they come, through the query's pipeline: ts, labels, line."""
    planner = LogPlanner(logs, Grid(0, (1 << 62), 1))
    node = parse(query)
    out = planner.pipeline(planner.select(node), node.stages)
    return out.select("ts", F.col("bag").alias("labels"), "line")


def tail_once(logs: DataFrame, query: str, delay: str = "10 minutes") -> DataFrame:
    """The tail with each entry delivered once: retried pushes of the same stream, time and line are left out within the watermark."""
    once = event_time(logs).withColumn("line_key", F.xxhash64("line")).withWatermark("at", delay).dropDuplicatesWithinWatermark(["key", "ts", "line_key"])
    return tail(once.drop("at", "line_key"), query)


def tail_delivery(deliver: Callable[[DataFrame, DataFrame], None], limit: int = 100) -> Callable[[DataFrame, int], None]:
    """For foreachBatch of a tail: deliver(entries, dropped) gets the newest `limit` entries of a batch, and ts and labels of those that a slow reader misses."""

    def run(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            rank = F.row_number().over(Window.orderBy(F.col("ts").desc(), "line")) if batch.count() > limit else F.lit(1)
            ranked = batch.withColumn("rank", rank)
            deliver(ranked.filter(F.col("rank") <= limit).drop("rank"), ranked.filter(F.col("rank") > limit).select("ts", "labels"))
        finally:
            batch.unpersist()

    return run


def deduplicated(df: DataFrame, keys: list[str], delay: str = "10 minutes") -> DataFrame:
    """Each key once within the watermark: retried pushes add nothing."""
    return event_time(df).withWatermark("at", delay).dropDuplicatesWithinWatermark(keys)


def minute_rollup(logs: DataFrame, delay: str = "30 seconds") -> DataFrame:
    """key, minute (start), count, bytes once a minute is settled."""
    rows = event_time(logs).withWatermark("at", delay).groupBy("key", F.window("at", "1 minute")).agg(F.count("*").alias("count"), F.sum(F.octet_length("line")).alias("bytes"))
    return rows.select("key", F.col("window.start").alias("minute"), "count", "bytes")


def window_counts(errors: DataFrame, by: list[str], width: str = "5 minutes", delay: str = "1 minute") -> DataFrame:
    """Counts of tumbling windows; `rate_jumps` over the written ones finds the jumps."""
    rows = event_time(errors).withWatermark("at", delay).groupBy(*by, F.window("at", width)).agg(F.count("*").alias("current"))
    return rows.select(*by, F.col("window.start").alias("window"), "current")


def late_partitions(write: Callable[[DataFrame], None]) -> Callable[[DataFrame, int], None]:
    """For foreachBatch: aggregates the minutes that a batch touches anew, so that late data corrects what was written."""

    def run(batch: DataFrame, _: int) -> None:
        write(batch.withColumn("minute", F.col("ts") - F.pmod("ts", F.lit(MINUTE))).select("key", "minute").distinct())

    return run


def lifecycle_stream(ticks: DataFrame, rule: Threshold) -> DataFrame:
    """key, ts, value, state for a stream of ticks; the same transitions as in a batch, the state kept for each key."""

    def fold(key: tuple, batches: Iterator[pd.DataFrame], group: GroupState) -> Iterator[pd.DataFrame]:
        state = State(*group.get) if group.exists else State()
        for batch in batches:
            batch = batch.sort_values("ts")
            names = []
            for ts, v in zip(batch["ts"], batch["value"], strict=True):
                state = advance(rule, state, int(ts), None if pd.isna(v) else float(v))
                names.append(state.name)
            yield pd.DataFrame({"key": key[0], "ts": batch["ts"], "value": batch["value"], "state": names})
        group.update((state.name, state.since, state.seen))

    return ticks.select("key", "ts", "value").groupBy("key").applyInPandasWithState(fold, "key string, ts long, value double, state string", "name string, since long, seen long", "append", GroupStateTimeout.NoTimeout)
