"""The three tables of the engine and adapters that project other tables onto them.

samples: labels map, key, ts (ns), value, stale
logs:    stream map (stream labels), meta map (structured metadata), key, ts (ns), line
spans:   trace, id, parent, name, service, kind, start, end (ns), status, attrs map, resource map, events
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import NAME, no_labels, key_from, key_of


def ns(ts: Column) -> Column:
    """Nanoseconds of a timestamp without a zone, taken as UTC."""
    return F.unix_micros(ts.cast("timestamp")) * 1000


def label_map(**columns: Column) -> Column:
    return F.create_map(*[x for k, v in columns.items() for x in (F.lit(k), v.cast("string"))])


def as_samples(df: DataFrame, metric: str, labels: dict[str, Column], ts: Column, value: Column) -> DataFrame:
    own = {NAME: F.lit(metric), **labels}
    return df.select(label_map(**own).alias("labels"), ts.alias("ts"), value.cast("double").alias("value"), F.lit(False).alias("stale"), key_from(own).alias("key"))


def as_logs(df: DataFrame, stream: dict[str, Column], ts: Column, line: Column, meta: dict[str, Column] | None = None) -> DataFrame:
    bag = label_map(**stream)
    return df.select(bag.alias("stream"), (label_map(**meta) if meta else no_labels()).alias("meta"), key_from(stream).alias("key"), ts.alias("ts"), line.alias("line"))


def as_log_records(df: DataFrame) -> DataFrame:
    """Logs from records (ts, service, severity_text, body, trace_id, span_id, attributes, resource): the service and severity are stream labels under their usual names."""
    mirrored = F.array(*[F.struct(F.lit(n).alias("key"), F.col(c).alias("value")) for n, c in (("service", "service"), ("service_name", "service"), ("level", "severity_text"), ("detected_level", "severity_text"))])
    own = F.map_from_entries(F.filter(mirrored, lambda e: e["value"].isNotNull()))
    resource = F.coalesce("resource", no_labels())
    stream = F.map_concat(F.map_filter(resource, lambda k, v: ~F.map_contains_key(own, k)), own)
    ids = F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.col(n).alias("value")) for n in ("trace_id", "span_id")]), lambda e: F.coalesce(e["value"], F.lit("")) != ""))
    attributes = F.coalesce("attributes", no_labels())
    meta = F.map_concat(attributes, F.map_filter(ids, lambda k, v: ~F.map_contains_key(attributes, k)))
    return df.select(stream.alias("stream"), meta.alias("meta"), key_of(stream).alias("key"), "ts", F.col("body").alias("line"))


def resolve_duplicates(samples: DataFrame) -> DataFrame:
    """One sample for each series and time: a stale marker first, then the largest number, NaN only alone."""
    rank = F.struct(F.col("stale").cast("int").alias("s"), (~F.isnan("value")).cast("int").alias("n"), F.col("value").alias("v"))
    best = samples.groupBy("key", "ts").agg(F.first("labels").alias("labels"), F.max(rank).alias("r"))
    return best.select("labels", "key", "ts", F.col("r.v").alias("value"), (F.col("r.s") == 1).alias("stale"))
