"""What labels, fields and volumes there are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.labels import NAME, matches, value_of


def _between(df: DataFrame, start: int | None, end: int | None) -> DataFrame:
    if start is not None:
        df = df.filter(F.col("ts") >= start)
    return df.filter(F.col("ts") <= end) if end is not None else df


def _selected(df: DataFrame, matchers: list[tuple[str, str, str]], column: str) -> DataFrame:
    for name, op, value in matchers:
        df = df.filter(matches(value_of(F.col(column), name), op, value))
    return df


def label_names(df: DataFrame, column: str = "labels", matchers=(), start: int | None = None, end: int | None = None) -> DataFrame:
    rows = _selected(_between(df, start, end), list(matchers), column)
    return rows.select(F.explode(F.map_keys(column)).alias("name")).distinct()


def label_values(df: DataFrame, name: str, column: str = "labels", matchers=(), start: int | None = None, end: int | None = None) -> DataFrame:
    rows = _selected(_between(df, start, end), list(matchers), column)
    return rows.select(F.element_at(column, name).alias("value")).filter("value is not null and value <> ''").distinct()


def series(df: DataFrame, column: str = "labels", matchers=(), start: int | None = None, end: int | None = None) -> DataFrame:
    """Each distinct label set once; the key stands for the set."""
    rows = _selected(_between(df, start, end), list(matchers), column)
    return rows.groupBy("key").agg(F.first(column).alias("labels"))


def index_stats(logs: DataFrame, matchers=(), start: int | None = None, end: int | None = None) -> DataFrame:
    """streams, entries, bytes: exact counts over the rows of the window."""
    rows = _selected(_between(logs, start, end), list(matchers), "stream")
    return rows.groupBy("key").agg(F.count("*").alias("entries"), F.sum(F.octet_length("line")).alias("bytes")).agg(F.count("*").alias("streams"), F.sum("entries").alias("entries"), F.sum("bytes").alias("bytes"))


def volume(logs: DataFrame, names: list[str], limit: int = 100, bucket: int | None = None, matchers=(), start: int | None = None, end: int | None = None) -> DataFrame:
    """Bytes by the values of some labels; with a bucket (ns), for each bucket of time, too."""
    rows = _selected(_between(logs, start, end), list(matchers), "stream")
    keys = [value_of(F.col("stream"), n).alias(n) for n in names]
    if bucket:
        keys.append((F.col("ts") - F.pmod("ts", F.lit(bucket))).alias("bucket"))
    out = rows.groupBy(*keys).agg(F.sum(F.octet_length("line")).alias("bytes"))
    if bucket:
        rank = F.row_number().over(Window.partitionBy("bucket").orderBy(F.col("bytes").desc(), *names))
        return out.withColumn("rank", rank).filter(F.col("rank") <= limit).drop("rank")
    return out.orderBy(F.col("bytes").desc(), *names).limit(limit)


def label_volume(logs: DataFrame, limit: int = 100) -> DataFrame:
    """Bytes of the entries that have a label, for each label name."""
    rows = logs.select(F.explode(F.map_keys("stream")).alias("name"), F.octet_length("line").alias("b"))
    return rows.groupBy("name").agg(F.sum("b").alias("bytes")).orderBy(F.col("bytes").desc(), "name").limit(limit)


_ID_LIKE = r"^(?:\d+|[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12})$"


def detected_labels(logs: DataFrame) -> DataFrame:
    """Stream labels and how many values each has, without those whose values are all numbers or UUIDs."""
    rows = logs.select("key", "stream").groupBy("key").agg(F.first("stream").alias("stream")).select(F.explode("stream").alias("name", "value"))
    return rows.groupBy("name").agg(F.count_distinct("value").alias("cardinality"), F.bool_and(F.col("value").rlike(_ID_LIKE)).alias("ids")).filter("not ids").drop("ids")


def field_type(values: Column) -> Column:
    """int, float, boolean, duration, bytes or string: the narrowest that all values have (an aggregate)."""
    every = lambda r: F.bool_and(values.rlike(r))
    return (
        F.when(every(r"^[-+]?\d{1,18}$"), "int").when(every(r"^[-+]?(?:\d+\.?\d*|\.\d+)(?:[eE][-+]?\d+)?$"), "float").when(every(r"^(?:true|false)$"), "boolean")
        .when(every(r"^[-+]?(?:\d+(?:\.\d*)?(?:ns|us|µs|ms|s|m|h))+$"), "duration").when(every(r"^(?i:\d+(?:\.\d+)?\s?(?:[kmgtp]i?)?b)$"), "bytes").otherwise("string")
    )


def detected_fields(logs: DataFrame, lines: int = 1000, limit: int = 1000) -> DataFrame:
    """Fields of the newest lines, parsed as JSON or else logfmt: name, parser, type, cardinality. The line limit is the feature."""
    from ..plans.logql import _json_map, logfmt_map

    newest = logs.orderBy(F.col("ts").desc(), "line").limit(lines).withColumn("json", _json_map("line"))
    parsed = newest.select(F.when(F.col("json").isNotNull(), F.lit("json")).otherwise(F.lit("logfmt")).alias("parser"), F.coalesce("json", logfmt_map(F.col("line"), False)).alias("fields"))
    rows = parsed.select("parser", F.explode("fields").alias("name", "value"))
    return rows.groupBy("name").agg(F.array_join(F.array_sort(F.collect_set("parser")), ",").alias("parsers"), field_type(F.col("value")).alias("type"), F.count_distinct("value").alias("cardinality")).orderBy("name").limit(limit)


def span_tags(spans: DataFrame) -> DataFrame:
    """scope, name of all attributes of spans, resources and events."""
    scopes = [("span", F.map_keys("attrs")), ("resource", F.map_keys("resource")), ("event", F.flatten(F.transform("events", lambda e: F.map_keys(e["attrs"]))))]
    named = F.array(*[F.struct(F.lit(s).alias("scope"), k.alias("names")) for s, k in scopes])
    return spans.select(F.explode(named).alias("s")).select("s.scope", F.explode("s.names").alias("name")).distinct()


def span_tag_values(spans: DataFrame, field: str, query: str | None = None) -> DataFrame:
    from ..plans.traceql import TracePlanner, field_text, parse

    rows = TracePlanner(spans).matched(parse(query)) if query else spans
    return rows.select(field_text(field).alias("value")).filter("value is not null").distinct()


def root_values(spans: DataFrame, what: str) -> DataFrame:
    """Distinct root_name, root_service or trace_duration of whole traces."""
    from ..plans.traceql import trace_context

    return trace_context(spans).select(F.col(what).alias("value")).filter("value is not null").distinct()


def detected_field_values(logs: DataFrame, name: str, lines: int = 1000, limit: int = 1000) -> DataFrame:
    """Values of one field of the newest lines."""
    from ..plans.logql import _json_map, logfmt_map

    newest = logs.orderBy(F.col("ts").desc(), "line").limit(lines)
    fields = F.coalesce(_json_map("line"), logfmt_map(F.col("line"), False))
    return newest.select(F.element_at(fields, name).alias("value")).filter("value is not null").distinct().orderBy("value").limit(limit)


def metric_metadata(rows: DataFrame, at: int, days: int = 30, most: int = 8) -> DataFrame:
    """metric and its newest variants (type, help, unit) seen within some days, from rows (metric, type, help, unit, ts)."""
    fresh = rows.filter(F.col("ts") > at - days * 86400 * 10**9)
    variants = fresh.groupBy("metric", "type", "help", "unit").agg(F.max("ts").alias("ts"))
    rank = F.row_number().over(Window.partitionBy("metric").orderBy(F.col("ts").desc(), "type", "help", "unit"))
    return variants.withColumn("rank", rank).filter(F.col("rank") <= most).drop("rank")


def exemplars(samples: DataFrame, metric: str) -> DataFrame:
    """labels, exemplar rows of one metric, from samples with an exemplars array."""
    return samples.filter(value_of(F.col("labels"), NAME) == metric).select("labels", F.explode("exemplars").alias("exemplar"))


def usage(logs: DataFrame, tenant: Column) -> DataFrame:
    """Entries and bytes by tenant and hour."""
    hour = F.col("ts") - F.pmod("ts", F.lit(3600 * 10**9))
    return logs.groupBy(tenant.alias("tenant"), hour.alias("hour")).agg(F.count("*").alias("entries"), F.sum(F.octet_length("line")).alias("bytes"))


def compare(left: DataFrame, right: DataFrame, keys: list[str], tolerance: float = 1e-9) -> DataFrame:
    """Rows in which two results (keys, value) differ: missing on a side, or apart by more than the tolerance (relative above 1)."""
    both = left.select(*keys, F.col("value").alias("l")).join(right.select(*keys, F.col("value").alias("r")), keys, "full_outer")
    same = (F.abs(F.col("l") - F.col("r")) <= tolerance * F.greatest(F.lit(1.0), F.abs("l"), F.abs("r"))) | (F.isnan("l") & F.isnan("r")) | F.col("l").eqNullSafe(F.col("r"))
    return both.filter(~F.coalesce(same, F.lit(False)))
