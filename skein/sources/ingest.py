"""Ingest formats as projections: each takes a DataFrame with one JSON payload a row and gives rows of a table.

Binary payloads become JSON by `wire.decoded` first. Payloads that do not parse, and entries without what their table needs, come back from `rejected`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import native_histogram
from ..functions.labels import NAME, key_of, no_labels, put, rekeyed

_ANY = "struct<stringValue:string,intValue:string,doubleValue:double,boolValue:boolean>"
_KV = f"array<struct<key:string,value:{_ANY}>>"
_MAP = "map<string,string>"


def _value(v: Column) -> Column:
    return F.coalesce(v["stringValue"], v["intValue"], v["doubleValue"].cast("string"), v["boolValue"].cast("string"))


def attributes(kv: Column) -> Column:
    """A map of the attributes that hold a string, number or boolean; of equal keys the last counts."""
    pairs = F.filter(F.transform(kv, lambda e: F.struct(e["key"].alias("k"), _value(e["value"]).alias("v"))), lambda p: p["v"].isNotNull())
    return F.coalesce(F.aggregate(pairs, no_labels(), lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["k"]), F.create_map(p["k"], p["v"]))), no_labels())


def stream_push(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Streams of (time in ns, line, structured metadata)."""
    body = F.from_json(column, F.lit(f"struct<streams:array<struct<stream:{_MAP},values:array<array<string>>>>>"))
    rows = payloads.select(F.explode(body["streams"]).alias("s")).select(F.col("s.stream").alias("stream"), F.explode("s.values").alias("v"))
    meta = F.coalesce(F.from_json(F.get("v", F.lit(2)), F.lit(_MAP)), no_labels())
    out = rows.select("stream", meta.alias("meta"), key_of(F.col("stream")).alias("key"), F.get("v", F.lit(0)).try_cast("long").alias("ts"), F.get("v", F.lit(1)).alias("line"))
    return out.filter("ts is not null and line is not null")


def rejected(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Payloads that are no JSON, or did not decode."""
    return payloads.filter(F.try_parse_json(column).isNull())


def rejected_entries(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """stream, n: how many entries of a stream push lack a time or a line."""
    body = F.from_json(column, F.lit(f"struct<streams:array<struct<stream:{_MAP},values:array<array<string>>>>>"))
    rows = payloads.select(F.explode(body["streams"]).alias("s")).select(key_of(F.col("s.stream")).alias("stream"), F.explode("s.values").alias("v"))
    bad = F.get("v", F.lit(0)).try_cast("long").isNull() | F.get("v", F.lit(1)).isNull()
    return rows.filter(bad).groupBy("stream").agg(F.count("*").alias("n"))


_LABELS = "array<struct<name:string,value:string>>"
_HISTOGRAM = "struct<timestamp:long,schema:int,zeroThreshold:double,zeroCount:double,count:double,sum:double,positive:map<string,double>,negative:map<string,double>>"


def _label_map(labels: Column) -> Column:
    return F.map_from_entries(F.transform(labels, lambda x: F.struct(x["name"], F.coalesce(x["value"], F.lit("")))))


def _write(payloads: DataFrame, column: str) -> DataFrame:
    series = f"struct<labels:{_LABELS},samples:array<struct<value:double,timestamp:long,stale:boolean>>,exemplars:array<struct<labels:{_LABELS},value:double,timestamp:long>>,histograms:array<{_HISTOGRAM}>>"
    return payloads.select(F.from_json(column, F.lit(f"struct<timeseries:array<{series}>,metadata:array<struct<metric:string,type:string,help:string,unit:string>>>")).alias("b"))


def remote_write(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Samples of series {labels: [{name, value}], samples: [{value, timestamp (ms)}]}; NaN with `stale` marks the end of a series."""
    rows = _write(payloads, column).select(F.explode("b.timeseries").alias("t")).select(_label_map(F.col("t.labels")).alias("labels"), F.explode("t.samples").alias("s"))
    return rekeyed(rows.select("labels", (F.col("s.timestamp") * 1_000_000).alias("ts"), F.col("s.value").alias("value"), F.coalesce("s.stale", F.lit(False)).alias("stale")))


def remote_histograms(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """The native histograms of series, as samples with a column h."""
    rows = _write(payloads, column).select(F.explode("b.timeseries").alias("t")).select(_label_map(F.col("t.labels")).alias("labels"), F.explode("t.histograms").alias("s"))
    side = lambda m: F.transform_keys(F.coalesce(m, F.create_map().cast("map<string,double>")), lambda k, v: k.cast("int"))
    h = native_histogram.struct(F.col("s.schema"), F.col("s.zeroThreshold"), F.col("s.zeroCount"), F.col("s.count"), F.col("s.sum"), side(F.col("s.positive")), side(F.col("s.negative")))
    return rekeyed(rows.select("labels", (F.col("s.timestamp") * 1_000_000).alias("ts"), F.lit(None).cast("double").alias("value"), F.lit(False).alias("stale"), h.alias("h")))


def remote_exemplars(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """labels and key of the series, exemplar (its labels), ts, value; exemplars with over 128 characters of labels are left out."""
    rows = _write(payloads, column).select(F.explode("b.timeseries").alias("t")).select(_label_map(F.col("t.labels")).alias("labels"), F.explode("t.exemplars").alias("e"))
    size = F.aggregate(F.col("e.labels"), F.lit(0), lambda a, x: a + F.length(x["name"]) + F.length(F.coalesce(x["value"], F.lit(""))))
    return rekeyed(rows.filter(F.coalesce(size, F.lit(0)) <= 128).select("labels", F.coalesce(_label_map(F.col("e.labels")), no_labels()).alias("exemplar"), (F.col("e.timestamp") * 1_000_000).alias("ts"), F.col("e.value").alias("value")))


def remote_metadata(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """metric, type, help, unit."""
    return _write(payloads, column).select(F.explode("b.metadata").alias("m")).select("m.*").distinct()


def otlp_logs(payloads: DataFrame, column: str = "payload") -> DataFrame:
    record = f"struct<timeUnixNano:string,observedTimeUnixNano:string,severityNumber:int,severityText:string,body:{_ANY},attributes:{_KV},traceId:string,spanId:string>"
    body = F.from_json(column, F.lit(f"struct<resourceLogs:array<struct<resource:struct<attributes:{_KV}>,scopeLogs:array<struct<logRecords:array<{record}>>>>>>"))
    rows = payloads.select(F.explode(body["resourceLogs"]).alias("r")).select(attributes(F.col("r.resource.attributes")).alias("resource"), F.explode(F.flatten(F.transform("r.scopeLogs", lambda s: s["logRecords"]))).alias("l"))
    stream = put(F.col("resource"), "service_name", F.coalesce(F.element_at("resource", "service.name"), F.lit("unknown_service")))
    ts = F.coalesce(F.nullif(F.col("l.timeUnixNano").try_cast("long"), F.lit(0).cast("long")), F.col("l.observedTimeUnixNano").try_cast("long"))
    meta = F.col("meta")
    rows = rows.select(stream.alias("stream"), attributes(F.col("l.attributes")).alias("meta"), ts.alias("ts"), _value(F.col("l.body")).alias("line"), F.col("l.severityNumber").alias("severity"), F.col("l.severityText").alias("severity_text"), F.col("l.traceId").alias("trace"), F.col("l.spanId").alias("id"))
    return rows.withColumn("meta", F.when(F.col("severity_text").isNotNull(), put(meta, "level", F.lower("severity_text"))).otherwise(meta)).withColumn("key", key_of(F.col("stream")))


_EXEMPLAR = f"struct<timeUnixNano:string,asDouble:double,asInt:string,spanId:string,traceId:string,filteredAttributes:{_KV}>"
_SIDE = "struct<offset:int,bucketCounts:array<string>>"


def _metrics(payloads: DataFrame, column: str) -> DataFrame:
    """job, m: metrics with their data points."""
    head = f"attributes:{_KV},timeUnixNano:string,exemplars:array<{_EXEMPLAR}>"
    number = f"struct<{head},asDouble:double,asInt:string>"
    hist = f"struct<{head},count:string,sum:double,bucketCounts:array<string>,explicitBounds:array<double>>"
    expo = f"struct<{head},count:string,sum:double,scale:int,zeroCount:string,zeroThreshold:double,positive:{_SIDE},negative:{_SIDE}>"
    summary = f"struct<{head},count:string,sum:double,quantileValues:array<struct<quantile:double,value:double>>>"
    metric = f"struct<name:string,unit:string,gauge:struct<dataPoints:array<{number}>>,sum:struct<dataPoints:array<{number}>,isMonotonic:boolean,aggregationTemporality:int>,histogram:struct<dataPoints:array<{hist}>>,exponentialHistogram:struct<dataPoints:array<{expo}>>,summary:struct<dataPoints:array<{summary}>>>"
    body = F.from_json(column, F.lit(f"struct<resourceMetrics:array<struct<resource:struct<attributes:{_KV}>,scopeMetrics:array<struct<metrics:array<{metric}>>>>>>"))
    return payloads.select(F.explode(body["resourceMetrics"]).alias("r")).select(F.element_at(attributes(F.col("r.resource.attributes")), "service.name").alias("job"), F.explode(F.flatten(F.transform("r.scopeMetrics", lambda s: s["metrics"]))).alias("m"))


def _metric_name() -> Column:
    return F.regexp_replace("m.name", r"[^a-zA-Z0-9_:]", "_")


def _metric_labels(suffix: Column, extra: tuple[str, Column] | None = None) -> Column:
    bag = put(attributes(F.col("p.attributes")), NAME, F.concat(_metric_name(), suffix))
    bag = F.when(F.col("job").isNotNull(), put(bag, "job", F.col("job"))).otherwise(bag)
    return put(bag, *extra) if extra else bag


def _total_suffix() -> Column:
    return F.when(F.col("m.sum.isMonotonic") & (F.col("m.sum.aggregationTemporality") == 2) & ~F.endswith(_metric_name(), F.lit("_total")), F.lit("_total")).otherwise(F.lit(""))


def _classic_bounds(m: DataFrame) -> DataFrame:
    """Adds buckets: (le, n) with cumulative counts, of explicit and exponential histograms; p is the data point."""
    text = lambda c: F.regexp_replace(c.cast("string"), r"\.0$", "")
    h = m.withColumn("p", F.explode("m.histogram.dataPoints"))
    bounds = F.concat(F.transform("p.explicitBounds", text), F.array(F.lit("+Inf")))
    running = lambda i: F.aggregate(F.slice("p.bucketCounts", F.lit(1), i + 1), F.lit(0.0), lambda a, c: a + c.cast("double"))
    classic = h.select("job", "m.name", F.struct("p.attributes", "p.timeUnixNano", "p.exemplars", "p.count", "p.sum").alias("point"), F.transform(bounds, lambda le, i: F.struct(le.alias("le"), running(i).alias("n"))).alias("buckets"))

    x = m.withColumn("p", F.explode("m.exponentialHistogram.dataPoints"))
    base = lambda i: F.pow(F.lit(2.0), i * F.pow(F.lit(2.0), -F.col("p.scale").cast("double")))
    side = lambda name, f: F.transform(F.coalesce(F.col(f"p.{name}.bucketCounts"), F.array().cast("array<string>")), lambda c, i: F.struct(f(F.coalesce(F.col(f"p.{name}.offset"), F.lit(0)) + i).alias("up"), c.cast("double").alias("n")))
    threshold = F.coalesce("p.zeroThreshold", F.lit(0.0))
    zero = F.array(F.struct(threshold.alias("up"), F.coalesce(F.col("p.zeroCount").cast("double"), F.lit(0.0)).alias("n")))
    down = side("negative", lambda i: F.least(-threshold, -base(i)))
    up = side("positive", lambda i: F.greatest(threshold, base(i + 1)))
    steps = F.concat(F.array_sort(F.filter(down, lambda b: b["n"] > 0)), zero, F.array_sort(F.filter(up, lambda b: b["n"] > 0)))

    def add(s: Column, b: Column) -> Column:
        total = s["total"] + b["n"]
        return F.struct(F.concat(s["rows"], F.array(F.struct(text(b["up"]).alias("le"), total.alias("n")))).alias("rows"), total.alias("total"))

    start = F.struct(F.array().cast("array<struct<le:string,n:double>>").alias("rows"), F.lit(0.0).alias("total"))
    rows = F.concat(F.aggregate(steps, start, add)["rows"], F.array(F.struct(F.lit("+Inf").alias("le"), F.col("p.count").cast("double").alias("n"))))
    expo = x.select("job", "m.name", F.struct("p.attributes", "p.timeUnixNano", "p.exemplars", "p.count", "p.sum").alias("point"), rows.alias("buckets"))
    return classic.unionByName(expo).select("job", F.struct("name").alias("m"), F.col("point").alias("p"), "buckets")


def otlp_metrics(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Gauges and sums as samples (monotonic cumulative sums get `_total`), histograms, explicit and exponential, as `_bucket`, `_count` and `_sum`, summaries with `quantile`."""
    m = _metrics(payloads, column)

    def sample(rows: DataFrame, suffix: Column, value: Column, extra: tuple[str, Column] | None = None) -> DataFrame:
        return rekeyed(rows.select(_metric_labels(suffix, extra).alias("labels"), F.col("p.timeUnixNano").cast("long").alias("ts"), value.cast("double").alias("value"), F.lit(False).alias("stale")).filter("value is not null"))

    plain = F.coalesce("p.asDouble", F.col("p.asInt").cast("double"))
    h = _classic_bounds(m)
    s = m.withColumn("p", F.explode("m.summary.dataPoints"))
    parts = [sample(m.withColumn("p", F.explode("m.gauge.dataPoints")), F.lit(""), plain), sample(m.withColumn("p", F.explode("m.sum.dataPoints")), _total_suffix(), plain)]
    parts.append(sample(h.withColumn("b", F.explode("buckets")), F.lit("_bucket"), F.col("b.n"), ("le", F.col("b.le"))))
    for rows in (h, s):
        parts += [sample(rows, F.lit("_count"), F.col("p.count")), sample(rows, F.lit("_sum"), F.col("p.sum"))]
    parts.append(sample(s.withColumn("q", F.explode("p.quantileValues")), F.lit(""), F.col("q.value"), ("quantile", F.col("q.quantile").cast("string"))))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def otlp_exemplars(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """labels and key of the series, exemplar (its labels), ts, value; one of a histogram goes to the first bucket whose bound holds its value, NaN to none."""
    m = _metrics(payloads, column)
    value = F.coalesce("e.asDouble", F.col("e.asInt").cast("double"))
    ids = F.filter(F.array(*[F.struct(F.lit(n).alias("key"), F.nullif(F.col(f"e.{c}"), F.lit("")).alias("value")) for n, c in (("trace_id", "traceId"), ("span_id", "spanId"))]), lambda x: x["value"].isNotNull())
    own = F.map_concat(attributes(F.col("e.filteredAttributes")), F.map_from_entries(ids))

    def rows(df: DataFrame, suffix: Column, extra: tuple[str, Column] | None = None) -> DataFrame:
        return rekeyed(df.select(_metric_labels(suffix, extra).alias("labels"), own.alias("exemplar"), F.col("e.timeUnixNano").cast("long").alias("ts"), value.alias("value")).filter("value is not null"))

    h = _classic_bounds(m).withColumn("e", F.explode("p.exemplars"))
    bound = lambda b: F.when(b["le"] == "+Inf", F.lit(float("inf"))).otherwise(b["le"].try_cast("double"))
    holding = F.get(F.filter("buckets", lambda b: bound(b) >= value), F.lit(0))["le"]
    placed = h.filter(~F.isnan(value)).withColumn("le", holding).filter("le is not null")
    out = rows(placed, F.lit("_bucket"), ("le", F.col("le")))
    for kind, suffix in (("gauge", F.lit("")), ("sum", _total_suffix())):
        out = out.unionByName(rows(m.withColumn("p", F.explode(f"m.{kind}.dataPoints")).withColumn("e", F.explode("p.exemplars")), suffix))
    return out


def otlp_spans(payloads: DataFrame, column: str = "payload") -> DataFrame:
    event = f"array<struct<timeUnixNano:string,name:string,attributes:{_KV}>>"
    span = f"struct<traceId:string,spanId:string,parentSpanId:string,name:string,kind:int,startTimeUnixNano:string,endTimeUnixNano:string,attributes:{_KV},status:struct<code:int,message:string>,events:{event}>"
    body = F.from_json(column, F.lit(f"struct<resourceSpans:array<struct<resource:struct<attributes:{_KV}>,scopeSpans:array<struct<spans:array<{span}>>>>>>"))
    rows = payloads.select(F.explode(body["resourceSpans"]).alias("r")).select(attributes(F.col("r.resource.attributes")).alias("resource"), F.explode(F.flatten(F.transform("r.scopeSpans", lambda s: s["spans"]))).alias("s"))
    events = F.transform("s.events", lambda e: F.struct(e["name"].alias("name"), e["timeUnixNano"].cast("long").alias("ts"), attributes(e["attributes"]).alias("attrs")))
    return rows.select(
        F.col("s.traceId").alias("trace"), F.col("s.spanId").alias("id"), F.nullif(F.col("s.parentSpanId"), F.lit("")).alias("parent"), F.col("s.name").alias("name"), F.element_at("resource", "service.name").alias("service"), F.coalesce("s.kind", F.lit(0)).alias("kind"),
        F.col("s.startTimeUnixNano").cast("long").alias("start"), F.col("s.endTimeUnixNano").cast("long").alias("end"), F.coalesce("s.status.code", F.lit(0)).alias("status"), attributes(F.col("s.attributes")).alias("attrs"), "resource", F.coalesce(events, F.array().cast("array<struct<name:string,ts:bigint,attrs:map<string,string>>>")).alias("events"),
    )


_SECRET = r"(?i)((?:password|passwd|secret|token|api_?key|authorization)[\"']?\s*[:=]\s*[\"']?)[^\"'&\s,}]+"


def error_events(payloads: DataFrame, column: str = "payload") -> DataFrame:
    """Error rows (ts, project, kind, place, message) of event payloads; values behind secret names are masked."""
    frame = "struct<function:string,filename:string,in_app:boolean>"
    body = F.from_json(column, F.lit(f"struct<event_id:string,timestamp:double,project:string,level:string,exception:struct<values:array<struct<type:string,value:string,stacktrace:struct<frames:array<{frame}>>>>>,message:string>"))
    rows = payloads.select(body.alias("e")).filter("e is not null and e.timestamp is not null")
    last = F.get(F.reverse("e.exception.values"), F.lit(0))
    own = F.get(F.reverse(F.filter(last["stacktrace"]["frames"], lambda f: F.coalesce(f["in_app"], F.lit(False)))), F.lit(0))
    place = F.when(own.isNotNull(), F.concat_ws(":", own["filename"], own["function"]))
    message = F.regexp_replace(F.coalesce(last["value"], F.col("e.message"), F.lit("")), _SECRET, "$1[masked]")
    return rows.select(F.round(F.col("e.timestamp") * 1e9).cast("long").alias("ts"), F.col("e.project").alias("project"), last["type"].alias("kind"), place.alias("place"), message.alias("message"))
