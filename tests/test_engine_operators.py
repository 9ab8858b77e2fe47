import json


import pytest
from pyspark.sql import functions as F

from skein.functions.labels import NAME, rekeyed
from skein.operators import discovery, errors, patterns, rollups, rules
from skein.plans.grid import Grid
from skein.plans.promql import MetricPlanner
from skein.plans.traceql import TracePlanner, assemble, neighbourhood, parse
from skein.sources import ingest, tables
from skein.sources.tables import event_logs, event_samples
from skein.streaming import jobs

S, DATA = 10**9, "/root/testdata/sf0.001"
HOUR = 3600 * S


def spans_of(spark, rows):
    """(trace, id, parent)"""
    full = [(t, i, p, f"n{i}", "svc", 2, 0, 10, 1, {}, {}, []) for t, i, p in rows]
    return spark.createDataFrame(full, "trace string, id string, parent string, name string, service string, kind int, start long, end long, status int, attrs map<string,string>, resource map<string,string>, events array<struct<name:string,ts:bigint,attrs:map<string,string>>>")


def test_structural_relations(spark):
    spans = spans_of(spark, [("t", "1", None), ("t", "2", "1"), ("t", "3", "2"), ("t", "4", "1"), ("t", "9", "lost"), ("u", "2", None)])
    ids = lambda q: sorted((r.trace, r.id) for r in TracePlanner(spans).select(parse(q)).collect())
    assert ids('{name="n1"} >> {}') == [("t", "2"), ("t", "3"), ("t", "4")]
    assert ids('{name="n3"} << {}') == [("t", "1"), ("t", "2")]
    assert ids('{name="n2"} ~ {}') == [("t", "4")]
    assert ids('{name="n1"} > {} > {}') == [("t", "3")]
    assert ids("{} < {}") == [("t", "1"), ("t", "2")]
    a = {r.trace: r for r in assemble(spans).collect()}
    assert (a["t"].missing_parents, a["t"].roots, a["u"].spans) == (1, 1, 1)
    assert sorted(r.id for r in neighbourhood(spans, "t", '{name="n2"}', 1, 1).collect()) == ["1", "2", "3"]


def test_cycles_end(spark):
    spans = spans_of(spark, [("t", "1", "2"), ("t", "2", "1")])
    assert len(TracePlanner(spans).select(parse("{} >> {}")).collect()) == 2


@pytest.mark.parametrize("name", ["rate", "increase", "delta", "changes", "resets", "min_over_time", "max_over_time", "first_over_time", "last_over_time", "count_over_time"])
def test_hours_equal_raw(spark, name):
    samples = event_samples(spark, DATA)
    start = 1704067200 * S + 48 * HOUR
    grid = Grid(start, start + 96 * HOUR, 12 * HOUR)
    raw = MetricPlanner(samples, grid).run(f"{name}(events_value[24h])")
    fast = rollups.hours_over_time(rollups.metric_hours(samples), name, grid, 24 * HOUR)
    key = F.element_at("labels", "event_type").alias("e")
    diff = discovery.compare(raw.select(key, "step", "value"), fast.select(key, "step", "value"), ["e", "step"])
    assert raw.count() > 10 and diff.count() == 0


def test_stale_minutes(spark):
    logs = event_logs(spark, DATA)
    minutes = rollups.log_minutes(logs)
    assert rollups.stale_minutes(minutes, logs).count() == 0
    assert rollups.stale_minutes(minutes, logs.limit(500)).count() > 0
    with pytest.raises(ValueError):
        rollups.count_over_time(minutes, Grid(1, 10 * 60 * S, 60 * S), 60 * S)


def test_lifecycle():
    rule = rules.Threshold("gt", 1.0, hold=2, keep=2)
    state, names = rules.State(), []
    for ts, v in enumerate([0, 2, 2, 2, 0, 0, 0, 2, None, 5]):
        state = rules.advance(rule, state, ts, v)
        names.append(state.name)
    assert names == ["inactive", "pending", "pending", "firing", "recovering", "resolved", "inactive", "pending", "inactive", "pending"]


def test_lifecycle_frame_and_stream(spark, tmp_path):
    ticks = spark.createDataFrame([(k, t, float(t % 3)) for k in "ab" for t in range(9)], "key string, ts long, value double")
    rule = rules.Threshold("gt", 0.5, hold=1)
    batch = sorted((r.key, r.ts, r.state) for r in rules.lifecycle(ticks, rule).collect())
    ticks.write.parquet(str(tmp_path / "in"))
    stream = jobs.lifecycle_stream(spark.readStream.schema(ticks.schema).parquet(str(tmp_path / "in")), rule)
    q = stream.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.key, r.ts, r.state) for r in spark.table("states").collect()) == batch


def test_tail_and_minutes_stream(spark, tmp_path):
    logs = event_logs(spark, DATA)
    logs.write.parquet(str(tmp_path / "in"))
    source = lambda: spark.readStream.schema(logs.schema).parquet(str(tmp_path / "in"))
    for name, df in (("tail", jobs.tail(source(), '{event_type="error"} | logfmt | level="error"')), ("minutes", jobs.minute_rollup(source()))):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").option("checkpointLocation", str(tmp_path / name)).start()
        q.processAllAvailable()
        q.stop()
    assert spark.table("tail").count() == logs.filter("stream['event_type'] = 'error'").count()
    total = spark.table("minutes").agg(F.sum("count")).first()[0]
    assert 0 < total <= logs.count()


def test_recording_marks_gone_series(spark):
    s = rekeyed(spark.createDataFrame([({NAME: "a", "x": "1"}, 0, 1.0, False)], "labels map<string,string>, ts long, value double, stale boolean"))
    before = rekeyed(spark.createDataFrame([({NAME: "r", "x": x}, 0, 1.0, False) for x in "12"], "labels map<string,string>, ts long, value double, stale boolean"))
    out = {r.labels["x"]: r.stale for r in rules.record(s, "r", "a * 2", 10 * S, previous=before).collect()}
    assert out == {"1": False, "2": True}


def test_expression_math(spark):
    frame = lambda rows: rekeyed(spark.createDataFrame(rows, "labels map<string,string>, value double"))
    a, b = frame([({"x": "1"}, 4.0), ({"x": "2"}, 9.0)]), frame([({}, 2.0)])
    out = {r.labels["x"]: r.value for r in rules.math("$A ** 2 / ${B} > 10 && !($A == 4)", {"A": a, "B": b}).collect()}
    assert out == {"1": 0.0, "2": 1.0}


def test_issues_and_jumps(spark):
    rows = [(t * 60 * S, "p", "E", None, f"failed {t} at 0xAB{t}") for t in [*range(5), *[5] * 20]]
    df = spark.createDataFrame(rows, "ts long, project string, kind string, place string, message string")
    assert errors.issues(df).count() == 1
    assert errors.rate_jumps(df, ["project"]).collect()[0].current == 20


def test_patterns(spark):
    rows = [(i * S, f"user {i} logged in from host{i % 3}") for i in range(30)] + [(i * S, "cache miss for key") for i in range(5)] + [(0, "one")]
    logs = spark.createDataFrame(rows, "ts long, line string")
    out = {r.pattern: r["count"] for r in patterns.log_patterns(logs, 3600 * S).collect()}
    assert out == {"user <_> logged in from <_>": 30, "cache miss for key": 5}


def test_ingest_logs_and_streams(spark):
    streams = json.dumps({"streams": [{"stream": {"app": "x"}, "values": [["5", "hello"], ["6", "again", '{"id": "1"}'], ["bad", "z"]]}]})
    otlp = json.dumps({"resourceLogs": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}]}, "scopeLogs": [{"logRecords": [{"timeUnixNano": "7", "severityText": "WARN", "body": {"stringValue": "hi"}, "attributes": [{"key": "n", "value": {"intValue": "3"}}]}]}]}]})
    df = spark.createDataFrame([(streams,), ("{",)], "payload string")
    out = ingest.stream_push(df).orderBy("ts").collect()
    assert [(r.ts, r.line, r.meta) for r in out] == [(5, "hello", {}), (6, "again", {"id": "1"})]
    assert ingest.rejected(df).count() == 1
    r = ingest.otlp_logs(spark.createDataFrame([(otlp,)], "payload string")).first()
    assert (r.ts, r.line, r.meta, r.stream["service_name"]) == (7, "hi", {"n": "3", "level": "warn"}, "s")


def test_ingest_metrics(spark):
    point = {"timeUnixNano": "1"}
    body = {"resourceMetrics": [{"resource": {"attributes": []}, "scopeMetrics": [{"metrics": [
        {"name": "g", "gauge": {"dataPoints": [point | {"asDouble": 2.5}]}}, {"name": "c", "sum": {"isMonotonic": True, "aggregationTemporality": 2, "dataPoints": [point | {"asInt": "4"}]}},
        {"name": "h", "histogram": {"dataPoints": [point | {"count": "3", "sum": 6.0, "bucketCounts": ["1", "2"], "explicitBounds": [5.0]}]}}, {"name": "q", "summary": {"dataPoints": [point | {"count": "2", "sum": 1.0, "quantileValues": [{"quantile": 0.5, "value": 7.0}]}]}},
    ]}]}]}
    out = ingest.otlp_metrics(spark.createDataFrame([(json.dumps(body),)], "payload string")).collect()
    got = {(r.labels[NAME], r.labels.get("le", r.labels.get("quantile", ""))): r.value for r in out}
    assert got == {("g", ""): 2.5, ("c_total", ""): 4.0, ("h_bucket", "5"): 1.0, ("h_bucket", "+Inf"): 3.0, ("h_count", ""): 3.0, ("h_sum", ""): 6.0, ("q_count", ""): 2.0, ("q_sum", ""): 1.0, ("q", "0.5"): 7.0}
    write = json.dumps({"timeseries": [{"labels": [{"name": NAME, "value": "a"}], "samples": [{"value": 1.0, "timestamp": 2}]}]})
    assert ingest.remote_write(spark.createDataFrame([(write,)], "payload string")).first().ts == 2_000_000


def test_ingest_spans_and_errors(spark):
    span = {"traceId": "t", "spanId": "s", "parentSpanId": "", "name": "n", "startTimeUnixNano": "1", "endTimeUnixNano": "9", "events": [{"timeUnixNano": "2", "name": "e", "attributes": [{"key": "k", "value": {"boolValue": True}}]}]}
    body = json.dumps({"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [span]}]}]})
    spans = ingest.otlp_spans(spark.createDataFrame([(body,)], "payload string"))
    assert TracePlanner(spans).select(parse('{ event.k = "true" && nestedSetParent < 0 }')).count() == 1
    event = json.dumps({"timestamp": 1.5, "project": "p", "exception": {"values": [{"type": "E", "value": "token=abc123 lost", "stacktrace": {"frames": [{"function": "f", "filename": "a.py", "in_app": True}]}}]}})
    r = ingest.error_events(spark.createDataFrame([(event,)], "payload string")).first()
    assert (r.ts, r.kind, r.place, r.message) == (1_500_000_000, "E", "a.py:f", "token=[masked] lost")


def test_tables_on_storage(spark, tmp_path):
    logs = event_logs(spark, DATA)
    path = str(tmp_path / "logs")
    tables.write(logs, path, "logs")
    start = 1704067200 * S + 48 * HOUR
    part = tables.read(spark, path, start, start + 24 * HOUR)
    assert part.count() == logs.filter((F.col("ts") >= start) & (F.col("ts") <= start + 24 * HOUR)).count() > 0
    assert "PartitionFilters: [isnotnull(day" in part._jdf.queryExecution().toString()
    for _ in range(2):
        tables.append_once(logs.limit(10), str(tmp_path / "once"), "logs", "k1")
    assert spark.read.parquet(str(tmp_path / "once")).count() == 10


@pytest.mark.parametrize("most", [4, 500])
def test_patterns_of_a_large_shape_in_segments(spark, most):
    """As if one task read all lines, also where clusters change late or leave, and beside small shapes."""
    word = lambda i: F.element_at(F.array(*[F.lit(w) for w in "abcdefg"]), (F.pmod(F.xxhash64("id", F.lit(i)), F.lit(7)) + 1).cast("int"))
    text = F.when(F.col("id") < 500, F.concat_ws(" ", F.lit("a"), *[word(i) for i in range(4)])).when(F.col("id") < 1500, F.lit("a b b b b")).otherwise(F.concat_ws(" ", word(9), *[word(i) for i in range(4)]))
    line = F.when(F.col("id") % 50 == 7, F.concat(F.lit("k="), F.col("id").cast("string"))).when(F.col("id") % 50 == 8, F.concat(F.lit("got "), F.col("id").cast("string"), F.lit(": x"))).otherwise(text)
    logs = spark.range(2500).select((F.col("id") * S).alias("ts"), line.alias("line"))
    rows = lambda **how: sorted((r.pattern, r.step, r["count"]) for r in patterns.log_patterns(logs, 600 * S, most=most, **how).collect())
    one = rows()
    assert sum(r[2] for r in one) == 2500
    assert rows(together=45, segment=260) == one


def test_metadata_keeps_newest_variants(spark):
    rows = [("m", "gauge", f"h{i}", "", i * S) for i in range(10)]
    out = discovery.metric_metadata(spark.createDataFrame(rows, "metric string, type string, help string, unit string, ts long"), 10 * S)
    assert sorted(r.help for r in out.collect()) == [f"h{i}" for i in range(2, 10)]



def test_log_records_mirror_service_and_level(spark):
    from skein.sources.model import as_log_records

    df = spark.createDataFrame([(1, "api", "WARN", "hi", "t1", "", {"level": "x", "a": "1"}, {"env": "p", "level": "old"})], "ts long, service string, severity_text string, body string, trace_id string, span_id string, attributes map<string,string>, resource map<string,string>")
    r = as_log_records(df).first()
    assert r.stream == {"env": "p", "service": "api", "service_name": "api", "level": "WARN", "detected_level": "WARN"}
    assert r.meta == {"level": "x", "a": "1", "trace_id": "t1"}
