"""Binary payloads, rule files, strict and local trace searches, envelopes, tail delivery, compaction, and templates with loops."""

import json
import math
import struct

import pytest
from pyspark.sql import functions as F

from skein.functions.labels import NAME, rekeyed
from skein.functions.template_loops import Template, TemplateError, needs_loops
from skein.operators import errors, rollups, rule_files, rules
from skein.plans import envelope
from skein.plans.grid import Grid
from skein.plans.logql import LogPlanner
from skein.plans.traceql import TracePlanner, default_step, metric_window, trace_json
from skein.sources import ingest, tables, wire
from skein.sources.tables import conversation_spans, event_logs
from skein.streaming import jobs

S = 10**9
SF = "/root/testdata/sf0.001"


def varint(x):
    x &= (1 << 64) - 1
    out = b""
    while x > 127:
        out, x = out + bytes([x & 127 | 128]), x >> 7
    return out + bytes([x])


def f(number, value, kind=None):
    """A protobuf field: bytes and text by length, floats as doubles, kind "fixed" for 8-byte numbers."""
    if isinstance(value, str):
        value = value.encode()
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    if isinstance(value, float) or kind == "fixed":
        return varint(number << 3 | 1) + (struct.pack("<d", value) if isinstance(value, float) else struct.pack("<Q", value))
    return varint(number << 3) + varint(value)


def zig(x):
    return (x << 1) ^ (x >> 63)


def snappy(raw):
    import pyarrow as pa

    return pa.compress(raw, codec="snappy", asbytes=True)


def label(k, v):
    return f(1, k) + f(2, v)


def test_log_push_protobuf(spark):
    entry = f(1, f(1, 5) + f(2, 7)) + f(2, "hello") + f(3, label("id", "1"))
    body = f(1, f(1, '{app="x", env="p"}') + f(2, entry) + f(99, b"unknown"))
    df = spark.createDataFrame([(snappy(body),), (b"\xff\xff",)], "payload binary")
    decoded = wire.decoded(df, "log_push", snappy=True)
    r = ingest.stream_push(decoded).first()
    assert (r.ts, r.line, r.stream, r.meta) == (5 * S + 7, "hello", {"app": "x", "env": "p"}, {"id": "1"})
    assert ingest.rejected(decoded).count() == 1
    bad = spark.createDataFrame([(json.dumps({"streams": [{"stream": {"a": "1"}, "values": [["1", "x"], ["z", "y"]]}]}),)], "payload string")
    assert [(r.stream, r.n) for r in ingest.rejected_entries(bad).collect()] == [("a\x011", 1)]


def test_remote_write_v1_and_v2(spark):
    stale = varint(1 << 3 | 1) + struct.pack("<Q", wire.STALE)
    histogram = f(1, 5) + f(3, 9.5) + f(4, zig(0)) + f(5, 0.001) + f(6, 1) + f(11, f(1, zig(1)) + f(2, 2)) + f(12, varint(zig(3)) + varint(zig(-2))) + f(15, 4)
    series = f(1, label(NAME, "m")) + f(2, f(1, 1.5) + f(2, 2)) + f(2, stale + f(2, 3)) + f(3, f(1, label("trace_id", "t")) + f(2, 7.0) + f(3, 2)) + f(4, histogram)
    v1 = f(1, series) + f(3, f(1, 1) + f(2, "m") + f(4, "help") + f(5, "s"))
    symbols = ["", NAME, "m", "help", "s", "trace_id", "t"]
    v2 = b"".join(f(4, x) for x in symbols) + f(5, f(1, varint(1) + varint(2)) + f(2, f(1, 1.5) + f(2, 2)) + f(2, stale + f(2, 3)) + f(3, histogram) + f(4, f(1, varint(5) + varint(6)) + f(2, 7.0) + f(3, 2)) + f(5, f(1, 1) + f(3, 3) + f(4, 4)))
    for form, raw in (("write_v1", v1), ("write_v2", v2)):
        df = wire.decoded(spark.createDataFrame([(snappy(raw),)], "payload binary"), form, snappy=True)
        rows = sorted((r.ts, r.stale, None if math.isnan(r.value) else r.value, r.labels[NAME]) for r in ingest.remote_write(df).collect())
        assert rows == [(2_000_000, False, 1.5, "m"), (3_000_000, True, None, "m")]
        h = ingest.remote_histograms(df).first()
        assert h.ts == 4_000_000 and h.h.pos == {1: 3.0, 2: 1.0} and h.h.zero_count == 1 and h.h.sum == 9.5 and h.h["count"] == 5
        assert [tuple(r) for r in ingest.remote_metadata(df).collect()] == [("m", "counter", "help", "s")]
        e = ingest.remote_exemplars(df).first()
        assert (e.exemplar, e.value, e.ts) == ({"trace_id": "t"}, 7.0, 2_000_000)


def test_otlp_protobuf(spark):
    resource = f(1, f(1, f(1, "service.name") + f(2, f(1, "svc"))))
    record = f(1, 7, "fixed") + f(3, "WARN") + f(5, f(1, "hi")) + f(6, f(1, "n") + f(2, f(3, 3))) + f(9, b"\x01\x02")
    logs = wire.decoded(spark.createDataFrame([(f(1, resource + f(2, f(2, record))),)], "payload binary"), "otlp_logs")
    r = ingest.otlp_logs(logs).first()
    assert (r.ts, r.line, r.meta, r.trace, r.stream["service_name"]) == (7, "hi", {"n": "3", "level": "warn"}, "0102", "svc")
    span = f(1, b"\xaa") + f(2, b"\xbb") + f(5, "op") + f(6, 2) + f(7, 1, "fixed") + f(8, 9, "fixed") + f(15, f(3, 2)) + f(11, f(1, 2, "fixed") + f(2, "e"))
    s = ingest.otlp_spans(wire.decoded(spark.createDataFrame([(f(1, resource + f(2, f(2, span))),)], "payload binary"), "otlp_traces")).first()
    assert (s.trace, s.id, s.name, s.kind, s.start, s.end, s.status, s.events[0].name) == ("aa", "bb", "op", 2, 1, 9, 2, "e")
    point = f(3, 5, "fixed") + f(4, 6, "fixed") + f(5, 12.0) + f(6, struct.pack("<QQQ", 1, 2, 3)) + f(7, struct.pack("<dd", 1.0, 5.0)) + f(8, f(2, 4, "fixed") + f(3, 3.0) + f(5, b"\x0f")) + f(8, f(3, 99.0) + f(2, 4, "fixed"))
    expo = f(3, 5, "fixed") + f(4, 4, "fixed") + f(6, zig(0)) + f(7, 1, "fixed") + f(8, f(1, zig(0)) + f(2, varint(1) + varint(0) + varint(1))) + f(9, f(1, zig(1)) + f(2, varint(1)))
    body = f(1, f(2, f(2, f(1, "h") + f(9, f(1, point))) + f(2, f(1, "x") + f(10, f(1, expo)))))
    df = wire.decoded(spark.createDataFrame([(body,)], "payload binary"), "otlp_metrics")
    got = {(r.labels[NAME], r.labels.get("le", "")): r.value for r in ingest.otlp_metrics(df).collect()}
    assert got == {("h_bucket", "1"): 1, ("h_bucket", "5"): 3, ("h_bucket", "+Inf"): 6, ("h_count", ""): 6, ("h_sum", ""): 12, ("x_bucket", "-2"): 1, ("x_bucket", "0"): 2, ("x_bucket", "2"): 3, ("x_bucket", "8"): 4, ("x_bucket", "+Inf"): 4, ("x_count", ""): 4}
    placed = {(r.labels["le"], r.value): r.exemplar for r in ingest.otlp_exemplars(df).collect()}
    assert placed == {("5", 3.0): {"trace_id": "0f"}, ("+Inf", 99.0): {}}


def test_bad_bytes():
    for raw in (b"\x0a\xff", b"\x0f", b"\x80" * 11):
        assert wire.to_json(raw, "otlp_logs") is None
    assert wire.to_json(None, "otlp_logs") is None and wire.to_json(b"", "otlp_logs") == "{}"


def test_rule_files(spark):
    text = """
groups:
  - name: g
    interval: 30s
    labels: {team: a}
    rules:
      - record: "job:x:sum"
        expr: sum(x) * 2
        labels: {zone: b}
      - alert: Down
        expr: up == 0
      - record: broken
        expr: "sum("
  - name: late
    query_offset: 1m
    rules: [{record: r, expr: x}]
"""
    groups, skipped = rule_files.import_rules(text)
    assert [(g.name, g.cadence, g.rules) for g in groups] == [("g", 30 * S, [("job:x:sum", "sum(x) * 2", {"team": "a", "zone": "b"})])]
    assert [s["reason"] for s in skipped] == ["alerting_rule", "invalid_expression", "query_offset_unsupported"]
    x = rekeyed(spark.createDataFrame([({NAME: "x"}, 0, 4.0, False)], "labels map<string,string>, ts long, value double, stale boolean"))
    r = rules.record_group(x, groups[0].rules, 10 * S).first()
    assert r.value == 8 and r.labels == {NAME: "job:x:sum", "team": "a", "zone": "b"}
    export = json.dumps({"groups": [{"name": "e", "rules": [{"title": "t", "record": {"metric": "m", "from": "A"}, "data": [{"refId": "A", "datasourceUid": "p", "model": {"expr": "x", "instant": True}}]}]}]})
    assert rule_files.import_rules(export)[0][0].rules == [("m", "x", {})]
    with pytest.raises(rule_files.ImportError_):
        rule_files.import_rules("[1]")
    graph = {"condition": "C", "data": [
        {"refId": "A", "datasourceUid": "p", "model": {"expr": "x"}}, {"refId": "R", "datasourceUid": "__expr__", "model": {"type": "reduce", "reducer": "last", "expression": "A"}},
        {"refId": "B", "datasourceUid": "__expr__", "model": {"type": "math", "expression": "$R * 2"}}, {"refId": "C", "datasourceUid": "__expr__", "model": {"type": "threshold", "expression": "B", "conditions": [{"evaluator": {"type": "gt", "params": [7]}}]}},
    ]}
    source = lambda uid, q: x.select("labels", F.col("ts").alias("step"), "value")
    assert rule_files.preview(graph, source).first().value == 1.0


def test_trace_windows_and_filters(spark):
    assert default_step(0, 3600 * S) == 15 * S and default_step(0, 30 * S) == 100_000_000 and default_step(0, 86400 * S) == 300 * S
    assert metric_window(100 * S, 205 * S, 10 * S) == Grid(90 * S, 210 * S, 10 * S)
    spans = conversation_spans(spark, SF)
    p = TracePlanner(spans)
    assert p.find(root_only=True).count() == spans.filter("parent is null").count()
    assert p.find(service="front", status=2, min_duration=900 * 10**6).count() == spans.filter("service = 'front' and status = 2 and end - start >= 900000000").count()
    newest = [r.start for r in p.find(limit=5, resource={"region": "r1"}).collect()]
    assert newest == sorted((r.start for r in spans.filter("resource['region'] = 'r1'").collect()), reverse=True)[:5]
    low, high = 0, 1 << 62
    out = p.window_search("{ status = error }", low, high, 3).collect()
    bad = spans.filter("status = 2").groupBy("trace").count()
    assert len(out) == min(3, bad.count()) and out[0].matched_traces == bad.count()
    assert {r.trace: r.matching_spans for r in out}.items() <= {r.trace: r["count"] for r in bad.collect()}.items()


def test_strict_search(spark):
    kind = "trace string, id string, parent string, name string, service string, kind int, start long, end long, status int, attrs map<string,string>, resource map<string,string>, events array<struct<name:string,ts:bigint,attrs:map<string,string>>>"
    row = lambda t, i, p, a, b: (t, i, p, "n", "s", 2, a, b, 0, {}, {}, [])
    fine = spark.createDataFrame([row("a", "1", None, 5, 9), row("a", "2", "1", 6, 8)], kind)
    assert TracePlanner(fine).search("{ name = \"n\" }", 0, 100, strict=True).count() == 1
    broken = fine.union(spark.createDataFrame([row("b", "1", None, 5, 9), row("b", "2", None, 5, 9), row("c", "1", None, 9, 5), row("d", "1", None, 0, 5), row("e", "1", None, 1, 1 + (1 << 32) * 1_000_000)], kind))
    assert {r.trace: r.problem for r in TracePlanner(broken).integrity("{ name = \"n\" }", 0, 100).collect()} == {"b": "trace_root_conflict", "c": "trace_metadata_unknown", "d": "trace_timestamp_unknown", "e": "trace_duration_limit"}
    with pytest.raises(Exception, match="trace_"):
        TracePlanner(broken).search("{ name = \"n\" }", 0, 100, strict=True).collect()
    body = json.loads(trace_json(fine, "a").first().json)
    assert [s["spanId"] for s in body["trace"]["resourceSpans"][0]["scopeSpans"][0]["spans"]] == ["1", "2"]
    assert "batches" in json.loads(trace_json(fine, "a", 1).first().json)


def test_envelopes(spark):
    rows = spark.createDataFrame([({"b": "1", "a": "x"}, 2 * S, 1.5), ({"b": "1", "a": "x"}, S, math.inf), ({}, S, 3.0)], "labels map<string,string>, step long, value double")
    out = json.loads(envelope.envelope(envelope.matrix_rows(rows), "matrix").first().json)
    assert out == {"status": "success", "data": {"resultType": "matrix", "result": [{"metric": {}, "values": [[1, "3"]]}, {"metric": {"a": "x", "b": "1"}, "values": [[1, "+Inf"], [2, "1.5"]]}]}}
    entries = spark.createDataFrame([(5, {"a": "1"}, "x"), (6, {"a": "1"}, 'y"')], "ts long, labels map<string,string>, line string")
    out = json.loads(envelope.envelope(envelope.stream_rows(entries), "streams").first().json)
    assert out["data"]["result"] == [{"stream": {"a": "1"}, "values": [["6", 'y"'], ["5", "x"]]}]
    assert json.loads(envelope.envelope(envelope.vector_rows(rows.limit(0)), "vector").first().json)["data"]["result"] == []
    assert json.loads(envelope.scalar(rows.filter("value = 3")).first().json)["data"]["result"] == [1, "3"]


def test_tail_delivery(spark):
    batch = spark.createDataFrame([(i, {"a": "1"}, f"l{i}") for i in range(5)], "ts long, labels map<string,string>, line string")
    got = []
    jobs.tail_delivery(lambda entries, dropped: got.append((sorted(r.ts for r in entries.collect()), sorted(r.ts for r in dropped.collect()))), 3)(batch, 0)
    assert got == [([2, 3, 4], [0, 1])]
    jobs.tail_delivery(lambda entries, dropped: got.append((entries.count(), dropped.count())), 9)(batch, 1)
    assert got[-1] == (5, 0)


def test_detector_tells_once(spark):
    rows = [(t * 60 * S, "p", "E", None, "m") for t in [*range(5), *[5] * 20]]
    df = spark.createDataFrame(rows, "ts long, project string, kind string, place string, message string")
    jumps = errors.rate_jumps(df, ["project"], started=0)
    assert jumps.count() == 1 and errors.rate_jumps(df, ["project"], started=1).count() == 0
    assert errors.rate_jumps(df, ["project"], emitted=jumps).count() == 0
    logs = spark.createDataFrame([("s", t * 60 * S, f"failed {t}", True) for t in range(40)] + [("s", 1, "fine", False)], "service string, ts long, line string, error boolean")
    r = errors.shape_windows(logs, 40 * 60 * S).collect()
    assert [(x.baseline, x.current, x["rank"]) for x in r] == [(30, 5, 1)]


def test_compaction_and_expiry(spark, tmp_path):
    path = str(tmp_path / "logs")
    logs = event_logs(spark, SF)
    for part in logs.randomSplit([1.0] * 4, 7):
        tables.write(part, path, "logs")
    before = spark.read.parquet(path).count()
    days = rollups.compact(spark, path, ["key", "ts"], most_files=2)
    assert days and spark.read.parquet(path).count() == before == logs.count()
    assert all(len(list((tmp_path / "logs" / d).glob("part-*"))) <= 2 for d in days)
    first = sorted(p.name for p in (tmp_path / "logs").glob("day=*"))[:3]
    floor = 1704067200 * S + 3 * 86400 * S
    gone = rollups.expire(spark, path, floor)
    assert gone and set(gone) <= set(first) and spark.read.parquet(path).agg(F.min("ts")).first()[0] >= floor


def test_templates_with_loops():
    run = lambda t, **bag: Template(t).run(bag, "the line", 5 * S)
    assert run("{{ range $i, $x := fromJson .j }}{{ if $i }},{{ end }}{{ $x.name }}{{ end }}", j='[{"name":"a"},{"name":"b"}]') == "a,b"
    assert run("{{ range fromJson .j }}{{ if eq . 3 }}{{ break }}{{ end }}{{ if eq . 1 }}{{ continue }}{{ end }}<{{ . }}>{{ else }}none{{ end }}", j="[0, 1, 2, 3, 4]") == "<0><2>"
    assert run("{{ range fromJson .j }}x{{ else }}none{{ end }}", j="[]") == "none"
    assert run("{{ range $k, $v := fromJson .j }}{{ $k }}={{ $v }};{{ end }}", j='{"b": 1.5, "a": [1, 2]}') == "a=[1 2];b=1.5;"
    assert run("{{ index (fromJson .j) 1 }} {{ index . \"x\" }} {{ slice .x 1 3 }} {{ len .x }}", j="[7, 8]", x="abcd") == "8 abcd bc 4"
    assert run("{{ $n := 2 }}{{ if true }}{{ $n = 3 }}{{ end }}{{ add $n 1 }}") == "4"
    assert run("{{ js .x }} {{ __line__ | upper }} {{ $.x }}", x="a'<") == "a\\'\\u003C THE LINE a'<"
    assert run("{{ with $y := .x }}{{ $y }}{{ else }}no{{ end }}", x="") == "no"
    assert needs_loops("{{ range . }}{{ end }}") and not needs_loops("{{ .a }} costs $5")
    for bad in ["{{ range . }}", "{{ break }}$", "{{ $z }}", "{{ nothing 1 }}$"]:
        with pytest.raises(TemplateError):
            run(bad)


def test_template_functions_in_queries(spark):
    logs = spark.createDataFrame([({"app": "a"}, {"v": "3.14159", "j": "[1, 2]"}, "app\x01a", S, "a.b.c.d")], "stream map<string,string>, meta map<string,string>, key string, ts long, line string")
    line = lambda t: LogPlanner(logs, Grid(0, 2 * S, S)).run('{app="a"} | line_format "' + t.replace('"', '\\"') + '"').first()
    assert line("{{ round .v 2 }}").line == "3.14" and line("{{ round .v 3 }}").line == "3.142"
    assert line('{{ Replace __line__ "." "$1" 2 }}').line == "a$1b$1c.d" and line('{{ Replace __line__ "." "-" -1 }}').line == "a-b-c-d"
    assert line("{{ range fromJson .j }}<{{ . }}>{{ end }}").line == "<1><2>"
    failed = line('{{ index (fromJson .j) 9 }}')
    assert failed.line == "a.b.c.d" and failed.labels["__error__"] == "TemplateFormatErr"
