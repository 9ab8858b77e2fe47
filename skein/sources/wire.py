"""Binary payloads: protobuf messages, in raw snappy blocks or not, as the JSON that the ingest functions read.

A message is described by its fields: number -> (name, kind); a kind is a scalar's name, a message, or a list of either for
repeated fields. Numbers and names are those of the public formats.
"""

from __future__ import annotations

import base64
import json
import math
import struct

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Field numbers of the public protobuf definitions.
_LABEL = {1: ("name", "string"), 2: ("value", "string")}
_TIME = {1: ("seconds", "int"), 2: ("nanos", "int")}
_ENTRY = {1: ("timestamp", _TIME), 2: ("line", "string"), 3: ("meta", [_LABEL])}
LOG_PUSH = {1: ("streams", [{1: ("labels", "string"), 2: ("entries", [_ENTRY])}])}

_SAMPLE = {1: ("value", "double"), 2: ("timestamp", "int")}
_BUCKETS = {1: ("offset", "sint"), 2: ("length", "int")}
_HISTOGRAM = {
    1: ("countInt", "int"), 2: ("countFloat", "double"), 3: ("sum", "double"), 4: ("schema", "sint"), 5: ("zeroThreshold", "double"), 6: ("zeroInt", "int"), 7: ("zeroFloat", "double"),
    8: ("negativeSpans", [_BUCKETS]), 9: ("negativeDeltas", ["sint"]), 10: ("negativeCounts", ["double"]), 11: ("positiveSpans", [_BUCKETS]), 12: ("positiveDeltas", ["sint"]), 13: ("positiveCounts", ["double"]),
    14: ("resetHint", "int"), 15: ("timestamp", "int"), 16: ("customValues", ["double"]),
}
_METADATA_V1 = {1: ("type", "int"), 2: ("metric", "string"), 4: ("help", "string"), 5: ("unit", "string")}
WRITE_V1 = {
    1: ("timeseries", [{1: ("labels", [_LABEL]), 2: ("samples", [_SAMPLE]), 3: ("exemplars", [{1: ("labels", [_LABEL]), 2: ("value", "double"), 3: ("timestamp", "int")}]), 4: ("histograms", [_HISTOGRAM])}]),
    3: ("metadata", [_METADATA_V1]),
}
WRITE_V2 = {
    4: ("symbols", ["string"]),
    5: ("timeseries", [{1: ("refs", ["int"]), 2: ("samples", [_SAMPLE]), 3: ("histograms", [_HISTOGRAM]), 4: ("exemplars", [{1: ("refs", ["int"]), 2: ("value", "double"), 3: ("timestamp", "int")}]), 5: ("meta", {1: ("type", "int"), 3: ("helpRef", "int"), 4: ("unitRef", "int")}), 6: ("created", "int")}]),
}
METRIC_TYPES = ["unknown", "counter", "gauge", "histogram", "gaugehistogram", "summary", "info", "stateset"]

_VALUE: dict = {1: ("stringValue", "string"), 2: ("boolValue", "bool"), 3: ("intValue", "int64"), 4: ("doubleValue", "double"), 7: ("bytesValue", "base64")}
_PAIR = {1: ("key", "string"), 2: ("value", _VALUE)}
_VALUE[5] = ("arrayValue", {1: ("values", [_VALUE])})
_VALUE[6] = ("kvlistValue", {1: ("values", [_PAIR])})
_RESOURCE = {1: ("attributes", [_PAIR])}
_RECORD = {1: ("timeUnixNano", "fixed64"), 2: ("severityNumber", "int"), 3: ("severityText", "string"), 5: ("body", _VALUE), 6: ("attributes", [_PAIR]), 9: ("traceId", "hex"), 10: ("spanId", "hex"), 11: ("observedTimeUnixNano", "fixed64")}
OTLP_LOGS = {1: ("resourceLogs", [{1: ("resource", _RESOURCE), 2: ("scopeLogs", [{2: ("logRecords", [_RECORD])}])}])}
_EXEMPLAR = {2: ("timeUnixNano", "fixed64"), 3: ("asDouble", "double"), 4: ("spanId", "hex"), 5: ("traceId", "hex"), 6: ("asInt", "sfixed64"), 7: ("filteredAttributes", [_PAIR])}
_NUMBER = {3: ("timeUnixNano", "fixed64"), 4: ("asDouble", "double"), 5: ("exemplars", [_EXEMPLAR]), 6: ("asInt", "sfixed64"), 7: ("attributes", [_PAIR]), 8: ("flags", "int")}
_CLASSIC = {3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("bucketCounts", ["fixed64"]), 7: ("explicitBounds", ["double"]), 8: ("exemplars", [_EXEMPLAR]), 9: ("attributes", [_PAIR])}
_SIDE = {1: ("offset", "sint"), 2: ("bucketCounts", ["int64"])}
_EXPONENTIAL = {1: ("attributes", [_PAIR]), 3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("scale", "sint"), 7: ("zeroCount", "fixed64"), 8: ("positive", _SIDE), 9: ("negative", _SIDE), 11: ("exemplars", [_EXEMPLAR]), 14: ("zeroThreshold", "double")}
_SUMMARY = {3: ("timeUnixNano", "fixed64"), 4: ("count", "fixed64"), 5: ("sum", "double"), 6: ("quantileValues", [{1: ("quantile", "double"), 2: ("value", "double")}]), 7: ("attributes", [_PAIR])}
_METRIC = {
    1: ("name", "string"), 3: ("unit", "string"), 5: ("gauge", {1: ("dataPoints", [_NUMBER])}), 7: ("sum", {1: ("dataPoints", [_NUMBER]), 2: ("aggregationTemporality", "int"), 3: ("isMonotonic", "bool")}),
    9: ("histogram", {1: ("dataPoints", [_CLASSIC])}), 10: ("exponentialHistogram", {1: ("dataPoints", [_EXPONENTIAL])}), 11: ("summary", {1: ("dataPoints", [_SUMMARY])}),
}
OTLP_METRICS = {1: ("resourceMetrics", [{1: ("resource", _RESOURCE), 2: ("scopeMetrics", [{2: ("metrics", [_METRIC])}])}])}
_EVENT = {1: ("timeUnixNano", "fixed64"), 2: ("name", "string"), 3: ("attributes", [_PAIR])}
_LINK = {1: ("traceId", "hex"), 2: ("spanId", "hex"), 4: ("attributes", [_PAIR])}
_SPAN = {
    1: ("traceId", "hex"), 2: ("spanId", "hex"), 4: ("parentSpanId", "hex"), 5: ("name", "string"), 6: ("kind", "int"), 7: ("startTimeUnixNano", "fixed64"), 8: ("endTimeUnixNano", "fixed64"),
    9: ("attributes", [_PAIR]), 11: ("events", [_EVENT]), 13: ("links", [_LINK]), 15: ("status", {2: ("message", "string"), 3: ("code", "int")}),
}
OTLP_TRACES = {1: ("resourceSpans", [{1: ("resource", _RESOURCE), 2: ("scopeSpans", [{2: ("spans", [_SPAN])}])}])}
#: The bits of the number that marks the end of a series.
STALE = 0x7FF0000000000002


class WireError(ValueError):
    """Bytes that are no such message."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        if at >= len(data) or shift > 63:
            raise WireError("bad varint")
        b = data[at]
        at += 1
        out |= (b & 127) << shift
        if b < 128:
            return out & (1 << 64) - 1, at
        shift += 7


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def _double(x: int):
    if x == STALE:
        return "stale"
    v = struct.unpack("<d", struct.pack("<Q", x))[0]
    return v if math.isfinite(v) else "NaN" if v != v else "Infinity" if v > 0 else "-Infinity"


#: What a scalar's 64 bits are, as JSON: 64-bit numbers of the trace formats are text there.
_SCALARS = {
    "int": _signed, "sint": lambda x: (x >> 1) ^ -(x & 1), "int64": lambda x: str(_signed(x)), "bool": bool, "double": _double, "fixed64": str, "sfixed64": lambda x: str(_signed(x)),
}
_TEXTS = {"string": lambda b: b.decode("utf-8", "replace"), "hex": bytes.hex, "base64": lambda b: base64.b64encode(b).decode()}
_FIXED = {"double", "fixed64", "sfixed64"}


def decode(data: bytes, fields: dict) -> dict:
    """The message's known fields; unknown ones are skipped."""
    out: dict = {}
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        wire = tag & 7
        if wire == 0:
            value, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
            if at + size > len(data):
                raise WireError("truncated")
            value, at = int.from_bytes(data[at : at + size], "little"), at + size
        elif wire == 2:
            size, at = _varint(data, at)
            if at + size > len(data):
                raise WireError("truncated")
            value, at = data[at : at + size], at + size
        else:
            raise WireError(f"wire type {wire}")
        if tag >> 3 not in fields:
            continue
        name, kind = fields[tag >> 3]
        repeated = isinstance(kind, list)
        kind = kind[0] if repeated else kind
        if isinstance(kind, dict) or kind in _TEXTS:
            if not isinstance(value, bytes):
                raise WireError("bytes are needed")
            found = [decode(value, kind) if isinstance(kind, dict) else _TEXTS[kind](value)]
        elif isinstance(value, bytes):
            found = [_SCALARS[kind](x) for x in _packed(value, kind in _FIXED)]
        else:
            found = [_SCALARS[kind](value)]
        if repeated:
            out.setdefault(name, []).extend(found)
        elif found:
            out[name] = found[-1]
    return out


def _packed(data: bytes, fixed: bool) -> list[int]:
    if fixed:
        if len(data) % 8:
            raise WireError("truncated")
        return list(struct.unpack(f"<{len(data) // 8}Q", data))
    out, at = [], 0
    while at < len(data):
        x, at = _varint(data, at)
        out.append(x)
    return out


def unsnappy(data: bytes, most: int = 1 << 28) -> bytes:
    """A raw snappy block, whose size comes first."""
    import pyarrow as pa

    size, _ = _varint(data, 0)
    if size > most:
        raise WireError("too large")
    try:
        return pa.decompress(data, size, codec="snappy", asbytes=True)
    except (OSError, pa.ArrowException) as e:
        raise WireError("no snappy block") from e


def _buckets(h: dict, side: str) -> dict[str, float]:
    """Counts by bucket from spans and deltas (whole counts) or plain counts."""
    counts = h.get(f"{side}Counts")
    if counts is None:
        counts, total = [], 0
        for d in h.get(f"{side}Deltas", []):
            total += d
            counts.append(float(total))
    out, index, k = {}, 0, 0
    for span in h.get(f"{side}Spans", []):
        index += span.get("offset", 0)
        for _ in range(span.get("length", 0)):
            if k < len(counts):
                out[str(index)] = counts[k]
            index, k = index + 1, k + 1
    return out


def _histogram(h: dict) -> dict:
    return {"timestamp": h.get("timestamp", 0), "schema": h.get("schema", 0), "zeroThreshold": h.get("zeroThreshold", 0.0), "zeroCount": h.get("zeroFloat", float(h.get("zeroInt", 0))), "count": h.get("countFloat", float(h.get("countInt", 0))), "sum": h.get("sum", 0.0), "positive": _buckets(h, "positive"), "negative": _buckets(h, "negative"), "hint": h.get("resetHint", 0)}


def _series(t: dict, labels: list[dict]) -> dict:
    samples = [{"timestamp": s.get("timestamp", 0), "value": "NaN" if s.get("value") == "stale" else s.get("value", 0.0), "stale": s.get("value") == "stale"} for s in t.get("samples", [])]
    return {"labels": labels, "samples": samples, "histograms": [_histogram(h) for h in t.get("histograms", [])]}


def write_v1(data: bytes) -> dict:
    m = decode(data, WRITE_V1)
    out = [_series(t, t.get("labels", [])) | {"exemplars": t.get("exemplars", [])} for t in m.get("timeseries", [])]
    notes = [{"metric": x.get("metric", ""), "type": METRIC_TYPES[x.get("type", 0)], "help": x.get("help", ""), "unit": x.get("unit", "")} for x in m.get("metadata", [])]
    return {"timeseries": out, "metadata": notes}


def write_v2(data: bytes) -> dict:
    """Labels, help and unit are references into a table of symbols."""
    m = decode(data, WRITE_V2)
    symbols = m.get("symbols", [])
    try:
        named = lambda refs: [{"name": symbols[a], "value": symbols[b]} for a, b in zip(refs[::2], refs[1::2], strict=True)]
        out, notes = [], []
        for t in m.get("timeseries", []):
            labels = named(t.get("refs", []))
            out.append(_series(t, labels) | {"exemplars": [e | {"labels": named(e.get("refs", []))} for e in t.get("exemplars", [])]})
            if meta := t.get("meta"):
                metric = next((x["value"] for x in labels if x["name"] == "__name__"), "")
                notes.append({"metric": metric, "type": METRIC_TYPES[meta.get("type", 0)], "help": symbols[meta.get("helpRef", 0)], "unit": symbols[meta.get("unitRef", 0)]})
    except (IndexError, ValueError) as e:
        raise WireError("bad symbol reference") from e
    return {"timeseries": out, "metadata": notes}


def log_push(data: bytes) -> dict:
    """Stream labels come as the text of a selector."""
    from ..plans.promql_parser import parse

    out = []
    for s in decode(data, LOG_PUSH).get("streams", []):
        labels = {name: value for name, _, value in parse(s.get("labels", "{}")).matchers}
        values = []
        for e in s.get("entries", []):
            t = e.get("timestamp", {})
            row = [str(t.get("seconds", 0) * 10**9 + t.get("nanos", 0)), e.get("line", "")]
            values.append(row + ([json.dumps({x["name"]: x.get("value", "") for x in e["meta"]})] if e.get("meta") else []))
        out.append({"stream": labels, "values": values})
    return {"streams": out}


FORMATS = {
    "log_push": log_push, "write_v1": write_v1, "write_v2": write_v2,
    "otlp_logs": lambda d: decode(d, OTLP_LOGS), "otlp_metrics": lambda d: decode(d, OTLP_METRICS), "otlp_traces": lambda d: decode(d, OTLP_TRACES),
}


def to_json(data: bytes | None, form: str, snappy: bool = False) -> str | None:
    """None for bytes that are no such message."""
    try:
        return json.dumps(FORMATS[form](unsnappy(data) if snappy else data)) if data is not None else None
    except (ValueError, KeyError, TypeError, IndexError):
        return None


def decoded(payloads: DataFrame, form: str, snappy: bool = False, column: str = "payload") -> DataFrame:
    """Payloads with the binary column as JSON text, null where it does not decode (`ingest.rejected` finds these)."""

    @F.pandas_udf("string")
    def run(raw: pd.Series) -> pd.Series:
        return raw.map(lambda d: to_json(None if d is None else bytes(d), form, snappy))

    return payloads.withColumn(column, run(column))
