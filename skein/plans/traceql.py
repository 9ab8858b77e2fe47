"""The trace language: span predicates, structural relations between spansets, search, and metrics over spans.

spans: trace, id, parent, name, service, kind (int), start, end (ns), status (int), attrs map, resource map,
events array<struct<name, ts, attrs>>. Relations are semi joins on (trace, id); the transitive ones walk the tree level by level.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.units import duration_ns
from .grid import Grid
from .promql_parser import QueryError, Stream, tokens_of, unquote

#: Values of status and kind, fixed.
STATUS = {"unset": 0, "ok": 1, "error": 2}
KIND = {"unspecified": 0, "internal": 1, "server": 2, "client": 3, "producer": 4, "consumer": 5}
INTRINSIC = {"name", "duration", "status", "kind", "nestedSetParent", "rootName", "rootServiceName", "traceDuration"}
RELATIONS = (">>", "<<", ">", "<", "~")
MOST_RELATED = 4

_TOKEN = re.compile(
    r"""\s+
    |(?P<duration>(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|[smhd]))+)(?![\w.])
    |(?P<number>-?\d+\.?\d*(?:[eE][+-]?\d+)?)
    |(?P<name>[A-Za-z_][\w]*(?::[A-Za-z]\w*)?(?:\.[A-Za-z_][\w.\-/]*)?|\.[A-Za-z_][\w.\-/]*)
    |(?P<string>"(?:[^"\\]|\\.)*"|`[^`]*`)
    |(?P<op>&&|\|\||=~|!~|!=|<=|>=|>>|<<|[-+*/<>=(){},|~])""",
    re.VERBOSE,
)


@dataclass(frozen=True)
class Predicate:
    scope: str  # resource, span, event, any, intrinsic
    key: str
    op: str
    value: object


@dataclass(frozen=True)
class Spanset:
    """A filter as nested ("&&" | "||", left, right) tuples of predicates; None takes every span."""

    test: object = None


@dataclass(frozen=True)
class TraceQuery:
    spansets: tuple[Spanset, ...]
    relations: tuple[str, ...] = ()
    fields: tuple[str, ...] = ()


@dataclass(frozen=True)
class TraceMetric:
    query: TraceQuery
    op: str
    field: str | None = None
    quantiles: tuple[float, ...] = ()
    by: tuple[str, ...] = ()
    second: tuple = ()  # ("topk" | "bottomk", n) or (comparison, number), in order


@dataclass(frozen=True)
class TraceMath:
    op: str
    left: object
    right: object


METRICS = {"rate", "count_over_time", "min_over_time", "max_over_time", "sum_over_time", "avg_over_time", "histogram_over_time", "quantile_over_time"}


class _TraceParser(Stream):
    def math(self, level: int = 1):
        left = self.operand()
        while (op := self.text) in ("+", "-", "*", "/") and (1 if op in "+-" else 2) >= level:
            self.take()
            left = TraceMath(op, left, self.math((1 if op in "+-" else 2) + 1))
        return left

    def operand(self):
        if self.kind == "number":
            return float(self.take())
        if self.accept("("):
            inner = self.math()
            self.expect(")")
            return inner
        return self.pipeline()

    def pipeline(self):
        query, metric, second = self.query(), None, []
        while self.accept("|"):
            name = self.take()
            if name == "select":
                self.expect("(")
                fields = [self.take()]
                while self.accept(","):
                    fields.append(self.take())
                self.expect(")")
                query = TraceQuery(query.spansets, query.relations, tuple(fields))
            elif name in METRICS and metric is None:
                metric = self.metric(query, name)
            elif name in ("topk", "bottomk") and metric:
                self.expect("(")
                second.append((name, int(self.take())))
                self.expect(")")
            elif name in ("<", ">", "<=", ">=", "=", "!="):
                second.append((name, float(self.take())))
            else:
                raise QueryError(f"unexpected {name!r}")
        if metric is None:
            return query
        while self.text in ("<", ">", "<=", ">=", "=", "!="):
            second.append((self.take(), float(self.take())))
        return TraceMetric(metric.query, metric.op, metric.field, metric.quantiles, metric.by, tuple(second))

    def metric(self, query: TraceQuery, op: str) -> TraceMetric:
        self.expect("(")
        field, quantiles, by = None, [], ()
        if not self.accept(")"):
            field = self.take()
            while self.accept(","):
                quantiles.append(float(self.take()))
            self.expect(")")
        if self.accept("by"):
            self.expect("(")
            by = [self.take()]
            while self.accept(","):
                by.append(self.take())
            self.expect(")")
            if len(by) > 5:
                raise QueryError("at most five fields to group by")
        if (field is None) != (op in ("rate", "count_over_time")) or bool(quantiles) != (op == "quantile_over_time"):
            raise QueryError(f"wrong arguments of {op}")
        return TraceMetric(query, op, field, tuple(quantiles), tuple(by))

    def query(self) -> TraceQuery:
        sets, relations = [self.spanset()], []
        while self.text in RELATIONS and self.kind == "op":
            relations.append(self.take())
            sets.append(self.spanset())
        if len(sets) > MOST_RELATED:
            raise QueryError(f"at most {MOST_RELATED} related spansets")
        return TraceQuery(tuple(sets), tuple(relations))

    def spanset(self) -> Spanset:
        self.expect("{")
        if self.accept("}"):
            return Spanset()
        out = self.test()
        self.expect("}")
        return Spanset(out)

    def test(self):
        """&& and || bind alike, to the left."""
        left = self.atom()
        while op := self.accept("&&", "||"):
            left = (op, left, self.atom())
        return left

    def atom(self):
        if self.accept("("):
            inner = self.test()
            self.expect(")")
            return inner
        scope, key = field_of(self.take())
        op = self.expect("=", "!=", "=~", "!~", "<", "<=", ">", ">=")
        kind, text = self.kind, self.take()
        value = unquote(text) if kind == "string" else duration_ns(text) if kind == "duration" else float(text) if kind == "number" else text
        if kind == "name" and key == "status" and scope == "intrinsic":
            value = STATUS.get(text)
        elif kind == "name" and key == "kind" and scope == "intrinsic":
            value = KIND.get(text)
        elif kind == "name":
            value = {"true": "true", "false": "false", "nil": None}.get(text, text)
        return Predicate(scope, key, op, value)


def field_of(text: str) -> tuple[str, str]:
    for scope in ("resource", "span", "event"):
        if text.startswith(f"{scope}.") or text.startswith(f"{scope}:"):
            rest = text[len(scope) + 1 :]
            return ("intrinsic", rest) if text[len(scope)] == ":" and rest in INTRINSIC else (scope, rest)
    if text.startswith("."):
        return "any", text[1:]
    if text in INTRINSIC or text.startswith("trace:"):
        return "intrinsic", {"trace:duration": "traceDuration", "trace:rootName": "rootName", "trace:rootService": "rootServiceName"}.get(text, text)
    raise QueryError(f"unknown field {text!r}")


def parse(text: str):
    p = _TraceParser(tokens_of(text, _TOKEN))
    out = p.math()
    if p.kind != "end":
        raise QueryError(f"unexpected {p.text!r}")
    return out


def field_text(name: str) -> Column:
    """A field's value as a string, null if the span has none."""
    scope, key = field_of(name)
    if scope == "intrinsic":
        if key == "status":
            return F.element_at(F.create_map(*[F.lit(x) for k, v in STATUS.items() for x in (v, k)]), F.col("status"))
        if key == "kind":
            return F.element_at(F.create_map(*[F.lit(x) for k, v in KIND.items() for x in (v, k)]), F.col("kind"))
        if key == "duration":
            return (F.col("end") - F.col("start")).cast("string")
        return F.col({"rootName": "root_name", "rootServiceName": "root_service"}.get(key, key))
    attrs, resource = F.element_at("attrs", key), F.element_at("resource", key)
    if key == "service.name":
        resource = F.coalesce(resource, F.col("service"))
    if scope == "event":
        return F.get(F.transform(F.filter("events", lambda e: F.map_contains_key(e["attrs"], key)), lambda e: F.element_at(e["attrs"], key)), 0)
    return {"resource": resource, "span": attrs, "any": F.coalesce(attrs, resource)}[scope]


def field_number(name: str) -> Column:
    """A field as a number; durations in seconds."""
    if field_of(name) == ("intrinsic", "duration"):
        return (F.col("end") - F.col("start")) / F.lit(1e9)
    return field_text(name).try_cast("double")


def predicate(p: Predicate) -> Column:
    if p.scope == "intrinsic" and p.key == "nestedSetParent":
        if p.op == "<" and p.value == 0:
            return F.col("parent").isNull()
        raise QueryError("nestedSetParent < 0 is all that is known")
    if p.scope == "event":
        return F.exists("events", lambda e: _tested(F.element_at(e["attrs"], p.key), p))
    if p.scope == "intrinsic" and p.key in ("duration", "status", "kind", "traceDuration"):
        given = {"duration": F.col("end") - F.col("start"), "status": F.col("status"), "kind": F.col("kind"), "traceDuration": F.col("trace_duration")}[p.key]
        return F.coalesce(_number(given, p.op, p.value), F.lit(False))
    name = {"resource": "resource.", "span": "span.", "any": "."}.get(p.scope, "") + p.key
    return _tested(field_text(name), p)


def _number(given: Column, op: str, value) -> Column:
    v = F.lit(value)
    return {"=": given == v, "!=": given != v, "<": given < v, "<=": given <= v, ">": given > v, ">=": given >= v}[op]


def _tested(given: Column, p: Predicate) -> Column:
    if p.value is None:
        return given.isNull() if p.op == "=" else given.isNotNull()
    if isinstance(p.value, str):
        if p.op in ("=~", "!~"):
            hit = given.rlike(f"(?s)\\A(?:{p.value})\\z")
            out = ~hit if p.op == "!~" else hit
        else:
            out = {"=": given == p.value, "!=": given != p.value, "<": given < p.value, "<=": given <= p.value, ">": given > p.value, ">=": given >= p.value}[p.op]
    else:
        out = _number(given.try_cast("double"), p.op, float(p.value))
    return F.coalesce(out, F.lit(False))


def spanset_filter(test) -> Column:
    if test is None:
        return F.lit(True)
    if isinstance(test, tuple):
        a, b = spanset_filter(test[1]), spanset_filter(test[2])
        return a & b if test[0] == "&&" else a | b
    return predicate(test)


def _children(front: DataFrame, spans: DataFrame) -> DataFrame:
    """(trace, id, parent) of the spans right below those of front."""
    up = front.select("trace", F.col("id").alias("parent")).distinct()
    return spans.select("trace", "id", "parent").join(up, ["trace", "parent"], "left_semi")


def related(left: DataFrame, relation: str, right: DataFrame, spans: DataFrame) -> DataFrame:
    """Rows of right that stand in the relation to some row of left."""
    if relation == ">":
        return right.join(left.select("trace", F.col("id").alias("parent")).distinct(), ["trace", "parent"], "left_semi")
    if relation == "<":
        return right.join(left.filter("parent is not null").select("trace", F.col("parent").alias("id")).distinct(), ["trace", "id"], "left_semi")
    if relation == "~":
        # Of the spans with one parent, one other than itself: two, or one with another id.
        by = left.filter("parent is not null").groupBy("trace", "parent").agg(F.min("id").alias("a"), F.max("id").alias("b"))
        return right.join(by, ["trace", "parent"]).filter("id <> a or id <> b").select(*right.columns)
    links = spans.select("trace", "id", "parent")
    if relation == ">>":
        front = left.select("trace", "id").distinct()
        step = lambda f: _children(f, links).select("trace", "id").distinct()
    else:
        front = left.select("trace", "id").distinct()
        step = lambda f: links.join(f, ["trace", "id"], "left_semi").filter("parent is not null").select("trace", F.col("parent").alias("id")).distinct()
    # As many rounds as the deepest trace has levels; a cycle adds nothing new and ends it. Each round is settled, so that plans do
    # not grow with depth, and the rounds before it are let go.
    reached = front = _settled(step(front))
    while not front.isEmpty():
        old = front
        front = _settled(step(front).join(reached, ["trace", "id"], "left_anti"))
        if old is not reached:
            old.unpersist()
        if not front.isEmpty():
            old, reached = reached, _settled(reached.union(front))
            old.unpersist()
    return right.join(reached, ["trace", "id"], "left_semi")


def _settled(df: DataFrame) -> DataFrame:
    """Computed once: in the cluster's checkpoint folder if it names one, else in executors' memory and disks."""
    context = df.sparkSession.sparkContext
    where = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not where:
        return df.persist()
    if not context.getCheckpointDir():
        context.setCheckpointDir(where)
    return df.checkpoint()


def metric_window(start: int, end: int, step: int | None = None) -> Grid:
    """The grid of a metric query: aligned to the step, with an interval before its start; by default about 240 points at a round step."""
    step = step or default_step(start, end)
    if (end - start) // step > 10_000:
        raise QueryError(f"the step is too small: {step}")
    low, high = start - start % step, end + -end % step
    return Grid(low - step if low > step else low, high, step)


def default_step(start: int, end: int) -> int:
    rough = (end - start) // 240
    unit = 50_000_000 if end - start < 60 * 10**9 else next((s for s in (3600, 300, 60, 15, 5, 1) if s * 10**9 <= rough), 1) * 10**9
    return max(rough // unit, 1) * unit


def trace_json(spans: DataFrame, trace: str, version: int = 2) -> DataFrame:
    """One row, json: a trace in the public JSON form of spans by resource; version 1 names the list `batches`, 2 wraps it in `trace`."""
    kv = lambda m: F.transform(F.array_sort(F.map_entries(m)), lambda e: F.struct(e["key"].alias("key"), F.struct(e["value"].alias("stringValue")).alias("value")))
    events = F.transform("events", lambda e: F.struct(e["ts"].cast("string").alias("timeUnixNano"), e["name"].alias("name"), kv(e["attrs"]).alias("attributes")))
    span = F.struct(
        F.col("trace").alias("traceId"), F.col("id").alias("spanId"), F.col("parent").alias("parentSpanId"), "name", "kind", F.col("start").cast("string").alias("startTimeUnixNano"), F.col("end").cast("string").alias("endTimeUnixNano"),
        kv(F.col("attrs")).alias("attributes"), events.alias("events"), F.struct(F.col("status").alias("code")).alias("status"),
    )
    own = spans.filter(F.col("trace") == trace).select(F.to_json(kv(F.col("resource"))).alias("r"), kv(F.col("resource")).alias("attributes"), "start", "id", span.alias("span"))
    by = own.groupBy("r").agg(F.first("attributes").alias("attributes"), F.transform(F.array_sort(F.collect_list(F.struct("start", "id", "span"))), lambda x: x["span"]).alias("spans"))
    batch = F.struct(F.struct("attributes").alias("resource"), F.array(F.struct("spans")).alias("scopeSpans"))
    one = by.agg(F.transform(F.array_sort(F.collect_list(F.struct("r", batch.alias("b")))), lambda x: x["b"]).alias("list")).filter(F.size("list") > 0)
    body = F.struct(F.col("list").alias("batches")) if version == 1 else F.struct(F.struct(F.col("list").alias("resourceSpans")).alias("trace"))
    return one.select(F.to_json(body).alias("json"))


class TracePlanner:
    """Translates queries over one spans table."""

    def __init__(self, spans: DataFrame):
        self.spans = spans

    def matched(self, query: TraceQuery) -> DataFrame:
        """The last spanset's spans that satisfy the chain of relations."""
        spans = self.spans
        if any(p.key in ("rootName", "rootServiceName", "traceDuration") for s in query.spansets for p in _predicates(s.test)):
            spans = spans.join(trace_context(spans), "trace")
        out = spans.filter(spanset_filter(query.spansets[0].test))
        for relation, s in zip(query.relations, query.spansets[1:], strict=True):
            out = related(out, relation, spans.filter(spanset_filter(s.test)), self.spans)
        return out

    def select(self, query: TraceQuery) -> DataFrame:
        """Matched spans with the selected fields as further columns."""
        return self.matched(query).select("trace", "id", "parent", "name", "service", "start", "end", *[field_text(f).alias(f) for f in query.fields])

    def search(self, text: str, start: int | None = None, end: int | None = None, limit: int = 20, spss: int = 3, strict: bool = False) -> DataFrame:
        """The most recent traces that overlap start..end as a whole and have a matching span. A bound that is None is open.

        trace, root_name, root_service, start, duration_ms, matched, spans (up to spss of the matched), span_count, error_count.
        Strict searches fail where `integrity` finds a problem.
        """
        query = parse(text)
        hits = self.matched(query).select("trace", "id", "name", "start", (F.col("end") - F.col("start")).alias("duration"))
        rank = F.row_number().over(Window.partitionBy("trace").orderBy("start", "id"))
        sampled = hits.withColumn("rank", rank).groupBy("trace").agg(F.count("*").alias("matched"), F.array_sort(F.collect_list(F.when(F.col("rank") <= spss, F.struct("start", "id", "name", "duration")))).alias("spans"))
        whole = self.spans.join(sampled.select("trace"), "trace", "left_semi").groupBy("trace").agg(*_context(), F.count("*").alias("span_count"), F.count_if(F.col("status") == 2).alias("error_count"))
        whole = whole.filter(_overlaps(F.col("trace_start"), F.col("trace_end"), start, end))
        out = whole.join(sampled, "trace").orderBy(F.col("trace_start").desc(), "trace").limit(limit)
        if strict:  # the first problem fails the search
            worst = self.integrity(text, start, end).agg(F.min("problem").alias("problem"))
            checked = F.when(F.col("problem").isNotNull(), F.raise_error(F.col("problem"))).otherwise(F.col("trace"))
            out = worst.join(out, F.lit(True), "left").withColumn("trace", checked).filter("trace is not null")
        return out.select("trace", "root_name", "root_service", F.col("trace_start").alias("start"), F.floor(F.col("trace_duration") / 1_000_000).alias("duration_ms"), "matched", "spans", "span_count", "error_count")

    def integrity(self, text: str, start: int | None = None, end: int | None = None) -> DataFrame:
        """trace, problem of the traces that a strict search refuses: spans without ids or times that do not end after they start, matched
        traces without a start, with several roots, or longer than 2^32 - 1 ms. A bound that is None is open."""
        hits = self.matched(parse(text)).groupBy("trace").agg(F.count("*").alias("matched"))
        unknown = F.col("id").isNull() | F.col("start").isNull() | F.col("end").isNull() | (F.col("end") < F.col("start"))
        whole = self.spans.groupBy("trace").agg(F.max(unknown).alias("unknown"), F.min("start").alias("s"), F.max("end").alias("e"), F.count_distinct(F.when(F.col("parent").isNull(), F.col("id"))).alias("roots"))
        whole = whole.join(hits, "trace", "left").filter(F.col("unknown") | _overlaps(F.col("s"), F.col("e"), start, end))
        found = F.col("matched").isNotNull()
        long = F.call_function("div", F.col("e") - F.col("s"), F.lit(1_000_000).cast("long")) > (1 << 32) - 1
        problem = F.when(F.col("unknown"), "trace_metadata_unknown").when(found & (F.col("s") == 0), "trace_timestamp_unknown").when(found & (F.col("roots") > 1), "trace_root_conflict").when(found & long, "trace_duration_limit")
        return whole.select("trace", problem.alias("problem")).filter("problem is not null")

    def window_search(self, text: str, start: int, end: int, limit: int = 100) -> DataFrame:
        """Traces by their stored spans that start in start..end alone: trace, start, end, duration, stored and matching span counts, and how many traces match."""
        local = self.spans.filter((F.col("start") >= start) & (F.col("start") <= end))
        hits = TracePlanner(local).matched(parse(text)).groupBy("trace").agg(F.count("*").alias("matching_spans"))
        whole = local.join(hits.select("trace"), "trace", "left_semi").groupBy("trace").agg(F.min("start").alias("start"), F.max("end").alias("end"), F.count("*").alias("stored_spans"))
        out = whole.join(hits, "trace")
        top = out.orderBy(F.col("start").desc(), "trace").limit(limit)
        return top.join(F.broadcast(out.agg(F.count("*").alias("matched_traces")))).select("trace", "start", "end", (F.col("end") - F.col("start")).alias("duration"), "stored_spans", "matching_spans", "matched_traces")

    def find(self, start: int | None = None, end: int | None = None, limit: int | None = None, root_only: bool = False, min_duration: int | None = None, max_duration: int | None = None, attributes: dict | None = None, resource: dict | None = None, **exact) -> DataFrame:
        """Spans by plain filters: exact values of trace, id, parent, service, name, kind and status, bounds, attributes; with a limit the newest."""
        rows, took = self.spans, F.col("end") - F.col("start")
        tests = [F.col(k) == v for k, v in exact.items() if v is not None]
        tests += [F.col("start") >= start] * (start is not None) + [F.col("start") <= end] * (end is not None) + [F.col("parent").isNull()] * root_only
        tests += [took >= min_duration] * (min_duration is not None) + [took <= max_duration] * (max_duration is not None)
        tests += [F.element_at(bag, k) == str(v) for bag, given in (("attrs", attributes), ("resource", resource)) for k, v in (given or {}).items()]
        for t in tests:
            rows = rows.filter(t)
        return rows if limit is None else rows.orderBy(F.col("start").desc(), "trace", "id").limit(limit)

    def metrics(self, text: str, grid: Grid) -> DataFrame:
        """labels, step (the end of an interval), value."""
        return self._metric(parse(text), grid)

    def _metric(self, node, grid: Grid) -> DataFrame:
        if isinstance(node, TraceMath):
            return self._math(node, grid)
        if not isinstance(node, TraceMetric):
            raise QueryError("a metric is needed")
        n, spark = grid.count - 1, self.spans.sparkSession
        # Intervals are open on the left: a span at the very start of the range is in none.
        rows = self.matched(node.query).filter((F.col("start") > grid.start) & (F.col("start") <= grid.end))
        ahead = F.col("start") - grid.start - 1
        rows = rows.withColumn("i", F.call_function("div", ahead, F.lit(grid.step).cast("long")))
        labels = F.create_map(*[x for b in node.by for x in (F.lit(b), field_text(b))]) if node.by else F.create_map().cast("map<string,string>")
        for b in node.by:
            rows = rows.filter(field_text(b).isNotNull())
        rows = rows.withColumn("labels", labels).withColumn("key", F.to_json("labels"))
        if node.field:
            rows = rows.withColumn("v", field_number(node.field)).filter("v is not null and not isnan(v)")
        if node.op in ("histogram_over_time", "quantile_over_time"):
            rows = rows.filter("v > 0" if field_of(node.field)[1] == "duration" else "v >= 2")
            scale = 1e9 if field_of(node.field)[1] == "duration" else 1.0
            rows = rows.withColumn("bucket", F.pow(F.lit(2.0), F.ceil(F.log2(F.col("v") * scale))) / scale)
            if node.op == "histogram_over_time":
                rows = rows.withColumn("labels", F.map_concat("labels", F.create_map(F.lit("__bucket"), F.col("bucket").cast("string")))).withColumn("key", F.to_json("labels"))
        if node.op == "quantile_over_time":
            return self._quantiles(node, rows, grid)
        agg = {"rate": F.count("*") / (grid.step / 1e9), "count_over_time": F.count("*").cast("double"), "histogram_over_time": F.count("*").cast("double")}
        value = agg.get(node.op)
        if value is None:
            value = {"min_over_time": F.min, "max_over_time": F.max, "sum_over_time": F.sum, "avg_over_time": F.avg}[node.op]("v")
        found = rows.groupBy("key", "i").agg(F.first("labels").alias("labels"), value.alias("value"))
        if node.op in ("rate", "count_over_time", "histogram_over_time"):
            series = found.groupBy("key").agg(F.first("labels").alias("labels"))
            if not node.by and node.op != "histogram_over_time":  # an ungrouped count is there even without spans
                series = spark.createDataFrame([("{}", {})], "key string, labels map<string,string>")
            filled = series.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))) if n > 0 else series.withColumn("i", F.lit(0).cast("long")).limit(0)
            found = filled.join(found.select("key", "i", "value"), ["key", "i"], "left").withColumn("value", F.coalesce("value", F.lit(0.0)))
        out = found.select("labels", "key", ((F.col("i") + 1) * grid.step + grid.start).alias("step"), "value")
        return self._second(out, node.second)

    def _quantiles(self, node: TraceMetric, rows: DataFrame, grid: Grid) -> DataFrame:
        """From counts by power of two: the first bucket that reaches the rank, interpolated in exponents."""
        counts = rows.groupBy("key", "i", "bucket").agg(F.first("labels").alias("labels"), F.count("*").alias("n"))
        b = counts.groupBy("key", "i").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("bucket", "n"))).alias("b"), F.sum("n").alias("total"))
        b = b.withColumn("q", F.explode(F.array(*[F.lit(q) for q in node.quantiles])))
        rank = F.greatest(F.lit(1).cast("long"), F.ceil(F.col("q") * F.col("total")))

        def step(s: Column, x: Column) -> Column:
            done = s["seen"] + x["n"]
            hi = F.log2(x["bucket"])
            lo = F.coalesce(F.log2(s["last"]), hi - 1)
            value = F.when(done == s["rank"], x["bucket"]).otherwise(F.pow(F.lit(2.0), lo + (hi - lo) * ((s["rank"] - s["seen"]) / x["n"])))
            return F.struct(done.alias("seen"), x["bucket"].alias("last"), F.when(s["value"].isNull() & (done >= s["rank"]), value).otherwise(s["value"]).alias("value"), s["rank"].alias("rank"))

        start = F.struct(F.lit(0).cast("long").alias("seen"), F.lit(None).cast("double").alias("last"), F.lit(None).cast("double").alias("value"), rank.alias("rank"))
        value = F.aggregate("b", start, step)["value"]
        labels = F.map_concat("labels", F.create_map(F.lit("p"), F.col("q").cast("string")))
        out = b.select(labels.alias("labels"), F.to_json(labels).alias("key"), ((F.col("i") + 1) * grid.step + grid.start).alias("step"), value.alias("value"))
        return self._second(out, node.second)

    @staticmethod
    def _second(out: DataFrame, stages: tuple) -> DataFrame:
        for op, x in stages:
            if op in ("topk", "bottomk"):
                order = [F.col("value").desc(), F.col("key")] if op == "topk" else [F.col("value"), F.col("key").desc()]
                out = out.filter(~F.isnan("value")).withColumn("rank", F.row_number().over(Window.partitionBy("step").orderBy(*order))).filter(F.col("rank") <= x).drop("rank")
            else:
                out = out.filter(ieee.compare("==" if op == "=" else op, F.col("value"), F.lit(x)))
        return out

    def _math(self, node: TraceMath, grid: Grid) -> DataFrame:
        def side(x):
            return x if isinstance(x, float) else self._metric(x, grid)

        left, right = side(node.left), side(node.right)

        def value(a: Column, b: Column) -> Column:
            return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: F.when(b == 0, ieee.nan()).otherwise(a / F.when(b == 0, F.lit(1.0)).otherwise(b))}[node.op]()

        if isinstance(left, float) or isinstance(right, float):
            if isinstance(left, float) and isinstance(right, float):
                raise QueryError("arithmetic needs a metric")
            frame, a, b = (right, F.lit(left), F.col("value")) if isinstance(left, float) else (left, F.col("value"), F.lit(right))
            return frame.withColumn("value", value(a, b))
        # A side without labels is one number a step, and goes with every series of the other.
        l_by, r_by = _groups(node.left), _groups(node.right)
        keys = ["step"] if not l_by or not r_by else ["step", "key"]
        r = right.select("step", *(["key"] if len(keys) > 1 else [F.col("key").alias("rk")]), F.col("labels").alias("rl"), F.col("value").alias("rv"))
        rows = left.join(r, keys)
        labels, key = (F.col("rl"), F.col("rk") if len(keys) == 1 else F.col("key")) if not l_by and r_by else (F.col("labels"), F.col("key"))
        return rows.select(labels.alias("labels"), key.alias("key"), "step", value(F.col("value"), F.col("rv")).alias("value"))


def _groups(node) -> bool:
    if isinstance(node, float):
        return False
    if isinstance(node, TraceMath):
        return _groups(node.left) or _groups(node.right)
    return bool(node.by) or node.op in ("histogram_over_time", "quantile_over_time")


def _predicates(test) -> list[Predicate]:
    return [] if test is None else [test] if isinstance(test, Predicate) else _predicates(test[1]) + _predicates(test[2])


def _overlaps(first: Column, last: Column, start: int | None, end: int | None) -> Column:
    """Whether what lasts from first to last overlaps start..end; a bound that is None is open."""
    out = F.lit(True)
    if end is not None:
        out = out & (first < end)
    return out if start is None else out & (last >= start)


def _context() -> list[Column]:
    root = F.col("parent").isNull()
    return [F.min("start").alias("trace_start"), F.max("end").alias("trace_end"), (F.max("end") - F.min("start")).alias("trace_duration"), F.min_by("name", F.when(root, F.struct("start", "id"))).alias("root_name"), F.min_by("service", F.when(root, F.struct("start", "id"))).alias("root_service")]


def trace_context(spans: DataFrame) -> DataFrame:
    return spans.groupBy("trace").agg(*_context())


def assemble(spans: DataFrame) -> DataFrame:
    """trace, spans, roots, missing_parents, duplicates (ids given more than once), conflicts (with different content)."""
    payload = F.xxhash64("parent", "name", "service", "kind", "start", "end", "status", F.to_json("attrs"), F.to_json("resource"))
    by_id = spans.withColumn("payload", payload).groupBy("trace", "id").agg(F.count("*").alias("n"), F.count_distinct("payload").alias("kinds"), F.min("parent").alias("parent"))
    ids = by_id.select("trace", F.col("id").alias("parent")).withColumn("there", F.lit(True))
    seen = by_id.join(ids, ["trace", "parent"], "left")
    return seen.groupBy("trace").agg(F.sum("n").alias("spans"), F.count_if(F.col("parent").isNull()).alias("roots"), F.count_if(F.col("parent").isNotNull() & F.col("there").isNull()).alias("missing_parents"), F.count_if(F.col("n") > 1).alias("duplicates"), F.count_if(F.col("kinds") > 1).alias("conflicts"))


def neighbourhood(spans: DataFrame, trace: str, text: str, descendants: int = 0, ancestors: int = 0) -> DataFrame:
    """The spans of one trace that match, with so many levels below and above them."""
    own = spans.filter(F.col("trace") == trace)
    hits = own.filter(spanset_filter(parse(text).spansets[0].test)).select("trace", "id")
    down = up = hits
    out = hits
    for _ in range(descendants):
        down = _children(down, own).select("trace", "id")
        out = out.union(down)
    for _ in range(ancestors):
        up = own.join(up, ["trace", "id"], "left_semi").filter("parent is not null").select("trace", F.col("parent").alias("id"))
        out = out.union(up)
    return own.join(out.distinct(), ["trace", "id"], "left_semi")
