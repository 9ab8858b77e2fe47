"""The log language as DataFrame plans.

An entry is a row (ts, stream, bag, line, err): the bag holds the stream's labels, structured metadata and what parsers add.
Stages are column expressions, so that unread ones are pruned; only JSON flattening, IP ranges and strict logfmt use Arrow UDFs.
Metric queries explode entries to the steps whose window has them, and aggregate.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.labels import drop, java_regex, keep, key_of, labels_of, matches, no_labels, put, rekeyed, selects, value_of
from ..functions.template_loops import loop_template, needs_loops
from ..functions.templates import compile_template
from ..functions.units import bytes_of, seconds_of
from ..operators import rollups
from .grid import Grid, with_before
from .logql_parser import LogQuery, RangeAggregate, parse
from .promql import MetricPlanner, Scalar, arithmetic
from .promql_parser import Aggregate, Call, QueryError

ERROR, DETAILS = "__error__", "__error_details__"
#: The largest limit that one task takes; how many slices of time entries are counted by for a larger one, and about how many a task sorts.
MOST_TOP, SLICES, TASK_ROWS = 5_000, 4_096, 100_000
_MAP = "map<string,string>"


def pattern_regex(pattern: str, names: list[str] | None = None) -> str:
    """A pattern such as `<ip> - <_>` as a regular expression; names gets its captures."""
    out = ""
    parts = re.split(r"<([A-Za-z_]\w*)>", pattern)
    for i, p in enumerate(parts):
        if i % 2 == 0:
            out += re.escape(p)
            continue
        last = i == len(parts) - 2 and not parts[-1]
        body = ".*" if last else ".*?"
        if p == "_" or names is None:
            out += f"(?:{body})"
        else:
            names.append(p)
            out += f"({body})"
    return out


def _ip_test(pattern: str) -> Callable[[str], bool]:
    if "-" in pattern:
        low, high = (ipaddress.ip_address(x.strip()) for x in pattern.split("-", 1))
    elif "/" in pattern:
        net = ipaddress.ip_network(pattern, strict=False)
        low, high = net[0], net[-1]
    else:
        low = high = ipaddress.ip_address(pattern)

    def test(text: str) -> bool:
        try:
            a = ipaddress.ip_address(text)
        except ValueError:
            return False
        return a.version == low.version and low <= a <= high

    return test


_IP = re.compile(r"(?<![\w.:])(?:\d{1,3}(?:\.\d{1,3}){3}|[0-9A-Fa-f:]*:[0-9A-Fa-f:.]+)(?![\w:]|\.\w)")


def ip_filter(text: Column, pattern: str, whole: bool = False) -> Column:
    """Whether a text has (or is) an address in the pattern's range."""
    test = _ip_test(pattern)

    @F.pandas_udf("boolean")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: bool(t) and (test(t.strip()) if whole else any(test(c) for c in _IP.findall(t))))

    return run(text)


class _Source(str):
    """A JSON number in its own spelling."""


def flatten_json(text: str | None) -> dict[str, str] | None:
    """Nested keys joined by `_`; numbers keep their spelling; arrays and nulls go. None if the text is no JSON object."""
    try:
        value = json.loads(text or "", parse_int=_Source, parse_float=_Source)
    except ValueError:
        return None
    if not isinstance(value, dict):
        return None
    out: dict[str, str] = {}

    def walk(prefix: str, d: dict) -> None:
        for k, v in d.items():
            name = re.sub(r"[^a-zA-Z0-9_]", "_", f"{prefix}{k}")
            if isinstance(v, dict):
                walk(f"{name}_", v)
            elif isinstance(v, bool):
                out.setdefault(name, "true" if v else "false")
            elif isinstance(v, str):
                out.setdefault(name, str(v))

    walk("", value)
    return out


def _json_map(line: str) -> Column:
    @F.pandas_udf(_MAP)
    def run(s: pd.Series) -> pd.Series:
        return s.map(flatten_json)

    return run(line)


#: Range aggregates that add up over series, so that a sum over them may group while it counts.
ADDITIVE = {"count_over_time", "rate", "bytes_over_time", "bytes_rate", "sum_over_time"}
_FILLED_PAIR = r'([^\s="]+)=("(?:[^"\\]|\\.)+"|[^\s"]+)(?=\s|$)'
_PAIR = r'([^\s="]+)=("(?:[^"\\]|\\.)*"|[^\s"]*)(?=\s|$)'


def logfmt_map(line: Column, keep_empty: bool) -> Column:
    names = F.regexp_extract_all(line, F.lit(_PAIR), F.lit(1))
    values = F.regexp_extract_all(line, F.lit(_PAIR), F.lit(2))
    pairs = F.zip_with(names, values, lambda k, v: F.struct(F.regexp_replace(k, r"[^a-zA-Z0-9_]", "_").alias("k"), F.when(F.startswith(v, F.lit('"')), F.regexp_replace(F.substr(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v).alias("v")))
    wanted = pairs if keep_empty else F.filter(pairs, lambda p: p["v"] != "")
    return _first_of(wanted)


def labels_read(node: RangeAggregate) -> set[str] | None:
    """The labels that a range aggregate `by` some labels reads in its stages and groups; None where that cannot be told."""
    if node.without is not False and node.op != "approx_count_distinct":
        return None
    out = {*node.names, ERROR}
    if node.op == "approx_count_distinct":
        out.add(node.param.value)

    def tested(test: tuple) -> None:
        if test[0] in ("and", "or"):
            tested(test[1]), tested(test[2])
        else:
            out.add(test[1])

    def read(template: str) -> bool:
        if needs_loops(template) or re.search(r"\{\{[^}]*(?:\s|\()\.(?:\s|\)|\})", template):
            return False  # the whole bag is read
        out.update(re.findall(r"\.([A-Za-z_]\w*)", template))
        return True

    for stage in node.logs.stages:
        kind = stage[0]
        if kind == "filter":
            tested(stage[1])
        elif kind == "unwrap":
            out.add(stage[1])
        elif kind in ("drop", "keep"):
            out.update(name for name, _, _ in stage[1])
        elif kind == "line_format":
            if not read(stage[1]):
                return None
        elif kind == "label_format":
            for label, how, source in stage[1]:
                out.add(label)
                if how == "label":
                    out.add(source)
                elif not read(source):
                    return None
    return out


def _first_of(pairs: Column) -> Column:
    """A map of pairs (k, v) in which the first of equal keys counts."""
    return F.aggregate(pairs, no_labels(), lambda m, p: F.when(F.map_contains_key(m, p["k"]), m).otherwise(F.map_concat(m, F.create_map(p["k"], p["v"]))))


class LogPlanner(MetricPlanner):
    """Translates queries over one logs table (stream, meta, key, ts, line)."""

    def __init__(self, logs: DataFrame, grid: Grid, minutes: DataFrame | None = None):
        """minutes: the minute rollup with metadata, which answers counts and bytes where windows begin and end on minutes."""
        super().__init__(logs, grid)
        self.logs, self.minutes = logs, minutes
        self.wanted: set[str] | None = None  # the only labels that a pipeline's result needs, if known

    def parse(self, query: str):
        return parse(query)

    def run(self, query: str, limit: int = 100, backward: bool = True) -> DataFrame:
        """Log queries: ts, labels, line of the newest (or oldest) entries. Metric queries: labels, step, value."""
        node = parse(query)
        if isinstance(node, LogQuery):
            return self.newest(self.entries(node), self._in_span(node), limit, backward)
        return self.result(node)

    # -- log queries

    def select(self, node: LogQuery) -> DataFrame:
        rows = self.logs
        for name, op, value in node.matchers:
            rows = rows.filter(selects(F.col("stream"), name, op, value))
        return rows

    def entries(self, node: LogQuery, start: int | None = None, end: int | None = None) -> DataFrame:
        """Entries start <= ts < end of the grid's span after the pipeline."""
        return self.pipeline(self._in_span(node, start, end), node.stages)

    def _in_span(self, node: LogQuery, start: int | None = None, end: int | None = None) -> DataFrame:
        """The entries that a pipeline gets; it adds none."""
        low, high = self.grid.start if start is None else start, self.grid.end if end is None else end
        return self.select(node).filter((F.col("ts") >= low) & (F.col("ts") < high))

    def newest(self, entries: DataFrame, given: DataFrame, limit: int, backward: bool) -> DataFrame:
        """The first entries in order of time; given: what their pipeline got.

        Spark takes the first rows of an order in one task, which holds up to a limit of them from each partition. Above MOST_TOP, entries
        are dealt to tasks by slices of time, whose bounds come from a count of what is given, and sorted there; a limit that cuts is
        found by counts of entries.
        """
        order = [F.col("ts").desc() if backward else F.col("ts"), F.col("line"), key_of(F.col("bag"))]
        labels = F.when(F.col("err").isNull(), F.col("bag")).otherwise(F.map_concat(drop(F.col("bag"), [ERROR]), F.create_map(F.lit(ERROR), F.col("err"))))
        if limit <= MOST_TOP:
            first = entries.orderBy(*order).limit(limit)
        else:
            at, _, counts = self._slices(given, self.grid.start, self.grid.end, backward)
            first = entries if sum(counts.values()) <= limit else self._cut(entries, limit, order, backward)
            first = self._sorted(first, order, at, counts)
        return first.select("ts", labels.alias("labels"), "line")

    @staticmethod
    def _slices(rows: DataFrame, low: int, high: int, backward: bool) -> tuple[Column, int, dict[int, int]]:
        """The slice of time of a row between low and high, 0 for the first in order; how long one is; how many rows are in each."""
        width = max(1, -(-(high - low) // SLICES))
        ahead = F.lit(high - 1) - F.col("ts") if backward else F.col("ts") - low
        at = F.call_function("div", ahead, F.lit(width).cast("long"))
        return at, width, {r["at"]: r["count"] for r in rows.filter((F.col("ts") >= low) & (F.col("ts") < high)).groupBy(at.alias("at")).count().collect()}

    @staticmethod
    def _sorted(rows: DataFrame, order: list[Column], at: Column, counts: dict[int, int]) -> DataFrame:
        """Rows in order, where the counts of slices bound them; Spark's sort, which computes rows twice to deal them out, where most rows are in few slices."""
        if max(counts.values(), default=0) > 4 * TASK_ROWS:
            return rows.orderBy(*order)
        parts, seen = [], 0
        for i in range(max(counts, default=0) + 1):
            parts.append(seen // TASK_ROWS)
            seen += counts.get(i, 0)
        return rows.repartitionById(parts[-1] + 1, F.get(F.lit(parts), at.cast("int"))).sortWithinPartitions(*order)

    def _cut(self, entries: DataFrame, limit: int, order: list[Column], backward: bool) -> DataFrame:
        """The first `limit` entries, in no order: all before a slice of time, which is narrowed down while it has many, and the first of that slice."""
        low, high, room, n, ts = self.grid.start, self.grid.end, limit, None, F.col("ts")
        while n is None or n > MOST_TOP and high - low > 1:
            _, width, counts = self._slices(entries, low, high, backward)
            for i in sorted(counts):
                if counts[i] > room:
                    break
                room -= counts[i]
            else:
                return entries
            n = counts[i]
            low, high = (max(low, high - (i + 1) * width), high - i * width) if backward else (low + i * width, min(high, low + (i + 1) * width))
        whole = entries.filter(ts >= high if backward else ts < low)
        return whole.unionByName(entries.filter((ts >= low) & (ts < high)).orderBy(*order).limit(room))

    def sampled(self, query: str, interval: int, limit: int = 100, backward: bool = True) -> DataFrame:
        """Entries in order of time, each at least `interval` (ns) after the one kept before it, over all streams.

        What is kept depends on all before it, so the ordered entries pass one task, a batch at a time; only the last time is held.
        """
        rows = self.entries(parse(query)).select("ts", F.col("bag").alias("labels"), "line")
        order = [F.col("ts").desc(), F.col("line").desc()] if backward else ["ts", "line"]

        def keep_apart(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            last, left = None, limit
            for batch in batches:
                kept = []
                for i, ts in enumerate(batch["ts"]):
                    if left and (last is None or abs(ts - last) >= interval):
                        kept.append(i)
                        last, left = ts, left - 1
                yield batch.iloc[kept]
                if not left:
                    return

        return rows.repartition(1).sortWithinPartitions(*order).mapInPandas(keep_apart, rows.schema)

    def pipeline(self, rows: DataFrame, stages: tuple) -> DataFrame:
        rows = rows.select("ts", "key", "stream", self._bag().alias("bag"), "line", F.lit(None).cast("string").alias("err"), F.col("line").alias("raw"))
        for stage in stages:
            rows = getattr(self, f"_{stage[0]}")(rows, *stage[1:])
        return rows

    def _line(self, rows: DataFrame, op: str, values: tuple) -> DataFrame:
        def test(kind: str, value: str) -> Column:
            if kind == "ip":
                return ip_filter(F.col("line"), value)
            if op in ("|=", "!="):
                return F.contains("line", F.lit(value))
            if op in ("|~", "!~"):
                return F.col("line").rlike(java_regex(value))
            return F.col("line").rlike("(?s)" + pattern_regex(value))

        any_of = test(*values[0])
        for v in values[1:]:
            any_of = any_of | test(*v)
        return rows.filter(any_of if op[0] == "|" else ~any_of)

    def _added(self, rows: DataFrame, found: Column) -> DataFrame:
        """Adds a parser's map: a name of the stream gets a suffix, and what an earlier parser gave stays."""
        rows = _once(rows, "found", F.coalesce(found, no_labels()))
        renamed = F.transform_keys("found", lambda k, v: F.when(F.map_contains_key(F.col("stream"), k), F.concat(k, F.lit("_extracted"))).otherwise(k))
        new = F.map_filter(renamed, lambda k, v: ~F.map_contains_key(F.col("bag"), k))
        return _once(rows, "bag", F.map_concat("bag", new)).drop("found")

    def _json(self, rows: DataFrame, fields: tuple = (), flags: tuple = ()) -> DataFrame:
        if fields:
            broken = F.try_parse_json("line").isNull()
            pairs = [F.struct(F.lit(k).alias("k"), F.coalesce(F.get_json_object("line", json_path(path)), F.lit("")).alias("v")) for k, path in fields]
            out = self._added(rows, F.when(~broken, _first_of(F.array(*pairs))))
        else:
            rows = rows.withColumn("parsed", _json_map("line"))
            broken = F.col("parsed").isNull()
            out = self._added(rows, F.col("parsed"))
        return out.withColumn("err", F.coalesce("err", F.when(broken, F.lit("JSONParserErr")))).drop("parsed")

    def _logfmt_wanted(self, rows: DataFrame, names: list[str]) -> DataFrame:
        """As logfmt, but of what it finds only some labels are kept: no map of all pairs is made."""
        key = lambda k: F.regexp_replace(k, r"[^a-zA-Z0-9_]", "_")
        found = F.regexp_extract_all("line", F.lit(_FILLED_PAIR), F.lit(1))
        if any("_" in n for n in names):  # other characters become _
            found = F.transform(found, key)
        rows = _once(rows, "found", F.struct(found.alias("k"), F.regexp_extract_all("line", F.lit(_FILLED_PAIR), F.lit(2)).alias("v")))

        def value(name: str) -> Column:
            v = F.get("found.v", F.array_position("found.k", F.lit(name)).cast("int") - 1)
            return F.when(F.startswith(v, F.lit('"')), F.regexp_replace(F.substr(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v)

        pairs = []
        for n in names:
            own = F.element_at("bag", n)
            given = F.when(F.element_at("stream", n).isNull(), value(n))
            if n.endswith("_extracted"):
                base = n.removesuffix("_extracted")
                given = F.coalesce(given, F.when(F.element_at("stream", base).isNotNull(), value(base)))
            pairs.append(F.when(F.coalesce(own, given).isNotNull(), F.struct(F.lit(n).alias("key"), F.coalesce(own, given).alias("value"))))
        return _once(rows, "bag", F.map_from_entries(F.array_compact(F.array(*pairs)))).drop("found")

    def _logfmt(self, rows: DataFrame, fields: tuple = (), flags: tuple = ()) -> DataFrame:
        if self.wanted is not None and not fields and not flags:
            return self._logfmt_wanted(rows, sorted(self.wanted - {ERROR}))
        found = logfmt_map(F.col("line"), "--keep-empty" in flags)
        if fields:
            pairs = [F.struct(F.lit(k).alias("k"), F.coalesce(F.element_at(found, source), F.lit("")).alias("v")) for k, source in fields]
            found = _first_of(F.array(*pairs))
        out = self._added(rows, found)
        if "--strict" in flags:
            rest = F.regexp_replace("line", _PAIR, "")
            out = out.withColumn("err", F.coalesce("err", F.when(F.trim(rest) != "", F.lit("LogfmtParserErr"))))
        return out

    def _regexp(self, rows: DataFrame, pattern: str) -> DataFrame:
        names = re.findall(r"\(\?P?<([A-Za-z_]\w*)>", pattern)
        if not names:
            raise QueryError("regexp needs a named capture")
        java = java_regex(pattern)
        groups = [m.start() for m in re.finditer(r"(?<!\\)\((?!\?)|\(\?<[A-Za-z]", java)]
        named = [m.start() for m in re.finditer(r"\(\?<[A-Za-z]", java)]
        pairs = [F.struct(F.lit(n).alias("k"), F.regexp_extract("line", java, groups.index(at) + 1).alias("v")) for n, at in zip(names, named, strict=True)]
        return self._added(rows, F.when(F.col("line").rlike(java), _first_of(F.filter(F.array(*pairs), lambda p: p["v"] != ""))))

    def _pattern(self, rows: DataFrame, pattern: str) -> DataFrame:
        names: list[str] = []
        regex = "(?s)^" + pattern_regex(pattern, names)
        if not names:
            raise QueryError("a pattern needs a named capture")
        pairs = [F.struct(F.lit(n).alias("k"), F.regexp_extract("line", regex, i + 1).alias("v")) for i, n in enumerate(names)]
        return self._added(rows, F.when(F.col("line").rlike(regex), _first_of(F.array(*pairs))))

    def _unpack(self, rows: DataFrame) -> DataFrame:
        found = F.from_json("line", F.lit(_MAP))
        broken = F.try_parse_json("line").isNull() | found.isNull()
        out = self._added(rows.withColumn("unpacked", F.when(~broken, found)), F.map_filter(F.coalesce("unpacked", no_labels()), lambda k, v: (k != "_entry") & v.isNotNull()))
        return out.withColumn("line", F.coalesce(F.element_at("unpacked", "_entry"), F.col("line"))).withColumn("err", F.coalesce("err", F.when(F.col("unpacked").isNull(), F.lit("JSONParserErr")))).drop("unpacked")

    @staticmethod
    def _template(text: str) -> Column:
        if needs_loops(text):
            return loop_template(text, F.col("bag"), F.col("line"), F.col("ts"))
        return compile_template(text, lambda name: value_of(F.col("bag"), name), F.col("line"), F.col("ts"))

    def _line_format(self, rows: DataFrame, text: str) -> DataFrame:
        if not needs_loops(text):
            return rows.withColumn("line", self._template(text))
        # A row on which the template fails keeps its line.
        made = _once(rows, "made", self._template(text))
        return made.withColumn("err", F.coalesce("err", F.when(F.col("made").isNull(), F.lit("TemplateFormatErr")))).withColumn("line", F.coalesce("made", "line")).drop("made")

    def _label_format(self, rows: DataFrame, changes: tuple) -> DataFrame:
        """All values come from the bag before the stage; a renamed label goes."""
        bag = F.col("bag")
        values = [(label, value_of(bag, source) if kind == "label" else self._template(source)) for label, kind, source in changes]
        gone = [source for label, kind, source in changes if kind == "label" and source != label]
        new = drop(bag, gone)
        for label, value in values:
            new = put(new, label, value)
        return rows.withColumn("bag", new)

    def _chosen(self, names: tuple) -> Callable[[Column, Column], Column]:
        def test(k: Column, v: Column) -> Column:
            out = F.lit(False)
            for name, op, value in names:
                hit = k == name
                out = out | (hit if op is None else hit & matches(v, op, value))
            return out

        return test

    def _drop(self, rows: DataFrame, names: tuple) -> DataFrame:
        test = self._chosen(names)
        rows = rows.withColumn("bag", F.map_filter("bag", lambda k, v: ~test(k, v)))
        return rows.withColumn("err", F.lit(None).cast("string")) if any(n == ERROR for n, _, _ in names) else rows

    def _keep(self, rows: DataFrame, names: tuple) -> DataFrame:
        return rows.withColumn("bag", F.map_filter("bag", self._chosen(names)))

    def _decolorize(self, rows: DataFrame) -> DataFrame:
        return rows.withColumn("line", F.regexp_replace("line", "\x1b\\[[0-9;]*[A-Za-z]", ""))

    def _unwrap(self, rows: DataFrame, label: str, conversion: str | None) -> DataFrame:
        text = F.element_at("bag", label)
        value = bytes_of(text) if conversion == "bytes" else seconds_of(text) if conversion else text.try_cast("double")
        rows = rows.filter(text.isNotNull()).withColumn("value", value)
        return rows.withColumn("err", F.coalesce("err", F.when(F.col("value").isNull(), F.lit("SampleExtractionErr")))).withColumn("bag", drop(F.col("bag"), [label]))

    def _filter(self, rows: DataFrame, test: tuple) -> DataFrame:
        keeps, err = self._tested(test)
        return rows.withColumn("keeps", keeps).withColumn("err", F.coalesce("err", err)).filter("keeps").drop("keeps")

    def _tested(self, test: tuple) -> tuple[Column, Column]:
        """Whether an entry stays, and the error that the filter finds; a value that does not parse keeps its entry."""
        none = F.lit(None).cast("string")
        if test[0] in ("and", "or"):
            (a, ea), (b, eb) = self._tested(test[1]), self._tested(test[2])
            return (a & b, F.coalesce(ea, eb)) if test[0] == "and" else (a | b, F.coalesce(ea, F.when(~a, eb)))
        kind, name, op, operand = test
        given = F.coalesce("err", F.lit("")) if name == ERROR else value_of(F.col("bag"), name)
        if kind == "text":
            return matches(given, "=" if op == "==" else op, operand), none
        if kind == "ip":
            hit = ip_filter(given, operand, whole=True)
            return (~hit if op == "!=" else hit), none
        parsed = {"number": lambda: given.try_cast("double"), "duration": lambda: seconds_of(given), "bytes": lambda: bytes_of(given)}[kind]()
        missing = ~F.map_contains_key(F.col("bag"), name)
        hit = F.coalesce(arithmetic("==" if op == "=" else op, parsed, F.lit(float(operand))), F.lit(True))
        return ~missing & hit, F.when(~missing & parsed.isNull(), F.lit("LabelFilterErr"))

    # -- metric queries

    def eval(self, node, grid: Grid):
        if isinstance(node, LogQuery):
            raise QueryError("a log query is no value")
        if isinstance(node, RangeAggregate):
            return self.range_aggregate(node, grid)
        return super().eval(node, grid)

    def call(self, node: Call, grid: Grid):
        if node.name == "vector":
            return self._vector(Scalar(constant=node.args[0].value), grid)
        return super().call(node, grid)

    @staticmethod
    def group_labels(node: Aggregate) -> Column:
        return drop(F.col("labels"), list(node.names)) if node.without else keep(F.col("labels"), list(node.names))

    def aggregate(self, node: Aggregate, grid: Grid) -> DataFrame:
        inner = node.inner
        if node.op == "sum" and not node.without and isinstance(inner, RangeAggregate) and inner.op in ADDITIVE and inner.without is None:
            return self.range_aggregate(replace(inner, names=node.names, without=False), grid)  # groups while it counts
        return super().aggregate(node, grid)

    def range_aggregate(self, node: RangeAggregate, grid: Grid) -> DataFrame:
        if self.minutes is not None and self._in_minutes(node, grid):
            return self._minute_counts(node, grid)
        low = grid.start - node.window - node.offset + 1
        self.wanted = labels_read(node)
        rows = self.entries(node.logs, low, grid.end - node.offset + 1).withColumn("ts", F.col("ts") + node.offset)
        self.wanted = None
        if node.op == "absent_over_time":
            missing = grid.frame(self.spark).join(grid.windows(rows, node.window).select("step").distinct(), "step", "left_anti")
            equal = {k: v for k, op, v in node.logs.matchers if op == "="}
            labels = F.create_map(*[F.lit(x) for kv in equal.items() for x in kv]) if equal else no_labels()
            return rekeyed(missing.select(labels.alias("labels"), "step", F.lit(1.0).alias("value")))
        # An entry with an error fails the query unless a filter asked for the error.
        asked = ERROR in str(node.logs.stages)
        if not asked:
            rows = rows.withColumn("ts", F.when(F.col("err").isNotNull(), F.raise_error(F.concat(F.lit("pipeline error: "), F.col("err"))).cast("long")).otherwise(F.col("ts")))
        labels = F.col("bag")
        if node.op == "approx_count_distinct":
            labels = keep(labels, list(node.names))
        elif node.without is not None:
            labels = drop(labels, list(node.names)) if node.without else keep(labels, list(node.names))
        rows = rekeyed(rows.withColumn("labels", labels))
        seconds = node.window / 1e9
        size = F.sum(F.octet_length("line")).cast("double")
        v = F.col("value")
        record = F.struct("ts", "raw", "value") if node.unwrap else F.struct("ts")
        value = {
            "count_over_time": lambda: F.count("*").cast("double"), "bytes_over_time": lambda: size, "bytes_rate": lambda: size / seconds,
            "rate": lambda: ieee.sum_of(v) / seconds if node.unwrap else F.count("*") / F.lit(seconds), "sum_over_time": lambda: ieee.sum_of(v), "avg_over_time": lambda: ieee.mean_of(v), "min_over_time": lambda: ieee.least_of(v), "max_over_time": lambda: ieee.most_of(v),
            "stddev_over_time": lambda: F.stddev_pop(v), "stdvar_over_time": lambda: F.var_pop(v), "first_over_time": lambda: F.min_by(v, record), "last_over_time": lambda: F.max_by(v, record),
            "quantile_over_time": lambda: ieee.interpolated(F.lit(node.param.value), F.array_sort(F.collect_list(v))),
            "approx_count_distinct": lambda: F.count_distinct(value_of(F.col("bag"), node.param.value)).cast("double"),
        }
        if node.op == "rate_counter":
            return self._counter_rate(rows, node, grid)
        out = grid.windows(rows, node.window).groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), value[node.op]().alias("value"))
        return out.select("labels", "key", "step", "value")

    @staticmethod
    def _in_minutes(node: RangeAggregate, grid: Grid) -> bool:
        """Whether the minute rollup gives the same numbers: no stage reads lines, and all windows fall on minutes."""
        fits = node.op in ("count_over_time", "rate", "bytes_over_time", "bytes_rate") and not node.unwrap and not node.logs.stages
        return fits and not node.offset % rollups.MINUTE and rollups.eligible(grid, node.window)

    def _minute_counts(self, node: RangeAggregate, grid: Grid) -> DataFrame:
        rows = self.minutes
        for name, op, value in node.logs.matchers:
            rows = rows.filter(selects(F.col("stream"), name, op, value))
        rows = grid.windows(rows.withColumn("ts", F.col("minute") + node.offset), node.window)
        bag = self._bag()
        if node.without is not None:
            bag = drop(bag, list(node.names)) if node.without else keep(bag, list(node.names))
        total = F.sum("bytes" if node.op.startswith("bytes") else "count").cast("double")
        seconds = node.window / 1e9 if node.op.endswith("rate") else 1.0
        out = rekeyed(rows.withColumn("labels", bag)).groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), (total / seconds).alias("value"))
        return out.select("labels", "key", "step", "value")

    @staticmethod
    def _bag() -> Column:
        meta = F.transform_keys("meta", lambda k, v: F.when(F.map_contains_key(F.col("stream"), k), F.concat(k, F.lit("_extracted"))).otherwise(k))
        return F.map_concat("stream", meta)

    def _counter_rate(self, rows: DataFrame, node: RangeAggregate, grid: Grid) -> DataFrame:
        """As the metric language's rate, but a single entry gives 0 and the ends are limited before the zero line is."""
        rows = with_before(rows.select("key", "ts", "raw", "value"), ["ts", "raw"], grid.start - node.window, grid.end)
        a, order = F.struct("value", "lost"), F.struct("ts", "raw")
        out = grid.windows(rows, node.window).groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), F.min_by(a, order).alias("a"), F.max_by(a, order).alias("b"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"))
        gain = F.col("b.value") - F.col("a.value") + F.col("b.lost") - F.col("a.lost")
        span = (F.col("t1") - F.col("t0")) / F.lit(1e9)
        gap = span / F.greatest(F.col("n") - 1, F.lit(1))
        left, right = (F.col("t0") - (F.col("step") - node.window)) / F.lit(1e9), (F.col("step") - F.col("t1")) / F.lit(1e9)
        left, right = (F.when(x >= gap * 1.1, gap / 2).otherwise(x) for x in (left, right))
        left = F.when((gain > 0) & (F.col("a.value") >= 0), F.least(left, span * F.col("a.value") / F.when(gain > 0, gain).otherwise(F.lit(1.0)))).otherwise(left)
        value = F.when((F.col("n") < 2) | (span <= 0), F.lit(0.0)).otherwise(gain * (span + left + right) / F.when(span > 0, span).otherwise(F.lit(1.0)) / (node.window / 1e9))
        return out.select("labels", "key", "step", value.alias("value"))

    def arithmetic(self, op: str, a: Column, b: Column) -> Column:
        """Dividing by zero gives NaN here, never an infinity."""
        out = arithmetic(op, a, b)
        return F.when(b == 0, ieee.nan()).otherwise(out) if op == "/" else out


def _once(rows: DataFrame, name: str, value: Column) -> DataFrame:
    """A column that is computed once a row: the optimizer copies what a projection computes into each later use, but never through a generator."""
    return rows.select(*[c for c in rows.columns if c != name], F.explode(F.array(value)).alias(name))


def json_path(path: str) -> str:
    """`a.b[0]["c"]` as a JSON path."""
    return "$" + "".join(f"['{m[1] or m[3]}']" if (m[1] or m[3]) else f"[{m[2]}]" for m in re.finditer(r'\.?([A-Za-z_][\w-]*)|\[(\d+)\]|\["([^"]*)"\]', path))
