"""The metric language as DataFrame plans.

A vector is a DataFrame (labels, key, step, value): one row for each series and step of the grid. Windows are an explode of
each sample to the steps that see it, never a range join; per-window functions are plain aggregates over (key, step), so
partial aggregation runs before the shuffle. Counter functions use prefix sums of resets from one lag over each series.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.label_hash import label_hash
from ..functions.labels import NAME, drop, java_regex, keep, key_of, labels_of, no_labels, put, rekeyed, selects, value_of
from .grid import Grid, with_before
from . import native
from .promql_parser import TRIMS, Aggregate, Binary, Call, Negative, Number, QueryError, Selector, Subquery, Text, parse, resolved

LOOKBACK = 300 * 10**9
#: The resolution of a subquery that names none.
RESOLUTION = 60 * 10**9
_COUNTERS = ("_total", "_sum", "_count", "_bucket")
_COMPARE = {"==", "!=", ">", "<", ">=", "<="}
_SETS = {"and", "or", "unless"}


def _v() -> Column:
    return F.col("value")


class Scalar:
    """A number for each step: a column over step, or a DataFrame (step, value)."""

    def __init__(self, column: Column | None = None, frame: DataFrame | None = None, constant: float | None = None):
        self.frame, self.constant = frame, constant
        self.column = F.lit(constant) if constant is not None else column


def _seconds(ns: Column) -> Column:
    return ns / F.lit(1e9)


def _sorted_values() -> Column:
    return F.transform(F.array_sort(F.collect_list(F.struct("ts", "value"))), lambda x: x["value"])


def _median(values: Column) -> Column:
    return ieee.interpolated(F.lit(0.5), F.array_sort(values))


def _points(n: int) -> Column:
    return F.slice(F.array_sort(F.collect_list(F.struct("ts", "value"))), -n, n)


#: Functions of a window that a single aggregate gives; NaN and infinities behave as in IEEE arithmetic.
SIMPLE: dict[str, Callable[[], Column]] = {
    "sum_over_time": lambda: ieee.sum_of(_v()),
    "avg_over_time": lambda: ieee.mean_of(_v()),
    "min_over_time": lambda: ieee.least_of(_v()),
    "max_over_time": lambda: ieee.most_of(_v()),
    "count_over_time": lambda: F.count(_v()).cast("double"),
    "present_over_time": lambda: F.max(F.lit(1.0)),
    "first_over_time": lambda: F.min_by(_v(), F.col("ts")),
    "last_over_time": lambda: F.max_by(_v(), F.col("ts")),
    "stddev_over_time": lambda: F.stddev_pop(_v()),
    "stdvar_over_time": lambda: F.var_pop(_v()),
    "ts_of_first_over_time": lambda: _seconds(F.min("ts")),
    "ts_of_last_over_time": lambda: _seconds(F.max("ts")),
    "ts_of_max_over_time": lambda: _seconds(F.max_by("ts", F.struct((~F.isnan(_v())).cast("int"), _v(), F.col("ts")))),
    "ts_of_min_over_time": lambda: _seconds(F.max_by("ts", F.struct((~F.isnan(_v())).cast("int"), -_v(), F.col("ts")))),
}
_EXTRAPOLATED = {"rate", "increase", "delta"}
_LAST_TWO = {"irate", "idelta"}
_PAIRS = {"changes", "resets"}
_FITS = {"deriv", "predict_linear"}
_KEEP_NAME = {"first_over_time", "last_over_time"}
RANGE_FUNCTIONS = {*SIMPLE, *_EXTRAPOLATED, *_LAST_TWO, *_PAIRS, *_FITS, "quantile_over_time", "mad_over_time", "double_exponential_smoothing", "holt_winters"}

_H = float("inf")
#: Functions of one number.
MATH: dict[str, Callable[[Column], Column]] = {
    "abs": F.abs, "exp": F.exp, "ceil": lambda v: _whole(F.ceil, v), "floor": lambda v: _whole(F.floor, v), "sqrt": F.sqrt,
    "ln": lambda v: ieee.log(v), "log2": lambda v: ieee.log(v, 2), "log10": lambda v: ieee.log(v, 10),
    "sgn": lambda v: F.when(F.isnan(v), ieee.nan()).otherwise(F.signum(v)),
    "sin": F.sin, "cos": F.cos, "tan": F.tan, "asin": lambda v: ieee.within(v, -1, 1, F.asin(v)), "acos": lambda v: ieee.within(v, -1, 1, F.acos(v)), "atan": F.atan,
    "sinh": F.sinh, "cosh": F.cosh, "tanh": F.tanh, "asinh": F.asinh, "acosh": lambda v: ieee.within(v, 1, _H, F.acosh(v)),
    "atanh": lambda v: F.when(F.abs(v) == 1, v * F.lit(_H)).otherwise(ieee.within(v, -1, 1, F.atanh(F.when(F.abs(v) < 1, v).otherwise(F.lit(0.0))))),
    "deg": F.degrees, "rad": F.radians,
}


def _whole(f, v: Column) -> Column:
    """ceil and floor give longs; what a long cannot hold is whole anyway."""
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise(f(F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), F.lit(0.0)).otherwise(v)).cast("double"))


def _instant(seconds: Column) -> Column:
    return F.timestamp_seconds(F.floor(seconds).cast("long"))


CALENDAR: dict[str, Callable[[Column], Column]] = {
    "year": lambda v: F.year(_instant(v)), "month": lambda v: F.month(_instant(v)), "day_of_month": lambda v: F.day(_instant(v)),
    "day_of_week": lambda v: F.dayofweek(_instant(v)) - 1, "day_of_year": lambda v: F.dayofyear(_instant(v)), "days_in_month": lambda v: F.day(F.last_day(_instant(v))),
    "hour": lambda v: F.hour(_instant(v)), "minute": lambda v: F.minute(_instant(v)),
}


def arithmetic(op: str, a: Column, b: Column) -> Column:
    if op in _COMPARE:
        return ieee.compare(op, a, b)
    return {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: ieee.div(a, b), "%": lambda: ieee.mod(a, b), "^": lambda: ieee.power(a, b), "atan2": lambda: F.atan2(a, b)}[op]()


class MetricPlanner:
    """Translates queries over one samples table into plans on a grid."""

    def __init__(self, samples: DataFrame, grid: Grid, lookback: int = LOOKBACK):
        self.samples, self.grid, self.lookback = samples, grid, lookback
        self.spark: SparkSession = samples.sparkSession
        self.said: dict[tuple[str, str], None] = {}  # (kind, message) of what the query alone shows
        self.doubts: list[DataFrame] = []  # frames (kind, message) of what only the data show
        self.hours: DataFrame | None = None

    def run(self, query: str) -> DataFrame:
        """labels, step (ns), value; with a column h in the samples also h, a native histogram where value is null."""
        return self.result(parse(query))

    def result(self, node) -> DataFrame:
        out = self.eval(resolved(node, self.grid.step / 1e9, (self.grid.end - self.grid.start) / 1e9), self.grid)
        if isinstance(out, Scalar):
            out = self._vector(out, self.grid)
        return out.select("labels", "step", "value", *(["h"] if native.has_native(out) else []))

    # -- annotations

    def say(self, kind: str, message: str) -> None:
        self.said[kind, message] = None

    def doubt(self, rows: DataFrame, message: Column, kind: str = "warning") -> None:
        self.doubts.append(rows.select(F.lit(kind).alias("kind"), message.alias("message")).distinct())

    def annotations(self) -> DataFrame:
        """kind (info or warning) and message for the queries run so far; a frame of its own, so that results stay lazy and whole."""
        out = self.spark.createDataFrame(list(self.said), "kind string, message string")
        for d in self.doubts:
            out = out.unionByName(d)
        return out.distinct()

    def _quantile_doubt(self, q) -> None:
        if isinstance(q, Scalar) and q.constant is not None and not 0 <= q.constant <= 1:
            self.say("warning", f"quantile value should be between 0 and 1, got {q.constant:g}")

    def arithmetic(self, op: str, a: Column, b: Column) -> Column:
        return arithmetic(op, a, b)

    # -- nodes

    def eval(self, node, grid: Grid):
        if isinstance(node, Number):
            return Scalar(constant=node.value)
        if isinstance(node, Negative):
            inner = self.eval(node.inner, grid)
            if isinstance(inner, Scalar):
                return self._map_scalar(inner, lambda v: -v)
            if native.has_native(inner):
                turned = native.histograms(inner).withColumn("h", native.nh.scaled(F.col("h"), F.lit(-1.0))).withColumn("labels", drop(F.col("labels"), [NAME]))
                return native.both(self._mapped(inner, -_v()), rekeyed(turned))
            return self._mapped(inner, -_v())
        if isinstance(node, Selector):
            if node.window:
                raise QueryError("a range vector is no result")
            return self.instant(node, grid)
        if isinstance(node, Aggregate):
            return self.aggregate(node, grid)
        if isinstance(node, Binary):
            return self.binary(node, grid)
        if isinstance(node, Call):
            return self.call(node, grid)
        if isinstance(node, Subquery):
            raise QueryError("a subquery is a range vector")
        raise QueryError(f"no value: {node}")

    # -- selection

    def selected(self, node: Selector) -> DataFrame:
        """Samples of the matching series, shifted by the offset."""
        rows = self.samples
        for name, op, value in node.matchers:
            rows = rows.filter(selects(F.col("labels"), name, op, value))
        return rows.withColumn("ts", F.col("ts") + node.offset) if node.offset else rows

    def _pinned(self, node, grid: Grid) -> Grid:
        if node.at is None:
            return grid
        at = {"start": self.grid.start, "end": self.grid.end}.get(node.at, node.at) if isinstance(node.at, str) else node.at
        return Grid(at, at, grid.step)

    def _spread(self, vector: DataFrame, node, grid: Grid) -> DataFrame:
        """What is pinned to one time holds at every step."""
        if node.at is None:
            return vector
        steps = F.transform(F.sequence(F.lit(0), F.lit(grid.count - 1)), lambda i: i.cast("long") * grid.step + grid.start)
        return vector.withColumn("step", F.explode(steps))

    def instant(self, node: Selector, grid: Grid, with_time: bool = False) -> DataFrame:
        """The newest sample within the lookback; none if that is a stale marker."""
        own = self._pinned(node, grid)
        rows = own.windows(self.selected(node), self.lookback)
        also = ["h"] if native.has_native(rows) else []
        newest = rows.groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), F.max_by(F.struct("value", "stale", "ts", *also), F.col("ts")).alias("s")).filter(~F.col("s.stale"))
        value = _seconds(F.col("s.ts") - node.offset) if with_time else F.col("s.value")
        return self._spread(newest.select("labels", "key", "step", value.alias("value"), *([] if with_time else [f"s.{c}" for c in also])), node, grid)

    # -- windows

    def _window_rows(self, node, grid: Grid) -> tuple[DataFrame, int, Grid]:
        """Samples of a range vector (labels, key, ts, value) without stale ones, its window and grid."""
        own = self._pinned(node, grid)
        if isinstance(node, Selector):
            if not node.window:
                raise QueryError("a range vector is needed")
            rows = self.selected(node).filter(~F.col("stale"))
            return rows.select("labels", "key", "ts", "value", *(["h"] if native.has_native(rows) else [])), node.window, own
        if isinstance(node, Subquery):
            step = node.step or RESOLUTION
            low, high = own.start - node.offset - node.window, own.end - node.offset
            first = low - low % step + step  # times are multiples of the resolution, after the window's open start
            inner = self.eval(node.inner, Grid(first, high, step))
            if isinstance(inner, Scalar):
                inner = self._vector(inner, Grid(first, high, step))
            return inner.select("labels", "key", (F.col("step") + node.offset).alias("ts"), "value", *(["h"] if native.has_native(inner) else [])), node.window, own
        raise QueryError("a range vector is needed")

    def over_time(self, name: str, node, grid: Grid, extra: list) -> DataFrame:
        rows, window, own = self._window_rows(node, grid)
        if isinstance(node, Selector) and name in ("rate", "increase", "irate"):
            named = [v for k, op, v in node.matchers if k == NAME and op == "="]
            if named and not named[0].endswith(_COUNTERS):
                self.say("info", f'metric might not be a counter, name does not end in _total/_sum/_count/_bucket: "{named[0]}"')
        if name == "quantile_over_time":
            self._quantile_doubt(extra[0])
        hourly = self._from_hours(name, node, own, window)
        if hourly is not None:
            out = hourly
        elif native.has_native(rows):
            seen = own.windows(rows, window).groupBy("key", "step").agg(F.count("h").alias("nh"), F.count("*").alias("n")).filter("nh > 0 and nh < n")
            if name in native.SUMMING:
                self.doubt(seen, F.concat(F.lit('encountered a mix of histograms and floats for metric name "'), value_of(labels_of(F.col("key")), NAME), F.lit('"')))
            out = native.windows(name, rows, window, own, lambda r: self._over_rows(name, r, window, own, extra, grid))
        else:
            out = self._over_rows(name, rows, window, own, extra, grid)
        if name not in _KEEP_NAME:
            out = out.withColumn("labels", drop(F.col("labels"), [NAME]))
        return self._spread(rekeyed(out), node, grid)

    def _from_hours(self, name: str, node, own: Grid, window: int) -> DataFrame | None:
        """The function over the hour rollup, where there is one and all windows begin and end on hours."""
        from ..operators import rollups

        if self.hours is None or not isinstance(node, Selector) or name not in rollups.HOURLY or node.offset % rollups.HOUR or not rollups.eligible(own, window, rollups.HOUR):
            return None
        rows = self.hours
        for label, op, value in node.matchers:
            rows = rows.filter(selects(F.col("labels"), label, op, value))
        return rollups.hours_over_time(rows.withColumn("hour", F.col("hour") + node.offset), name, own, window)

    def _over_rows(self, name: str, rows: DataFrame, window: int, own: Grid, extra: list, grid: Grid) -> DataFrame:
        if name in _EXTRAPOLATED or name in _PAIRS:
            near = rows.filter((F.col("ts") > own.start - window) & (F.col("ts") <= own.end))
            rows = with_before(near.select("key", "ts", "value"), ["ts"], own.start - window, own.end)
        grouped = own.windows(rows, window).groupBy("key", "step")
        labels = labels_of(F.col("key")).alias("labels")
        if name in SIMPLE:
            out = grouped.agg(labels, SIMPLE[name]().alias("value"))
        elif name in _EXTRAPOLATED:
            out = self._extrapolated(name, grouped, window)
        elif name in _LAST_TWO:
            out = grouped.agg(labels, _points(2).alias("p")).filter(F.size("p") == 2)
            a, b = F.col("p")[0], F.col("p")[1]
            gained = F.when(ieee.compare("<", b["value"], a["value"]), b["value"]).otherwise(b["value"] - a["value"])
            out = out.withColumn("value", gained / _seconds(b["ts"] - a["ts"]) if name == "irate" else b["value"] - a["value"]).drop("p")
        elif name in _PAIRS:
            inside = F.col("before_ts") > F.col("step") - window
            hit = ieee.compare("<", _v(), F.col("before")) if name == "resets" else ieee.compare("!=", _v(), F.col("before")) & ~(F.isnan(_v()) & F.isnan("before"))
            out = grouped.agg(labels, F.sum(F.when(inside & hit, 1.0).otherwise(0.0)).alias("value"))
        elif name in _FITS:
            out = self._fitted(name, grouped, extra, grid)
        elif name == "quantile_over_time":
            out = grouped.agg(labels, F.array_sort(F.collect_list(_v())).alias("a"))
            out = self._with_scalar(out, extra[0], "q").withColumn("value", ieee.interpolated(F.col("q"), F.col("a"))).drop("a", "q")
        elif name == "mad_over_time":
            out = grouped.agg(labels, F.collect_list(_v()).alias("a"))
            out = out.withColumn("m", _median(F.col("a"))).withColumn("value", _median(F.transform("a", lambda x: F.abs(x - F.col("m"))))).drop("a", "m")
        else:
            out = self._smoothed(grouped, extra)
        return out

    def _extrapolated(self, name: str, grouped, window: int) -> DataFrame:
        """The counter's gain, stretched to the window's ends unless they are far from the samples."""
        a = F.struct("value", "lost")
        out = grouped.agg(labels_of(F.col("key")).alias("labels"), F.min_by(a, F.col("ts")).alias("a"), F.max_by(a, F.col("ts")).alias("b"), F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"))
        out = out.filter((F.col("n") > 1) & (F.col("t1") > F.col("t0")))
        counter = name != "delta"
        gain = F.col("b.value") - F.col("a.value") + ((F.col("b.lost") - F.col("a.lost")) if counter else F.lit(0.0))
        span = _seconds(F.col("t1") - F.col("t0"))
        gap = span / (F.col("n") - 1)
        left, right = _seconds(F.col("t0") - (F.col("step") - window)), _seconds(F.col("step") - F.col("t1"))
        left, right = (F.when(x >= gap * 1.1, gap / 2).otherwise(x) for x in (left, right))
        if counter:  # a counter cannot have been below zero
            left = F.when((gain > 0) & (F.col("a.value") >= 0), F.least(left, span * F.col("a.value") / F.when(gain > 0, gain).otherwise(F.lit(1.0)))).otherwise(left)
        value = gain * ((span + left + right) / span)
        return out.select("labels", "key", "step", (value / (window / 1e9) if name == "rate" else value).alias("value"))

    def _fitted(self, name: str, grouped, extra: list, grid: Grid) -> DataFrame:
        x, y = _seconds(F.col("ts") - F.col("step")), _v()
        out = grouped.agg(labels_of(F.col("key")).alias("labels"), F.regr_slope(y, x).alias("m"), F.avg(x).alias("ax"), F.avg(y).alias("ay"), F.count("*").alias("n"), F.min(y).alias("y0"), F.max(y).alias("y1")).filter("n > 1")
        slope = F.when(F.col("y0") == F.col("y1"), F.lit(0.0)).otherwise(F.col("m"))
        if name == "deriv":
            return out.select("labels", "key", "step", slope.alias("value"))
        out = self._with_scalar(out, extra[0], "ahead")
        at_step = F.when(F.col("y0") == F.col("y1"), F.col("y0")).otherwise(F.col("ay") - slope * F.col("ax"))
        return out.select("labels", "key", "step", (at_step + slope * F.col("ahead")).alias("value"))

    def _smoothed(self, grouped, extra: list) -> DataFrame:
        out = grouped.agg(labels_of(F.col("key")).alias("labels"), _sorted_values().alias("a")).filter(F.size("a") > 1)
        out = self._with_scalar(self._with_scalar(out, extra[0], "sf"), extra[1], "tf")
        wrong = (F.col("sf") <= 0) | (F.col("sf") >= 1) | (F.col("tf") <= 0) | (F.col("tf") >= 1)
        out = out.withColumn("sf", F.when(wrong, F.raise_error(F.lit("smoothing factors lie between 0 and 1")).cast("double")).otherwise(F.col("sf")))

        first, second = F.col("a")[0], F.col("a")[1]

        def step(s: Column, x: Column) -> Column:
            """The trend of a step comes from the level before it; on the first it is the first difference."""
            trend = F.when(s["i"] == 0, second - first).otherwise(F.col("tf") * (s["level"] - s["last"]) + (1 - F.col("tf")) * s["trend"])
            return F.struct((s["i"] + 1).alias("i"), s["level"].alias("last"), (F.col("sf") * x + (1 - F.col("sf")) * (s["level"] + trend)).alias("level"), trend.alias("trend"))

        start = F.struct(F.lit(0).alias("i"), F.lit(0.0).alias("last"), first.alias("level"), F.lit(0.0).alias("trend"))
        return out.select("labels", "key", "step", F.aggregate(F.slice("a", 2, F.size("a") - 1), start, step)["level"].alias("value"))

    # -- scalars

    def _vector(self, s: Scalar, grid: Grid) -> DataFrame:
        frame = s.frame or grid.frame(self.spark).withColumn("value", s.column.cast("double"))
        return frame.select(no_labels().alias("labels"), F.lit("").alias("key"), "step", "value")

    def _with_scalar(self, df: DataFrame, s: Scalar, name: str) -> DataFrame:
        if not isinstance(s, Scalar):
            raise QueryError("a scalar is needed")
        if s.frame is None:
            return df.withColumn(name, s.column.cast("double"))
        return df.join(s.frame.withColumnRenamed("value", name), "step", "left").withColumn(name, F.coalesce(F.col(name), ieee.nan()))

    def _map_scalar(self, s: Scalar, f: Callable[[Column], Column]) -> Scalar:
        return Scalar(f(s.column)) if s.frame is None else Scalar(frame=s.frame.withColumn("value", f(_v())))

    def _mapped(self, vector: DataFrame, value: Column, keep_name: bool = False) -> DataFrame:
        vector = native.floats(vector)
        labels = F.col("labels") if keep_name else drop(F.col("labels"), [NAME])
        return rekeyed(vector.select(labels.alias("labels"), "step", value.alias("value")))

    # -- calls

    def call(self, node: Call, grid: Grid):
        name, args = node.name, node.args
        if name in RANGE_FUNCTIONS:
            first = {"quantile_over_time": 1}.get(name, 0)
            extra = [self.eval(a, grid) for i, a in enumerate(args) if i != first]
            return self.over_time(name, args[first], grid, extra)
        if name in ("time", "pi", "start", "end", "step", "range"):
            constant = {"pi": 3.141592653589793, "start": self.grid.start / 1e9, "end": self.grid.end / 1e9, "step": self.grid.step / 1e9, "range": (self.grid.end - self.grid.start) / 1e9}
            return Scalar(_seconds(F.col("step"))) if name == "time" else Scalar(constant=constant[name])
        if name in ("min_of", "max_of"):
            a, b = (self.eval(x, grid) for x in args)
            if a.frame is not None or b.frame is not None:
                raise QueryError(f"{name} takes constants")
            return Scalar((F.least if name == "min_of" else F.greatest)(a.column.cast("double"), b.column.cast("double")))
        if name == "absent_over_time":
            rows, window, own = self._window_rows(args[0], grid)
            return self._absent(own.windows(rows, window), args[0], grid)
        if name == "timestamp" and isinstance(args[0], Selector):
            return self._mapped(self.instant(args[0], grid, with_time=True), _v())
        if name == "vector":
            return self._vector(self.eval(args[0], grid), grid)
        if name in CALENDAR:
            given = self._vector(Scalar(_seconds(F.col("step"))), grid) if not args else self.eval(args[0], grid)
            return self._mapped(given, CALENDAR[name](_v()).cast("double"))
        if not args:
            raise QueryError(f"unknown function {name}")
        if name in ("label_replace", "label_join"):
            return self._relabelled(name, self.eval(args[0], grid), [a.value for a in args[1:]])
        if name in ("histogram_quantile", "histogram_quantiles", "histogram_fraction"):
            from .histograms import histogram_call

            return histogram_call(self, name, args, grid)
        inner = self.eval(args[0], grid)
        if name in native.PROPERTIES:
            if not native.has_native(inner):
                return self._mapped(inner, _v()).filter(F.lit(False))
            read = native.histograms(inner).withColumn("value", native.PROPERTIES[name](F.col("h"))).drop("h")
            return self._mapped(read, _v())
        if name == "scalar":
            inner = native.floats(inner)
            one = inner.groupBy("step").agg(F.count("*").alias("n"), F.first("value").alias("v"))
            steps = grid.frame(self.spark).join(one, "step", "left")
            return Scalar(frame=steps.select("step", F.when(F.col("n") == 1, F.col("v")).otherwise(ieee.nan()).alias("value")))
        if isinstance(inner, Scalar):
            raise QueryError(f"{name} takes a vector")
        if name == "absent":
            return self._absent(inner, args[0], grid)
        if name == "timestamp":
            return self._mapped(inner.drop("h"), _seconds(F.col("step")))
        if name in ("sort", "sort_desc", "sort_by_label", "sort_by_label_desc") and grid.count > 1:
            self.say("warning", "sort is ineffective for range queries since results are always ordered by labels")
        if not name.startswith("sort_by_label"):
            inner = native.floats(inner)
        if name in MATH:
            return self._mapped(inner, MATH[name](_v()))
        extra = [self.eval(a, grid) for a in args[1:] if not isinstance(a, Text)]
        if name == "round":
            inner = self._with_scalar(inner, extra[0] if extra else Scalar(constant=1.0), "n")
            inverse = ieee.div(F.lit(1.0), F.col("n"))
            return self._mapped(inner, _whole(F.floor, _v() * inverse + 0.5) / inverse)
        if name in ("clamp", "clamp_min", "clamp_max"):
            low = extra[0] if name != "clamp_max" else Scalar(constant=float("-inf"))
            high = extra[-1] if name != "clamp_min" else Scalar(constant=float("inf"))
            inner = self._with_scalar(self._with_scalar(inner, low, "low"), high, "high").filter(~(F.col("low") > F.col("high")) | F.isnan("low") | F.isnan("high"))
            bad = F.isnan(_v()) | F.isnan("low") | F.isnan("high")
            return self._mapped(inner, F.when(bad, ieee.nan()).otherwise(F.greatest(F.col("low"), F.least(F.col("high"), _v()))))
        if name in ("sort", "sort_desc"):
            return inner.orderBy(F.isnan(_v()), _v().asc() if name == "sort" else _v().desc(), "key")
        if name in ("sort_by_label", "sort_by_label_desc"):
            names = [a.value for a in args[1:]]
            # Natural order: runs of digits compare as numbers, here as zero-filled text.
            columns = [F.regexp_replace(F.regexp_replace(value_of(F.col("labels"), n), r"(\d+)", "00000000000000000000$1"), r"0*(\d{20})(?!\d)", "$1") for n in names] + [F.col("key")]
            return inner.orderBy(*[c.desc() if name.endswith("desc") else c.asc() for c in columns])
        raise QueryError(f"unknown function {name}")

    def _absent(self, present: DataFrame, node, grid: Grid) -> DataFrame:
        labels = no_labels()
        if isinstance(node, Selector):
            seen = [k for k, _, _ in node.matchers]
            equal = {k: v for k, op, v in node.matchers if op == "=" and k != NAME and seen.count(k) == 1}
            if equal:
                labels = F.create_map(*[F.lit(x) for kv in equal.items() for x in kv])
        missing = grid.frame(self.spark).join(present.select("step").distinct(), "step", "left_anti")
        return rekeyed(missing.select(labels.alias("labels"), "step", F.lit(1.0).alias("value")))

    def _relabelled(self, name: str, vector: DataFrame, texts: list[str]) -> DataFrame:
        labels = F.col("labels")
        if name == "label_join":
            target, between, *sources = texts
            new = put(labels, target, F.concat_ws(between, *[value_of(labels, s) for s in sources]))
        else:
            target, replacement, source, pattern = texts
            import re

            whole = f"(?s)\\A(?:{java_regex(pattern)})\\z"
            with_groups = re.sub(r"\$\{(\w+)\}", lambda m: f"${m[1]}" if m[1].isdigit() else m[0], replacement.replace("$$", "\\$"))
            given = value_of(labels, source)
            new = F.when(given.rlike(whole), put(labels, target, F.regexp_replace(given, whole, with_groups))).otherwise(labels)
        return self._unique(rekeyed(vector.select(new.alias("labels"), "step", *[c for c in vector.columns if c in ("value", "h")])))

    def _unique(self, vector: DataFrame) -> DataFrame:
        """Series that now have the same labels merge where they have no step in common, else the query fails."""
        merged = vector.groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), F.first("value").alias("v"), F.count("*").alias("n"), *([F.first("h").alias("h")] if native.has_native(vector) else []))
        value = F.when(F.col("n") > 1, F.raise_error(F.lit("several series have the same labels")).cast("double")).otherwise(F.col("v"))
        return merged.select("labels", "key", "step", value.alias("value"), *(["h"] if native.has_native(vector) else []))

    # -- aggregation

    @staticmethod
    def group_labels(node: Aggregate) -> Column:
        return drop(F.col("labels"), [*node.names, NAME]) if node.without else keep(F.col("labels"), list(node.names))

    def aggregate(self, node: Aggregate, grid: Grid) -> DataFrame:
        inner = self.eval(node.inner, grid)
        if isinstance(inner, Scalar):
            raise QueryError(f"{node.op} takes a vector")
        group = self.group_labels(node)
        if node.op in ("topk", "bottomk", "limitk", "limit_ratio"):
            k = self.eval(node.param, grid)
            if node.op == "limit_ratio" and isinstance(k, Scalar) and k.constant is not None and abs(k.constant) > 1:
                self.say("warning", f"ratio value should be between -1 and 1, got {k.constant:g}, capping to {max(-1.0, min(1.0, k.constant)):g}")
            if node.op in ("topk", "bottomk") and native.has_native(inner):
                inner = native.floats(inner)
                self.say("info", f"ignored histogram in {node.op} aggregation")
            rows = self._with_scalar(inner, k, "k").withColumn("group", key_of(group))
            if node.op in ("limitk", "limit_ratio"):
                rows = rows.withColumn("hash", label_hash(F.col("labels")))
            if node.op == "limit_ratio":
                share = F.conv("hash", 16, 10).cast("double") / float(1 << 64)
                kept = rows.filter(F.when(F.col("k") >= 0, share < F.col("k")).otherwise(share >= 1 + F.col("k")))
            else:
                order = {"topk": [F.isnan(_v()), _v().desc(), "key"], "bottomk": [F.isnan(_v()), _v().asc(), "key"], "limitk": ["hash", "key"]}[node.op]
                kept = rows.withColumn("rank", F.row_number().over(Window.partitionBy("step", "group").orderBy(*order))).filter(F.col("rank") <= F.floor("k"))
            return kept.select("labels", "key", "step", *[c for c in kept.columns if c in ("value", "h")])
        if native.has_native(inner):
            if node.op in ("sum", "avg"):
                rows = rekeyed(inner.select("step", group.alias("labels"), "value", "h"))
                mixed = rows.groupBy("key", "step").agg(F.count("h").alias("nh"), F.count("*").alias("n")).filter("nh > 0 and nh < n")
                self.doubt(mixed, F.lit("encountered a mix of histograms and floats for aggregation"))
                return native.aggregated(node.op, rows, self._aggregated(node, native.floats(inner), group, grid))
            if node.op in ("count", "group"):
                inner = inner.withColumn("value", F.coalesce("value", F.lit(0.0))).drop("h")
            else:
                inner = native.floats(inner)
                self.say("info", f"ignored histogram in {node.op} aggregation")
        return self._aggregated(node, inner, group, grid)

    def _aggregated(self, node: Aggregate, inner: DataFrame, group: Column, grid: Grid) -> DataFrame:
        rows = inner.select("step", group.alias("labels"), "value")
        if node.op == "count_values":
            rows = rows.withColumn("labels", put(F.col("labels"), node.param.value, format_value(_v()))).withColumn("value", F.lit(1.0))
            node = replace(node, op="sum")
        rows = rekeyed(rows).groupBy("key", "step")
        labels = labels_of(F.col("key")).alias("labels")
        if node.op == "quantile":
            q = self.eval(node.param, grid)
            self._quantile_doubt(q)
            out = self._with_scalar(rows.agg(labels, F.array_sort(F.collect_list(_v())).alias("a")), q, "q")
            return out.select("labels", "key", "step", ieee.interpolated(F.col("q"), F.col("a")).alias("value"))
        simple = {"sum": ieee.sum_of(_v()), "avg": ieee.mean_of(_v()), "min": ieee.least_of(_v()), "max": ieee.most_of(_v()), "count": F.count(_v()).cast("double"), "group": F.max(F.lit(1.0)), "stddev": F.stddev_pop(_v()), "stdvar": F.var_pop(_v())}
        return rows.agg(labels, simple[node.op].alias("value")).select("labels", "key", "step", "value")

    # -- operators

    def binary(self, node: Binary, grid: Grid):
        left, right = self.eval(node.left, grid), self.eval(node.right, grid)
        op, compares = node.op, node.op in _COMPARE
        if isinstance(left, Scalar) and isinstance(right, Scalar):
            if op in _SETS or op in TRIMS or compares and not node.is_bool:
                raise QueryError(f"{op} between scalars")
            if left.frame is None and right.frame is None:
                out = self.arithmetic(op, left.column.cast("double"), right.column.cast("double"))
                return Scalar(out.cast("double"))
            rows = self._with_scalar(self._with_scalar(grid.frame(self.spark), left, "l"), right, "r")
            return Scalar(frame=rows.select("step", self.arithmetic(op, F.col("l"), F.col("r")).cast("double").alias("value")))
        if isinstance(left, Scalar) or isinstance(right, Scalar):
            if op in _SETS:
                raise QueryError(f"{op} needs vectors")
            vector, scalar = (right, left) if isinstance(left, Scalar) else (left, right)
            rows = self._with_scalar(vector, scalar, "s")
            a, b = (F.col("s"), _v()) if vector is right else (_v(), F.col("s"))
            if native.has_native(rows):
                none = F.lit(None).cast(native.nh.TYPE)
                x, y = ((F.col("s"), none), (_v(), F.col("h"))) if vector is right else ((_v(), F.col("h")), (F.col("s"), none))
                hit, value, h = native.paired(op, x, y, node.is_bool)
                found = native.histograms(rows).filter(hit).select((F.col("labels") if op in TRIMS else drop(F.col("labels"), [NAME])).alias("labels"), "step", value.alias("value"), h.alias("h"))
                rest = native.floats(vector)
                numbers = rest.limit(0) if op in TRIMS else self._scalar_pairs(node, native.floats(rows), a, b)
                return native.both(numbers, rekeyed(found))
            if op in TRIMS:
                return rows.filter(F.lit(False)).select("labels", "key", "step", "value")
            return self._scalar_pairs(node, rows, a, b)
        return self._matched(node, left, right)

    def _scalar_pairs(self, node: Binary, rows: DataFrame, a: Column, b: Column) -> DataFrame:
        value = self.arithmetic(node.op, a, b)
        if node.op in _COMPARE and not node.is_bool:
            return rows.filter(value).select("labels", "key", "step", "value")
        return self._mapped(rows, value.cast("double"))

    def _matched(self, node: Binary, left: DataFrame, right: DataFrame) -> DataFrame:
        m, op = node.matching, node.op
        signature = key_of(keep(F.col("labels"), list(m.names)) if m.on else drop(F.col("labels"), [*m.names, NAME]))
        left, right = left.withColumn("sig", signature), right.withColumn("sig", signature)
        if op in _SETS:
            other = right.select("step", "sig").distinct()
            if op == "or":
                extra = right.join(left.select("step", "sig").distinct(), ["step", "sig"], "left_anti")
                return left.drop("sig").unionByName(extra.drop("sig"), allowMissingColumns=True)
            return left.join(other, ["step", "sig"], "left_semi" if op == "and" else "left_anti").drop("sig")
        swapped = m.side == "right"
        many, one = (right, left) if swapped else (left, right)
        with_h = native.has_native(left) or native.has_native(right)
        if with_h:
            many, one = (x if native.has_native(x) else x.withColumn("h", F.lit(None).cast(native.nh.TYPE)) for x in (many, one))
        elif op in TRIMS:
            return left.filter(F.lit(False)).select("labels", "key", "step", "value")
        # The one side must be unique for each signature and step; so must the other without grouping.
        lone = one.groupBy("step", "sig").agg(F.first("labels").alias("ol"), F.first("value").alias("ov"), F.count("*").alias("n"), *([F.first("h").alias("oh")] if with_h else []))
        lone = lone.withColumn("ov", F.when(F.col("n") > 1, F.raise_error(F.lit("many-to-many matching: labels must be unique on one side")).cast("double")).otherwise(F.col("ov"))).drop("n")
        rows = many.join(lone, ["step", "sig"])
        a, b = (F.col("ov"), _v()) if swapped else (_v(), F.col("ov"))
        value = F.lit(None).cast("double") if op in TRIMS else self.arithmetic(op, a, b)
        compares = op in _COMPARE and not node.is_bool
        keeps, h = (value if compares else F.lit(True)), []
        value = a if compares else value.cast("double")
        if with_h:
            x, y = ((F.col("ov"), F.col("oh")), (_v(), F.col("h"))) if swapped else ((_v(), F.col("h")), (F.col("ov"), F.col("oh")))
            either = F.col("h").isNotNull() | F.col("oh").isNotNull()
            hit, number, total = native.paired(op, x, y, node.is_bool)
            keeps = F.when(either, hit).otherwise(F.lit(False) if op in TRIMS else keeps)
            value, h = F.when(either, number).otherwise(value), [F.when(either, total).alias("h")]
        rows = rows.filter(keeps)
        labels = F.col("labels") if compares or op in TRIMS else drop(F.col("labels"), [NAME])
        if not m.side:
            labels = keep(labels, list(m.names)) if m.on else drop(labels, list(m.names)) if m.names else labels
        for name in m.include:
            labels = put(labels, name, value_of(F.col("ol"), name))
        return self._unique(rekeyed(rows.select(labels.alias("labels"), "step", value.alias("value"), *h)))


def format_value(v: Column) -> Column:
    """A number as a label value: whole ones without a fraction."""
    whole = (v == F.floor(F.when(F.isnan(v) | (F.abs(v) >= 1e15), F.lit(0.0)).otherwise(v))) & (F.abs(v) < 1e15)
    return F.when(F.isnan(v), "NaN").when(v == _H, "+Inf").when(v == -_H, "-Inf").when(whole, v.cast("long").cast("string")).otherwise(v.cast("string"))
