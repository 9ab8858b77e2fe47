"""Rules: recording, thresholds with a lifecycle, and expression graphs."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions.labels import NAME, drop, labels_of, put, rekeyed
from ..plans.grid import Grid
from ..plans.promql import MetricPlanner
from ..plans.promql_parser import QueryError, Stream, tokens_of


@dataclass(frozen=True)
class Threshold:
    """Fires once the comparison has held for `hold`, and stays for `keep` after it last did (ns)."""

    op: str
    limit: float
    hold: int = 0
    keep: int = 0
    no_data: str = "ok"  # ok, keep or alerting: what a tick without a value is


@dataclass
class State:
    name: str = "inactive"
    since: int = 0  # of pending
    seen: int = 0  # when the comparison last held
    fields: dict = field(default_factory=dict)


def advance(rule: Threshold, state: State, ts: int, value: float | None) -> State:
    """inactive -> pending -> firing -> recovering -> resolved; the same for batch and stream."""
    if value is None or value != value:
        if rule.no_data == "keep":
            return state
        breach = rule.no_data == "alerting"
    else:
        breach = {"gt": value > rule.limit, "lt": value < rule.limit, "eq": value == rule.limit, "ne": value != rule.limit, "gte": value >= rule.limit, "lte": value <= rule.limit}[rule.op]
    if breach:
        if state.name in ("inactive", "resolved"):
            return State("firing" if rule.hold <= 0 else "pending", ts, ts)
        if state.name == "pending":
            return State("firing" if ts - state.since >= rule.hold else "pending", state.since, ts)
        return State("firing", state.since, ts)
    if state.name in ("firing", "recovering"):
        return State("recovering" if ts - state.seen < rule.keep else "resolved", state.since, state.seen)
    return State("inactive", 0, 0)


def lifecycle(ticks: DataFrame, rule: Threshold) -> DataFrame:
    """key, ts, value, state: ticks (key, ts, value) of each series folded in order, a batch at a time with one state held."""

    def fold(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, State()
        for batch in batches:
            names = []
            for k, ts, v in zip(batch["key"], batch["ts"], batch["value"], strict=True):
                if k != key:
                    key, state = k, State()
                state = advance(rule, state, int(ts), None if pd.isna(v) else float(v))
                names.append(state.name)
            yield batch.assign(state=names)

    rows = ticks.select("key", "ts", "value").repartition("key").sortWithinPartitions("key", "ts")
    return rows.mapInPandas(fold, "key string, ts long, value double, state string")


def transitions(states: DataFrame) -> DataFrame:
    from pyspark.sql import Window

    before = F.lag("state", 1, "inactive").over(Window.partitionBy("key").orderBy("ts"))
    return states.withColumn("before", before).filter("state <> before")


def record(samples: DataFrame, name: str, query: str, at: int, labels: dict[str, str] | None = None, previous: DataFrame | None = None) -> DataFrame:
    """The query's result at a time as samples of a new metric; series of the previous result that are gone get a stale marker."""
    out = MetricPlanner(samples, Grid(at, at, 10**9)).run(query)
    bag = put(drop(F.col("labels"), [NAME]), NAME, F.lit(name))
    for k, v in (labels or {}).items():
        bag = put(bag, k, F.lit(v))
    now = rekeyed(out.select(bag.alias("labels"), F.lit(at).cast("long").alias("ts"), "value", F.lit(False).alias("stale")))
    if previous is None:
        return now
    gone = previous.filter("not stale").join(now.select("key"), "key", "left_anti").select("labels", F.lit(at).cast("long").alias("ts"), F.lit(float("nan")).alias("value"), F.lit(True).alias("stale"), "key")
    return now.unionByName(gone)


def record_group(samples: DataFrame, rules: list[tuple], at: int) -> DataFrame:
    """Rules (name, query) or (name, query, labels) in order, each of which sees what the earlier ones of the same time recorded."""
    if len({(r[0], *sorted((r[2] if len(r) > 2 else {}).items())) for r in rules}) != len(rules) or not 1 <= len(rules) <= 64:
        raise ValueError("1 to 64 rules with names of their own")
    seen, out = samples, None
    for name, query, *labels in rules:
        new = record(seen, name, query, at, labels[0] if labels else None)
        seen = seen.select(*new.columns).unionByName(new)
        out = new if out is None else out.unionByName(new)
    return out


# -- expression graphs

_MATH_LEVEL = {"||": 1, "&&": 2, "==": 3, "!=": 3, ">": 4, ">=": 4, "<": 4, "<=": 4, "+": 5, "-": 5, "*": 6, "/": 6, "%": 6, "**": 7}


def _math_tokens(text: str):
    import re

    pattern = re.compile(r"\s+|(?P<var>\$\{\w+\}|\$\w+)|(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?)|(?P<op>\|\||&&|==|!=|>=|<=|\*\*|[-+*/%<>!()])")
    return tokens_of(text, pattern)


class _Math(Stream):
    def parse(self, level: int = 1):
        if op := self.accept("-", "!"):
            left = (op, self.parse(7))
        elif self.accept("("):
            left = self.parse()
            self.expect(")")
        elif self.kind == "number":
            left = float(self.take())
        elif self.kind == "var":
            left = self.take().strip("${}")
        else:
            raise QueryError(f"unexpected {self.text!r}")
        while self.text in _MATH_LEVEL and _MATH_LEVEL[self.text] >= level:
            op = self.take()
            left = (op, left, self.parse(_MATH_LEVEL[op] + (op != "**")))
        return left


def _names(node) -> set[str]:
    return {node} if isinstance(node, str) else set() if isinstance(node, float) else set().union(*[_names(x) for x in node[1:]])


def math(text: str, inputs: dict[str, DataFrame]) -> DataFrame:
    """labels, key, value of an expression over named inputs (labels, key, value), joined where labels are equal or one side has none."""
    p = _Math(_math_tokens(text))
    node = p.parse()
    if p.kind != "end":
        raise QueryError(f"unexpected {p.text!r}")
    names = sorted(_names(node))
    if not names:
        raise QueryError("an expression needs an input")
    rows = None
    for n in names:
        side = inputs[n].select(F.col("labels").alias(f"l_{n}"), F.col("key").alias(f"k_{n}"), F.col("value").alias(f"v_{n}"))
        if rows is None:
            rows = side.withColumn("labels", F.col(f"l_{n}")).withColumn("key", F.col(f"k_{n}")).drop(f"l_{n}", f"k_{n}")
            continue
        # Equal label sets meet by an equi join; a side with the empty set, one row, goes with all of the other.
        equal = rows.join(side, F.col("key") == F.col(f"k_{n}"))
        lone_right = rows.filter("key <> ''").join(F.broadcast(side.filter(F.col(f"k_{n}") == "").limit(1)))
        lone_left = side.filter(F.col(f"k_{n}") != "").join(F.broadcast(rows.filter("key = ''").limit(1)))
        left_cols = [c for c in rows.columns if c not in ("labels", "key")]
        keep_left = ["labels", "key", *left_cols, f"v_{n}"]
        rows = equal.select(*keep_left).unionByName(lone_right.select(*keep_left)).unionByName(lone_left.select(F.col(f"l_{n}").alias("labels"), F.col(f"k_{n}").alias("key"), *left_cols, f"v_{n}"))
    return rows.select("labels", "key", _math_column(node).cast("double").alias("value"))


def _math_column(node) -> Column:
    if isinstance(node, float):
        return F.lit(node)
    if isinstance(node, str):
        return F.col(f"v_{node}")
    if len(node) == 2:
        v = _math_column(node[1])
        return -v if node[0] == "-" else F.when(v == 0, 1.0).otherwise(0.0)
    op, a, b = node[0], _math_column(node[1]), _math_column(node[2])
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    made: dict[str, Callable[[], Column]] = {
        "||": lambda: flag((a != 0) | (b != 0)), "&&": lambda: flag((a != 0) & (b != 0)), "+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: ieee.div(a, b), "%": lambda: ieee.mod(a, b), "**": lambda: ieee.power(a, b),
    }
    return made[op]() if op in made else flag(ieee.compare(op, a, b))


def reduce_last(vector: DataFrame) -> DataFrame:
    """labels, key, value: the newest value of each series."""
    return rekeyed(vector.select("labels", "step", "value")).groupBy("key").agg(labels_of(F.col("key")).alias("labels"), F.max_by("value", "step").alias("value")).select("labels", "key", "value")


def threshold(frame: DataFrame, op: str, limit: float) -> DataFrame:
    test = {"gt": ">", "lt": "<", "eq": "==", "ne": "!=", "gte": ">=", "lte": "<="}[op]
    return frame.withColumn("value", F.when(F.isnan("value"), F.col("value")).when(ieee.compare(test, F.col("value"), F.lit(limit)), 1.0).otherwise(0.0))


def evaluate_graph(nodes: dict[str, dict], sources: Callable[[str, str], DataFrame]) -> dict[str, DataFrame]:
    """Nodes by name: {kind: source, language, query} | {kind: reduce, of} | {kind: math, expression} | {kind: threshold, of, op, limit}."""
    done: dict[str, DataFrame] = {}

    def build(name: str, path: tuple[str, ...] = ()) -> DataFrame:
        if name in path:
            raise ValueError(f"cycle through {name}")
        if name not in done:
            n = nodes[name]
            if n["kind"] == "source":
                done[name] = sources(n["language"], n["query"])
            elif n["kind"] == "reduce":
                done[name] = reduce_last(build(n["of"], (*path, name)))
            elif n["kind"] == "threshold":
                done[name] = threshold(build(n["of"], (*path, name)), n["op"], n["limit"])
            else:
                used = _names(_Math(_math_tokens(n["expression"])).parse())
                done[name] = math(n["expression"], {u: build(u, (*path, name)) for u in sorted(used)})
        return done[name]

    return {name: build(name) for name in nodes}
