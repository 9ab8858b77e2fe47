"""The engine: three tables and three query languages."""

from __future__ import annotations

from pyspark.sql import DataFrame

from .plans.grid import Grid
from .plans.logql import LogPlanner
from .plans.promql import LOOKBACK, MetricPlanner
from .plans.promql_parser import format_query
from .plans.promql_parser import parse as parse_metric_query
from .plans.traceql import TracePlanner, metric_window, parse


class Engine:
    """minutes and hours are rollups of logs and samples; queries whose windows fall on them read those instead of the raw rows."""

    def __init__(self, samples: DataFrame | None = None, logs: DataFrame | None = None, spans: DataFrame | None = None, minutes: DataFrame | None = None, hours: DataFrame | None = None):
        self.samples, self.logs, self.spans, self.minutes, self.hours = samples, logs, spans, minutes, hours

    def _metrics(self, start: int, end: int, step: int, lookback: int) -> MetricPlanner:
        planner = MetricPlanner(self.samples, Grid(start, end, step), lookback)
        planner.hours = self.hours
        return planner

    def metric_query(self, query: str, start: int, end: int, step: int, lookback: int = LOOKBACK) -> DataFrame:
        """labels, step, value at start, start + step, ... end (ns)."""
        return self._metrics(start, end, step, lookback).run(query)

    def metric_query_annotated(self, query: str, start: int, end: int, step: int, lookback: int = LOOKBACK) -> tuple[DataFrame, DataFrame]:
        """The result, and its annotations (kind, message) as a second frame."""
        planner = self._metrics(start, end, step, lookback)
        return planner.run(query), planner.annotations()

    def log_query(self, query: str, start: int, end: int, step: int = 10**9, limit: int = 100, backward: bool = True) -> DataFrame:
        return LogPlanner(self.logs, Grid(start, end, step), self.minutes).run(query, limit, backward)

    def trace_search(self, query: str, start: int, end: int, limit: int = 20, spss: int = 3) -> DataFrame:
        return TracePlanner(self.spans).search(query, start, end, limit, spss)

    def trace_spans(self, query: str) -> DataFrame:
        return TracePlanner(self.spans).select(parse(query))

    def trace_metrics(self, query: str, start: int, end: int, step: int | None = None) -> DataFrame:
        """On the window aligned to the step; without one, about 240 points."""
        return TracePlanner(self.spans).metrics(query, metric_window(start, end, step))

    @staticmethod
    def format(query: str) -> str:
        return format_query(parse_metric_query(query))
