"""Quantiles and fractions of classic histograms: cumulative counts by upper bound `le`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ieee
from ..functions import native_histogram as nh
from ..functions.labels import NAME, drop, labels_of, put, rekeyed, value_of
from . import native
from .promql_parser import QueryError, Text


def buckets_of(vector: DataFrame) -> DataFrame:
    """labels, key, step, b: buckets (le, count) by rising le, equal bounds added up, counts made to rise."""
    bound = value_of(F.col("labels"), "le")
    le = F.when(bound.isin("+Inf", "Inf", "inf", "+inf"), F.lit(float("inf"))).otherwise(bound.try_cast("double"))
    # The generator keeps the filter above the vector: below its aggregate, labels would be read from the key of each sample.
    rows = rekeyed(vector.select(drop(F.col("labels"), [NAME, "le"]).alias("labels"), "step", F.explode(F.array(le)).alias("le"), "value").filter("le is not null"))
    rows = rows.groupBy("key", "step", "le").agg(labels_of(F.col("key")).alias("labels"), F.sum("value").alias("value"))
    lists = rows.groupBy("key", "step").agg(labels_of(F.col("key")).alias("labels"), F.array_sort(F.collect_list(F.struct("le", "value"))).alias("b"))

    def rise(s: Column, x: Column) -> Column:
        n = F.greatest(s["n"], x["value"])
        return F.struct(F.concat(s["a"], F.array(F.struct(x["le"].alias("le"), n.alias("n")))).alias("a"), n.alias("n"))

    start = F.struct(F.array().cast("array<struct<le:double,n:double>>").alias("a"), F.lit(0.0).alias("n"))
    return lists.withColumn("b", F.aggregate("b", start, rise)["a"])


def quantile(q: Column, b: Column) -> Column:
    size = F.size(b)
    total = F.element_at(b, -1)["n"]
    rank = q * total
    at = F.size(F.filter(F.slice(b, 1, size - 1), lambda x: x["n"] < rank))  # the first bucket that reaches the rank
    here, before = F.get(b, at), F.get(b, at - 1)
    low = F.coalesce(before["le"], F.lit(0.0))
    under = F.coalesce(before["n"], F.lit(0.0))
    inside = F.when((at == 0) & (here["le"] <= 0), here["le"]).otherwise(low + (here["le"] - low) * ieee.div(rank - under, here["n"] - under))
    last = F.get(b, size - 2)["le"]
    value = F.when(at == size - 1, last).otherwise(inside)
    broken = (size < 2) | (F.element_at(b, -1)["le"] != float("inf")) | (total == 0) | F.isnan(total)
    return F.when(F.isnan(q), ieee.nan()).when(q < 0, F.lit(float("-inf"))).when(q > 1, F.lit(float("inf"))).when(broken, ieee.nan()).otherwise(value)


def share_below(x: Column, b: Column) -> Column:
    """The share of observations up to x, interpolated within its bucket."""
    size, total = F.size(b), F.element_at(b, -1)["n"]
    at = F.size(F.filter(b, lambda e: e["le"] < x))
    here, before = F.get(b, at), F.get(b, at - 1)
    low = F.coalesce(before["le"], F.least(F.lit(0.0), here["le"]))
    under = F.coalesce(before["n"], F.lit(0.0))
    part = F.when(here["le"] == float("inf"), under).otherwise(under + (here["n"] - under) * F.greatest(F.lit(0.0), F.least(F.lit(1.0), ieee.div(x - low, here["le"] - low))))
    broken = (size < 2) | (F.element_at(b, -1)["le"] != float("inf")) | (total == 0)
    return F.when(broken, ieee.nan()).when(x == float("inf"), F.lit(1.0)).when(x == float("-inf"), F.lit(0.0)).otherwise(ieee.div(part, total))


def _doubted(planner, vector: DataFrame) -> DataFrame:
    """The vector; bounds that are no numbers are remarked."""
    le = value_of(F.col("labels"), "le")
    broken = native.floats(vector).filter(~le.isin("+Inf", "Inf", "inf", "+inf") & le.try_cast("double").isNull())
    planner.doubt(broken, F.concat(F.lit('bucket label "le" is missing or has a malformed value of "'), le, F.lit('" for metric name "'), value_of(F.col("labels"), NAME), F.lit('"')))
    return vector


def _natives(vector: DataFrame) -> DataFrame | None:
    return native.histograms(vector).select(drop(F.col("labels"), [NAME]).alias("labels"), "step", "h") if native.has_native(vector) else None


def _quantiles(planner, vector: DataFrame, q) -> DataFrame:
    """labels, key, step, value: a quantile of classic buckets and of native histograms."""
    planner._quantile_doubt(q)
    rows = planner._with_scalar(buckets_of(native.floats(_doubted(planner, vector))), q, "q")
    out = rows.select("labels", "key", "step", quantile(F.col("q"), F.col("b")).alias("value"))
    own = _natives(vector)
    if own is None:
        return out
    own = rekeyed(planner._with_scalar(own, q, "q").select("labels", "step", nh.quantile(F.col("q"), F.col("h")).alias("value")))
    return planner._unique(out.unionByName(own))


def histogram_call(planner, name: str, args: tuple, grid) -> DataFrame:
    b = F.col("b")
    if name == "histogram_quantile":
        return _quantiles(planner, planner.eval(args[1], grid), planner.eval(args[0], grid))
    if name == "histogram_fraction":
        vector = planner.eval(args[2], grid)
        low, high = planner.eval(args[0], grid), planner.eval(args[1], grid)
        rows = planner._with_scalar(planner._with_scalar(buckets_of(native.floats(_doubted(planner, vector))), low, "x"), high, "y")
        share = F.when(F.col("x") >= F.col("y"), F.lit(0.0)).otherwise(share_below(F.col("y"), b) - share_below(F.col("x"), b))
        out, own = rows.select("labels", "key", "step", share.alias("value")), _natives(vector)
        if own is None:
            return out
        own = planner._with_scalar(planner._with_scalar(own, low, "x"), high, "y")
        return planner._unique(out.unionByName(rekeyed(own.select("labels", "step", nh.fraction(F.col("x"), F.col("y"), F.col("h")).alias("value")))))
    if not isinstance(args[1], Text):
        raise QueryError("histogram_quantiles needs a label name")
    vector = planner.eval(args[0], grid)
    out = None
    for a in args[2:]:
        q = planner.eval(a, grid)
        part = _quantiles(planner, vector, q)
        part = rekeyed(part.select(put(F.col("labels"), args[1].value, F.lit(f"{q.constant:g}" if q.constant is not None else "")).alias("labels"), "step", "value"))
        out = part if out is None else out.unionByName(part)
    return out
