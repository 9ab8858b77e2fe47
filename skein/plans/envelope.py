"""Results as the JSON that dashboards read: a row for each series or stream, and whole envelopes of those."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import key_of
from .promql import format_value


def _seconds(ns: Column) -> Column:
    """Seconds as a JSON number."""
    return F.regexp_replace((ns.cast("decimal(20,0)") / 1_000_000_000).cast("decimal(20,3)").cast("string"), r"\.?0+$", "")


def _pair(step: Column, value: Column) -> Column:
    return F.concat(F.lit("["), _seconds(step), F.lit(',"'), format_value(value), F.lit('"]'))


def _labels(labels: Column) -> Column:
    """An object with names in order."""
    return F.coalesce(F.to_json(F.map_from_entries(F.array_sort(F.map_entries(labels)))), F.lit("{}"))


def matrix_rows(result: DataFrame) -> DataFrame:
    """json: {metric, values} for each series of (labels, step, value)."""
    rows = result.withColumn("k", key_of(F.col("labels"))).groupBy("k").agg(F.first("labels").alias("labels"), F.array_sort(F.collect_list(F.struct("step", "value"))).alias("points"))
    points = F.array_join(F.transform("points", lambda p: _pair(p["step"], p["value"])), ",")
    return rows.select("k", F.concat(F.lit('{"metric":'), _labels(F.col("labels")), F.lit(',"values":['), points, F.lit("]}")).alias("json"))


def vector_rows(result: DataFrame) -> DataFrame:
    """json: {metric, value} for each row of an instant result."""
    return result.select(key_of(F.col("labels")).alias("k"), F.concat(F.lit('{"metric":'), _labels(F.col("labels")), F.lit(',"value":'), _pair(F.col("step"), F.col("value")), F.lit("}")).alias("json"))


def stream_rows(entries: DataFrame, backward: bool = True) -> DataFrame:
    """json: {stream, values: [[ns, line]]} for each label set of (ts, labels, line)."""
    rows = entries.withColumn("k", key_of(F.col("labels"))).groupBy("k").agg(F.first("labels").alias("labels"), F.sort_array(F.collect_list(F.struct("ts", "line")), asc=not backward).alias("e"))
    values = F.to_json(F.transform("e", lambda x: F.array(x["ts"].cast("string"), x["line"])))
    return rows.select("k", F.concat(F.lit('{"stream":'), _labels(F.col("labels")), F.lit(',"values":'), values, F.lit("}")).alias("json"))


def envelope(rows: DataFrame, kind: str) -> DataFrame:
    """One row, json: {status, data: {resultType, result}} around the rows of a matrix, vector or streams result."""
    joined = rows.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "json"))), lambda x: x["json"]), ",").alias("all"))
    return joined.select(F.concat(F.lit(f'{{"status":"success","data":{{"resultType":"{kind}","result":['), "all", F.lit("]}}")).alias("json"))


def scalar(result: DataFrame) -> DataFrame:
    """One row, json: the envelope of a number at a step."""
    return result.select(F.concat(F.lit('{"status":"success","data":{"resultType":"scalar","result":'), _pair(F.col("step"), F.col("value")), F.lit("}}")).alias("json"))
