"""Tables of the engine on storage, and adapters for the relational test tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.rollups import write_layout
from .model import as_logs, as_samples, label_map, ns

#: Sort order within files, by signal: what statistics can skip by.
ORDER = {"logs": ["key", "ts"], "samples": ["key", "ts"], "spans": ["trace", "start"]}


def read(spark: SparkSession, path: str, start: int | None = None, end: int | None = None, ts: str = "ts") -> DataFrame:
    """A table written by `write`; bounds (ns) prune days as well as row groups."""
    rows = spark.read.parquet(path)
    for bound, op in ((start, ">="), (end, "<=")):
        if bound is not None:
            day = F.lit(_day_text(bound)).cast("date")
            rows = rows.filter(F.col("day").cast("date") >= day if op == ">=" else F.col("day").cast("date") <= day)
            rows = rows.filter(F.col(ts) >= bound if op == ">=" else F.col(ts) <= bound)
    return rows


def _day_text(at: int) -> str:
    import datetime

    return datetime.datetime.fromtimestamp(at // 10**9, datetime.timezone.utc).date().isoformat()


def write(df: DataFrame, path: str, signal: str, mode: str = "append") -> None:
    ts = "start" if signal == "spans" else "ts"
    write_layout(df, path, ORDER[signal], F.to_date(F.timestamp_micros((F.col(ts) / F.lit(1000)).cast("long"))), mode)


def append_once(df: DataFrame, path: str, signal: str, batch: str) -> None:
    """Appends a batch under a key; the same key again replaces what it wrote, so that a retry adds nothing twice."""
    write(df.withColumn("batch", F.lit(batch)), f"{path}/batch={batch}", signal, "overwrite")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_samples(spark: SparkSession, sf_dir: str, by_user: bool = False) -> DataFrame:
    labels: dict[str, Column] = {"event_type": F.col("event_type")}
    if by_user:
        labels["team"] = (F.col("user_id") % 3).cast("string")
    return as_samples(table(spark, sf_dir, "events"), "events_value", labels, ns(F.col("ts")), F.col("value"))


def event_line() -> Column:
    level = F.when(F.col("event_type") == "error", "error").when(F.col("event_type") == "purchase", "warn").otherwise("info")
    return F.concat(F.lit("level="), level, F.lit(" user="), F.col("user_id").cast("string"), F.lit(" took="), (F.col("event_id") % 500).cast("string"), F.lit("ms size="), (F.col("user_id") * 100).cast("string"), F.lit("B ip=10.0."), (F.col("user_id") % 4).cast("string"), F.lit('.7 msg="got it"'))


def event_logs(spark: SparkSession, sf_dir: str, line: Column | None = None) -> DataFrame:
    return as_logs(table(spark, sf_dir, "events"), {"event_type": F.col("event_type")}, ns(F.col("ts")), event_line() if line is None else line, {"team": F.col("user_id") % 3})


def conversation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A trace for each conversation, a span for each turn under the one before."""
    start = F.lit(1704067200 * 10**9) + F.col("conv_id") * 60_000_000_000 + F.col("turn") * 1_000_000_000
    text = F.length("text")
    return table(spark, sf_dir, "conversations").select(
        F.col("conv_id").cast("string").alias("trace"), F.col("turn").cast("string").alias("id"), F.when(F.col("turn") > 0, (F.col("turn") - 1).cast("string")).alias("parent"), F.col("role").alias("name"), F.when(F.col("role") == "user", "front").otherwise("model").alias("service"), F.lit(2).alias("kind"),
        start.alias("start"), (start + text * 1_000_000).alias("end"), F.when(text > 800, 2).otherwise(1).alias("status"), label_map(len=text).alias("attrs"), label_map(region=F.concat(F.lit("r"), F.col("conv_id") % 3)).alias("resource"), F.array().cast("array<struct<name:string,ts:bigint,attrs:map<string,string>>>").alias("events"),
    )
