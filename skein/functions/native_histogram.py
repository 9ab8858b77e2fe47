"""Native histograms: exponential buckets as maps from index to count, so that adding is a merge of maps.

A histogram is a struct (schema int, zero_threshold, zero_count, count, sum double, pos, neg map<int,double>). Bucket i of
schema s ends at 2^(i / 2^s) and begins where bucket i - 1 ends; the zero bucket lies within +- zero_threshold.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.grid import Grid
from . import ieee

TYPE = "struct<schema:int,zero_threshold:double,zero_count:double,count:double,sum:double,pos:map<int,double>,neg:map<int,double>>"


def struct(schema: Column, zero_threshold: Column, zero_count: Column, count: Column, total: Column, pos: Column, neg: Column) -> Column:
    return F.struct(schema.cast("int").alias("schema"), zero_threshold.cast("double").alias("zero_threshold"), zero_count.cast("double").alias("zero_count"), count.cast("double").alias("count"), total.cast("double").alias("sum"), pos.alias("pos"), neg.alias("neg"))


def _merged(pairs: Column) -> Column:
    """A map from an array of (index, count) in which indexes repeat."""
    none = F.create_map().cast("map<int,double>")
    return F.aggregate(pairs, none, lambda m, p: F.map_concat(F.map_filter(m, lambda k, v: k != p["key"]), F.create_map(p["key"], F.coalesce(F.element_at(m, p["key"]), F.lit(0.0)) + p["value"])))


def reduced(h: Column, schema: Column) -> Column:
    """The histogram at a coarser schema: neighbouring buckets add up."""
    by = F.pow(F.lit(2.0), h["schema"] - schema)

    def side(m: Column) -> Column:
        return F.when(h["schema"] == schema, m).otherwise(_merged(F.transform(F.map_entries(m), lambda e: F.struct(F.ceil(e["key"] / by).cast("int").alias("key"), e["value"].alias("value")))))

    return struct(schema, h["zero_threshold"], h["zero_count"], h["count"], h["sum"], side(h["pos"]), side(h["neg"]))


def _zipped(a: Column, b: Column, f: Callable[[Column, Column], Column]) -> Column:
    zero = lambda v: F.coalesce(v, F.lit(0.0))
    return F.map_zip_with(a, b, lambda k, x, y: f(zero(x), zero(y)))


def combined(a: Column, b: Column, sign: int = 1) -> Column:
    """a + b or a - b at the coarser schema of both; the wider zero bucket counts."""
    schema = F.least(a["schema"], b["schema"])
    x, y = reduced(a, schema), reduced(b, schema)
    f = lambda p, q: p + q if sign > 0 else p - q
    return struct(schema, F.greatest(a["zero_threshold"], b["zero_threshold"]), f(a["zero_count"], b["zero_count"]), f(a["count"], b["count"]), f(a["sum"], b["sum"]), _zipped(x["pos"], y["pos"], f), _zipped(x["neg"], y["neg"], f))


def scaled(h: Column, by: Column) -> Column:
    side = lambda m: F.transform_values(m, lambda k, v: v * by)
    return struct(h["schema"], h["zero_threshold"], h["zero_count"] * by, h["count"] * by, h["sum"] * by, side(h["pos"]), side(h["neg"]))


def _bound(i: Column, schema: Column) -> Column:
    return F.pow(F.lit(2.0), i / F.pow(F.lit(2.0), schema.cast("double")))


def buckets(h: Column) -> Column:
    """Array of (low, high, n) by rising bounds, without empty buckets."""
    low, high = lambda i: _bound(i - 1, h["schema"]), lambda i: _bound(i, h["schema"])
    pos = F.transform(F.map_entries(h["pos"]), lambda e: F.struct(low(e["key"]).alias("low"), high(e["key"]).alias("high"), e["value"].alias("n")))
    neg = F.transform(F.map_entries(h["neg"]), lambda e: F.struct((-high(e["key"])).alias("low"), (-low(e["key"])).alias("high"), e["value"].alias("n")))
    zero = F.array(F.struct((-h["zero_threshold"]).alias("low"), h["zero_threshold"].alias("high"), h["zero_count"].alias("n")))
    return F.array_sort(F.filter(F.concat(neg, zero, pos), lambda b: b["n"] > 0))


def _inside(low: Column, high: Column, part: Column) -> Column:
    """The value at a part of a bucket: exponential on one side of zero, linear across it."""
    up = low * F.pow(ieee.div(high, low), part)
    down = -(F.abs(low) * F.pow(ieee.div(F.abs(high), F.abs(low)), part))
    return F.when(low > 0, up).when(high < 0, down).otherwise(low + (high - low) * part)


def quantile(q: Column, h: Column) -> Column:
    """Interpolated within its bucket; a zero bucket without negative (positive) ones counts from (up to) zero."""

    def run(b: Column) -> Column:
        rank = q * h["count"]
        seen = F.aggregate(b, F.struct(F.lit(0.0).alias("n"), F.lit(None).cast("struct<low:double,high:double,n:double>").alias("b"), F.lit(0.0).alias("before")), lambda s, x: F.when(s["b"].isNotNull(), s).otherwise(F.struct((s["n"] + x["n"]).alias("n"), F.when(s["n"] + x["n"] >= rank, x).alias("b"), s["n"].alias("before"))))
        x = F.coalesce(seen["b"], F.element_at(b, -1))
        zero = (x["low"] <= 0) & (x["high"] >= 0)
        low = F.when(zero & (F.size(F.map_keys(h["neg"])) == 0), F.lit(0.0)).otherwise(x["low"])
        high = F.when(zero & (F.size(F.map_keys(h["pos"])) == 0), F.lit(0.0)).otherwise(x["high"])
        return _inside(low, high, (rank - seen["before"]) / x["n"])

    value = F.transform(F.array(buckets(h)), run)[0]
    return F.when(F.isnan(q) | (h["count"] == 0), ieee.nan()).when(q < 0, F.lit(-ieee.INF)).when(q > 1, F.lit(ieee.INF)).otherwise(value)


def fraction(low: Column, high: Column, h: Column) -> Column:
    """The share of observations between two values."""

    def below(x: Column) -> Column:
        def part(b: Column) -> Column:
            across = ieee.div(x - b["low"], b["high"] - b["low"])
            up = F.when(b["low"] > 0, F.log2(F.greatest(x, b["low"]) / b["low"]) / F.log2(b["high"] / b["low"]))
            down = F.when(b["high"] < 0, 1 - F.log2(F.greatest(-x, -b["high"]) / -b["high"]) / F.log2(b["low"] / b["high"]))
            return F.when(x >= b["high"], b["n"]).when(x <= b["low"], F.lit(0.0)).otherwise(b["n"] * F.coalesce(up, down, across))

        return F.aggregate(buckets(h), F.lit(0.0), lambda a, b: a + part(b))

    return F.when(h["count"] == 0, ieee.nan()).when(low >= high, F.lit(0.0)).otherwise((below(high) - below(low)) / h["count"])


def average(h: Column) -> Column:
    return ieee.div(h["sum"], h["count"])


def variance(h: Column) -> Column:
    """From the geometric middle of each bucket (the zero bucket's is 0)."""
    mean = average(h)

    def middle(b: Column) -> Column:
        return F.when(b["low"] > 0, F.sqrt(b["low"] * b["high"])).when(b["high"] < 0, -F.sqrt(b["low"] * b["high"])).otherwise(F.lit(0.0))

    return F.when(h["count"] == 0, ieee.nan()).otherwise(F.aggregate(buckets(h), F.lit(0.0), lambda a, b: a + b["n"] * F.pow(middle(b) - mean, F.lit(2.0))) / F.when(h["count"] != 0, h["count"]))


def compacted(h: Column) -> Column:
    """Without empty buckets."""
    full = lambda m: F.map_filter(m, lambda k, v: v != 0)
    return struct(h["schema"], h["zero_threshold"], h["zero_count"], h["count"], h["sum"], full(h["pos"]), full(h["neg"]))


def equal(a: Column, b: Column) -> Column:
    """Whether two histograms hold the same, empty buckets aside."""
    x, y = compacted(a), compacted(b)
    text = lambda m: F.to_json(F.array_sort(F.map_entries(m)))
    same = (text(x["pos"]) == text(y["pos"])) & (text(x["neg"]) == text(y["neg"]))
    for part in ("schema", "zero_threshold", "zero_count", "count", "sum"):
        same = same & (x[part] == y[part])
    return same


def trimmed(h: Column, bound: Column, upper: bool = True) -> Column:
    """Without the observations above (or below) a bound; nothing changes where none is.

    A bucket across the bound keeps a share by its exponential scale, the zero bucket a linear one; the sum is estimated from
    the middles of what stays (geometric, that of the zero bucket arithmetic).
    """

    def log(x: Column) -> Column:
        return F.log2(F.greatest(F.abs(x), F.lit(5e-324)))

    def side(m: Column, sign: int) -> Column:
        """Entries (key, n, mid) of what stays."""

        def one(e: Column) -> Column:
            near, far = _bound(e["key"] - 1, h["schema"]), _bound(e["key"], h["schema"])
            low, high = (near, far) if sign > 0 else (-far, -near)
            across = (bound > low) & (bound < high)
            part = ieee.div(log(bound) - log(near), log(far) - log(near))
            below = F.when(bound <= low, 0.0).when(bound >= high, 1.0).otherwise(part if sign > 0 else 1 - part)
            keep = e["value"] * (below if upper else 1 - below)
            a, b = (F.lit(None).cast("double"), bound) if upper else (bound, F.lit(None).cast("double"))
            a, b = F.when(across, F.coalesce(a, low)).otherwise(low), F.when(across, F.coalesce(b, high)).otherwise(high)
            return F.struct(e["key"].alias("key"), keep.alias("n"), (F.sqrt(F.abs(a) * F.abs(b)) * sign).alias("mid"))

        return F.transform(F.map_entries(m), one)

    filled = lambda m: F.exists(F.map_values(m), lambda v: v != 0)
    low = F.when(filled(h["pos"]) & ~filled(h["neg"]), F.lit(0.0)).otherwise(-h["zero_threshold"])
    high = F.when(filled(h["neg"]) & ~filled(h["pos"]), F.lit(0.0)).otherwise(h["zero_threshold"])
    below = F.when(bound <= low, 0.0).when(bound >= high, 1.0).otherwise((bound - low) / F.when(high > low, high - low))
    zero = h["zero_count"] * (below if upper else 1 - below)
    inside = (bound > low) & (bound < high)
    middle = (F.when(inside & F.lit(not upper), bound).otherwise(low) + F.when(inside & F.lit(upper), bound).otherwise(high)) / 2

    def run(p: Column) -> Column:
        pos, neg = p["pos"], p["neg"]
        total = lambda f: F.aggregate(F.concat(pos, neg), F.lit(0.0), lambda a, e: a + f(e))
        count, value = total(lambda e: e["n"]) + zero, total(lambda e: e["n"] * e["mid"]) + F.when(zero > 0, zero * middle).otherwise(F.lit(0.0))
        back = lambda m: F.map_from_entries(F.filter(F.transform(m, lambda e: F.struct(e["key"], e["n"].alias("value"))), lambda e: e["value"] != 0))
        changed = (zero != h["zero_count"]) | F.exists(pos, lambda e: e["n"] != F.element_at(h["pos"], e["key"])) | F.exists(neg, lambda e: e["n"] != F.element_at(h["neg"], e["key"]))
        return F.when(changed, struct(h["schema"], h["zero_threshold"], zero, count, value, back(pos), back(neg))).otherwise(struct(*[h[x] for x in ("schema", "zero_threshold", "zero_count", "count", "sum", "pos", "neg")]))

    return F.transform(F.array(F.struct(side(h["pos"], 1).alias("pos"), side(h["neg"], -1).alias("neg"))), run)[0]


def is_reset(now: Column, before: Column) -> Column:
    """Whether a later histogram cannot continue the earlier one: any count fell."""
    schema = F.least(now["schema"], before["schema"])
    a, b = reduced(now, schema), reduced(before, schema)
    fell = lambda x, y: F.exists(F.map_entries(y), lambda e: F.coalesce(F.element_at(x, e["key"]), F.lit(0.0)) < e["value"])
    return (now["count"] < before["count"]) | (now["zero_count"] < before["zero_count"]) | (now["schema"] > before["schema"]) | fell(a["pos"], b["pos"]) | fell(a["neg"], b["neg"])


def summed(vector: DataFrame, by: list[str], column: str = "h") -> DataFrame:
    """by, h: histograms of a group added up at the group's coarsest schema, bucket by bucket, so that partial sums come first."""
    coarse = vector.groupBy(*by).agg(F.min(F.col(column)["schema"]).alias("schema"), F.max(F.col(column)["zero_threshold"]).alias("zero_threshold"), *[F.sum(F.col(column)[c]).alias(c) for c in ("zero_count", "count", "sum")])
    rows = vector.join(coarse.select(*by, F.col("schema").alias("to")), by).withColumn("r", reduced(F.col(column), F.col("to")))
    side = lambda s: F.transform(F.map_entries(F.col("r")[s]), lambda e: F.struct(F.lit(s).alias("side"), e["key"].alias("i"), e["value"].alias("n")))
    parts = rows.select(*by, F.explode(F.concat(side("pos"), side("neg"))).alias("b")).groupBy(*by, "b.side", "b.i").agg(F.sum("b.n").alias("n"))
    maps = parts.groupBy(*by).agg(*[F.map_from_entries(F.collect_list(F.when(F.col("side") == s, F.struct("i", "n")))).alias(s) for s in ("pos", "neg")])
    none = F.create_map().cast("map<int,double>")
    out = coarse.join(maps, by, "left")
    return out.select(*by, struct(F.col("schema"), F.col("zero_threshold"), F.col("zero_count"), F.col("count"), F.col("sum"), F.coalesce("pos", none), F.coalesce("neg", none)).alias("h"))


def increase(samples: DataFrame, grid: Grid, window: int, per_second: bool = False, counter: bool = True) -> DataFrame:
    """key, step, h: what histograms (key, ts, h) gained in a window, stretched to its ends as a counter's gain is; without counter, last minus first."""
    near = with_before(samples.filter((F.col("ts") > grid.start - window) & (F.col("ts") <= grid.end)))
    whole = combined(F.col("h"), F.col("before"), -1)
    gained = F.when(F.col("before").isNull(), F.lit(None)).when(F.lit(counter) & is_reset(F.col("h"), F.col("before")), F.col("h")).otherwise(whole)
    rows = grid.windows(near.withColumn("gain", gained), window)
    spans = rows.groupBy("key", "step").agg(F.min("ts").alias("t0"), F.max("ts").alias("t1"), F.count("*").alias("n"), F.min_by(F.col("h.count"), F.col("ts")).alias("c0")).filter("n > 1 and t1 > t0")
    inside = rows.filter((F.col("before_ts") > F.col("step") - window) & F.col("gain").isNotNull()).select("key", "step", F.col("gain").alias("h"))
    total = summed(inside, ["key", "step"]).join(spans, ["key", "step"])
    span = (F.col("t1") - F.col("t0")) / F.lit(1e9)
    gap = span / (F.col("n") - 1)
    left, right = (F.col("t0") - (F.col("step") - window)) / F.lit(1e9), (F.col("step") - F.col("t1")) / F.lit(1e9)
    left, right = (F.when(x >= gap * 1.1, gap / 2).otherwise(x) for x in (left, right))
    if counter:  # the count cannot have been below zero
        left = F.when((F.col("h.count") > 0) & (F.col("c0") >= 0), F.least(left, span * F.col("c0") / F.when(F.col("h.count") > 0, F.col("h.count")).otherwise(F.lit(1.0)))).otherwise(left)
    factor = (span + left + right) / span / (window / 1e9 if per_second else 1.0)
    return total.select("key", "step", compacted(scaled(F.col("h"), factor)).alias("h"))


def with_before(samples: DataFrame) -> DataFrame:
    """Adds the histogram before each of a series, and its time."""
    series = Window.partitionBy("key").orderBy("ts")
    return samples.withColumn("before", F.lag("h").over(series)).withColumn("before_ts", F.lag("ts").over(series))
