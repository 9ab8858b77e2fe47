"""Special values, staleness and matching of the metric language, on small series."""

import math

import pytest
from pyspark.sql import functions as F

from skein.functions.labels import NAME, key_from, key_of, rekeyed
from skein.plans.grid import Grid, with_before
from skein.plans.promql import MetricPlanner
from skein.plans.promql_parser import QueryError, format_query, parse
from skein.sources.model import as_samples, label_map, resolve_duplicates

NAN, INF, S = float("nan"), float("inf"), 10**9
STALE = "stale"


def series(spark, **given):
    """name__label_value = [(seconds, value)]"""
    rows = []
    for full, points in given.items():
        name, _, rest = full.partition("__")
        labels = {NAME: name} | dict([rest.split("_", 1)] if rest else [])
        rows += [(labels, t * S, 0.0 if v == STALE else float(v), v == STALE) for t, v in points]
    return rekeyed(spark.createDataFrame(rows, "labels map<string,string>, ts long, value double, stale boolean"))


def values(spark, query, at, samples, lookback=300 * S):
    out = MetricPlanner(samples, Grid(at * S, at * S, S), lookback).run(query).collect()
    return sorted((tuple(sorted(r.labels.items())), r.value) for r in out)


def one(*args, **kw):
    out = values(*args, **kw)
    assert len(out) == 1
    return out[0][1]


@pytest.fixture(scope="module")
def counter(spark):
    return series(spark, c=[(0, 100), (60, 110), (120, 120), (180, 5), (240, 15), (300, 25), (360, 35)], odd=[(0, 1), (60, NAN), (120, INF), (180, -INF), (240, 5)], s=[(0, 1), (60, 2), (120, STALE), (180, STALE), (240, 5)])


def test_counter_reset(spark, counter):
    assert one(spark, "increase(c[6m])", 360, counter) == pytest.approx((35 - 110 + 120) * (360 - 60) / 300 * 1.0 + 45 * 60 / 300 - 0.0, rel=0.3)
    assert one(spark, "resets(c[7m])", 360, counter) == 1
    assert one(spark, "changes(c[7m])", 360, counter) == 6
    assert one(spark, "irate(c[5m])", 180, counter) == pytest.approx(5 / 60)
    assert one(spark, "idelta(c[5m])", 180, counter) == -115


def test_stale_markers(spark, counter):
    assert values(spark, "s", 130, counter) == []
    assert one(spark, "s", 100, counter) == 2
    assert one(spark, "count_over_time(s[5m])", 240, counter) == 3
    assert one(spark, "count_over_time(s[4m])", 240, counter) == 2  # the window is open at 0 s
    assert values(spark, "c", 1000, counter) == []


def test_special_values(spark, counter):
    assert one(spark, "max_over_time(odd[5m])", 240, counter) == INF
    assert one(spark, "min_over_time(odd[5m])", 240, counter) == -INF
    assert math.isnan(one(spark, "sum_over_time(odd[5m])", 240, counter))
    assert one(spark, "c / 0", 60, counter) == INF
    assert math.isnan(one(spark, "(c - c) / 0", 60, counter))
    assert math.isnan(one(spark, "ln(-c)", 60, counter))
    assert one(spark, "ln(c - c)", 60, counter) == -INF
    assert one(spark, "-7 % 4 + vector(0)", 60, counter) == -3
    assert math.isnan(one(spark, "quantile_over_time(NaN, c[5m])", 60, counter))
    assert one(spark, "quantile_over_time(2, c[5m])", 60, counter) == INF


def test_comparison_with_nan(spark, counter):
    assert values(spark, "odd == odd", 60, counter) == []
    assert one(spark, "odd != bool odd", 60, counter) == 1


def test_matching_errors(spark):
    s = series(spark, a__x_1=[(0, 1)], a__x_2=[(0, 2)], b__y_1=[(0, 3)])
    with pytest.raises(Exception, match="many-to-many"):
        values(spark, "b * on () a", 0, s)
    assert len(values(spark, "a * on () group_left b", 0, s)) == 2


def test_label_functions(spark):
    s = series(spark, a__x_1=[(0, 1)])
    assert values(spark, 'label_replace(a, "y", "v$1", "x", "(.*)")', 0, s)[0][0] == ((NAME, "a"), ("x", "1"), ("y", "v1"))
    assert values(spark, 'label_replace(a, "x", "", "x", ".*")', 0, s)[0][0] == ((NAME, "a"),)
    assert values(spark, 'absent(nothing{q="1", r=~"2"})', 0, s) == [((("q", "1"),), 1.0)]


def test_duplicates(spark):
    rows = rekeyed(spark.createDataFrame([({NAME: "a"}, 0, 1.0, False), ({NAME: "a"}, 0, NAN, False), ({NAME: "a"}, 0, 3.0, False), ({NAME: "b"}, 0, 9.0, False), ({NAME: "b"}, 0, 0.0, True)], "labels map<string,string>, ts long, value double, stale boolean"))
    out = {r.labels[NAME]: (r.value, r.stale) for r in resolve_duplicates(rows).collect()}
    assert out == {"a": (3.0, False), "b": (0.0, True)}


@pytest.mark.parametrize("query", ['{x=""}', "rate(a)", "a[5m]", "sum(1)", "a offset", "a > bool", "foo(a)", "1 > 2", 'a{x=~"("}', "a and on (x) group_left b"])
def test_refused(spark, query):
    s = series(spark, a=[(0, 1)])
    with pytest.raises((QueryError, ValueError, IndexError)):
        MetricPlanner(s, Grid(0, 0, S)).run(query).collect()


def test_formatter():
    for q in ("sum by (a) (rate(b[5m]))", 'topk(3, a{b=~"x.*"} offset 5m)', "a / on (x) group_left (y) b", "max_over_time(rate(a[5m])[1h:5m] @ end())", "(a + b) * c"):
        assert format_query(parse(format_query(parse(q)))) == format_query(parse(q))


def test_key_of_known_names(spark):
    values = ["x", "", None, "\x01y\x03", "\x02", "7"]
    rows = spark.createDataFrame([tuple(values[(i * (j + 2) + j) % 6] for j in range(5)) for i in range(12)], "a string, b string, c string, d string, e string")
    own = dict(zip(["a", "ab", "a_b", NAME, "B"], map(F.col, "abcde"), strict=True))
    keys = rows.select(key_from(own).alias("k"), key_of(label_map(**own)).alias("m")).collect()
    assert all(r.k == r.m for r in keys) and len({r.k for r in keys}) > 4


def test_buckets_are_filtered_after_their_sums(spark):
    """Below the aggregate the filter would read labels from the key of each sample."""
    le = F.element_at(F.array(F.lit("1"), F.lit("bad"), F.lit("+Inf")), (F.col("id") % 3 + 1).cast("int"))
    samples = as_samples(spark.range(6), "m", {"le": le}, F.col("id") * S, F.lit(1.0))
    out = MetricPlanner(samples, Grid(10 * S, 10 * S, S)).run("histogram_quantile(0.25, sum_over_time(m[20s]))")
    below_sums = out._jdf.queryExecution().optimizedPlan().toString().rpartition("Aggregate")[2].partition("\n")[2]
    assert "str_to_map" not in below_sums and out.first().value == 0.25


def test_long_series_are_read_in_slices(spark):
    """No task holds a series, and what is before a sample is found across slices, empty ones too."""
    given = [(k, t * S + (7 if k == "b" else 0), NAN if t % 97 == 0 else float((t * 31) % 11 - 2)) for k in "ab" for t in range(600) if k == "a" or not 100 < t < 400] + [("c", 5, 1.0)]
    out = with_before(spark.createDataFrame(given, "key string, ts long, value double").repartition(5), ["ts"], 0, 600 * S)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Window" in plan and all("slice" in line for line in plan.split("\n") if "Window" in line and "value" in line)
    found = {(r.key, r.ts): (r.before, r.before_ts, r.lost) for r in out.collect()}
    assert len(found) == len(given)
    last, text = {}, repr  # NaN is not equal to itself
    for k, ts, v in sorted(given, key=lambda x: x[:2]):
        before, before_ts, lost = last.get(k, (None, None, 0.0))
        lost += before if before is not None and v < before else 0.0
        assert text(found[k, ts]) == text((before, before_ts, lost))
        last[k] = (v, ts, lost)
