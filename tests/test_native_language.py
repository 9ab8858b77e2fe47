"""Native histograms, annotations, durations and sampling in the metric language."""

import math

import pytest
from pyspark.sql import functions as F

from skein.api import Engine
from skein.functions import native_histogram as nh
from skein.functions.label_hash import hash_of
from skein.functions.labels import key_of, labels_of, rekeyed
from skein.operators import rollups
from skein.plans.grid import Grid
from skein.plans.logql import LogPlanner
from skein.plans.promql import MetricPlanner
from skein.plans.promql_parser import QueryError, Selector, format_query, parse, resolved
from skein.sources.tables import event_logs, event_samples

S = 10**9
SF = "/root/testdata/sf0.001"


def make(n, pos=None, total=None, schema=0):
    pos = pos if pos is not None else {1: float(n)}
    return (schema, 0.001, 0.0, float(sum(pos.values())), float(n if total is None else total), pos, {})


@pytest.fixture(scope="module")
def samples(spark):
    rows = []
    for t, n in [(0, 1), (60, 3), (120, 2), (180, 5)]:
        rows.append(({"__name__": "lat_count", "job": "a"}, t * S, None, False, make(n)))
        rows.append(({"__name__": "lat_count", "job": "b"}, t * S, None, False, make(2 * n)))
        rows.append(({"__name__": "plain_total", "job": "a"}, t * S, float(t), False, None))
        rows.append(({"__name__": "mix", "job": "a"}, t * S, float(t) if t < 100 else None, False, None if t < 100 else make(n)))
    return rekeyed(spark.createDataFrame(rows, f"labels map<string,string>, ts long, value double, stale boolean, h {nh.TYPE}")).cache()


def run(samples, query, at=180, lookback=300 * S):
    p = MetricPlanner(samples, Grid(at * S, at * S, S), lookback)
    out = {r.labels.get("job", ""): (r.value, r.h if "h" in r else None) for r in p.run(query).collect()}
    return out, {(r.kind, r.message) for r in p.annotations().collect()}


def test_selectors_and_properties(samples):
    out, _ = run(samples, "lat_count")
    assert out["a"][0] is None and out["a"][1].pos == {1: 5.0} and out["b"][1].pos == {1: 10.0}
    for name, value in {"count": 5.0, "sum": 5.0, "avg": 1.0}.items():
        assert run(samples, f"histogram_{name}(lat_count)")[0]["a"][0] == value
    middle = 2**0.5
    assert run(samples, "histogram_stdvar(lat_count)")[0]["a"][0] == pytest.approx((middle - 1) ** 2)
    assert run(samples, "histogram_stddev(lat_count)")[0]["a"][0] == pytest.approx(middle - 1)
    assert run(samples, "histogram_count(plain_total)")[0] == {}
    assert run(samples, "histogram_quantile(1, lat_count)")[0]["a"][0] == pytest.approx(2)
    assert run(samples, "histogram_fraction(0, 2, lat_count)")[0]["b"][0] == pytest.approx(1)


def test_windows_over_histograms(samples):
    out, _ = run(samples, "increase(lat_count[200s])")
    assert out["a"][1]["count"] == pytest.approx(7 * (180 + min(20, 180 * 1 / 7)) / 180)
    assert run(samples, "rate(lat_count[200s])")[0]["a"][1]["count"] == pytest.approx(out["a"][1]["count"] / 200)
    assert run(samples, "delta(lat_count[200s])")[0]["a"][1]["count"] == pytest.approx(4 * 200 / 180)
    assert run(samples, "irate(lat_count[200s])")[0]["a"][1]["count"] == pytest.approx(3 / 60)
    assert run(samples, "idelta(lat_count[200s])")[0]["b"][1]["count"] == pytest.approx(6)
    assert run(samples, "sum_over_time(lat_count[200s])")[0]["a"][1].pos == {1: 11.0}
    assert run(samples, "avg_over_time(lat_count[200s])")[0]["a"][1].pos == {1: 2.75}
    assert run(samples, "count_over_time(lat_count[200s])")[0]["a"][0] == 4
    assert run(samples, "resets(lat_count[200s])")[0]["a"][0] == 1 and run(samples, "changes(lat_count[200s])")[0]["a"][0] == 3
    assert run(samples, "last_over_time(lat_count[200s])")[0]["a"][1].pos == {1: 5.0}


def test_mixed_windows_give_nothing(samples):
    out, notes = run(samples, "sum_over_time(mix[200s])")
    assert out == {} and ("warning", 'encountered a mix of histograms and floats for metric name "mix"') in notes
    assert run(samples, "max_over_time(mix[200s])")[0]["a"][0] == 60
    out, notes = run(samples, 'sum by (job) ({__name__=~"lat_count|plain_total", job="a"})')
    assert out == {} and ("warning", "encountered a mix of histograms and floats for aggregation") in notes


def test_operators(samples):
    assert run(samples, "lat_count * 2")[0]["a"][1].pos == {1: 10.0} and run(samples, "lat_count / 5")[0]["a"][1].pos == {1: 1.0}
    assert run(samples, "lat_count / 0")[0]["a"][1]["count"] == math.inf
    assert run(samples, "lat_count + lat_count")[0]["b"][1].pos == {1: 20.0}
    assert run(samples, "lat_count - lat_count")[0]["a"][1].pos == {}
    assert set(run(samples, "lat_count == lat_count")[0]) == {"a", "b"} and run(samples, "lat_count != lat_count")[0] == {}
    assert run(samples, "-lat_count")[0]["a"][1].pos == {1: -5.0}
    assert run(samples, "lat_count + 1")[0] == {} and run(samples, "abs(lat_count)")[0] == {}
    assert run(samples, "sum(lat_count)")[0][""][1].pos == {1: 15.0} and run(samples, "avg(lat_count)")[0][""][1].pos == {1: 7.5}
    assert run(samples, "count(lat_count)")[0][""][0] == 2
    assert run(samples, "lat_count * on (job) plain_total")[0]["a"][1].pos == {1: 900.0}
    assert run(samples, "plain_total + 1")[0]["a"][0] == 181


def test_trims(samples):
    below = run(samples, "lat_count </ 1.4142135623730951")[0]["a"][1]  # the exponential middle of (1, 2]
    assert below.pos[1] == pytest.approx(2.5) and below["count"] == pytest.approx(2.5) and below.sum == pytest.approx(2.5 * 2**0.25)
    above = run(samples, "lat_count >/ 1.4142135623730951")[0]["a"][1]
    assert above.pos[1] == pytest.approx(2.5) and above.sum == pytest.approx(2.5 * 2**0.75)
    same = run(samples, "lat_count </ 2")[0]["a"][1]
    assert same.pos == {1: 5.0} and same.sum == 5.0
    assert run(samples, "plain_total </ 2")[0] == {}


def test_annotations(samples):
    _, notes = run(samples, "rate(mix[200s])")
    assert ("info", 'metric might not be a counter, name does not end in _total/_sum/_count/_bucket: "mix"') in notes
    assert ("warning", "quantile value should be between 0 and 1, got 2") in run(samples, "quantile(2, plain_total)")[1]
    assert ("info", "ignored histogram in max aggregation") in run(samples, "max(lat_count)")[1]
    assert run(samples, "rate(plain_total[200s])")[1] == set()


def test_compensated_sums(spark):
    rows = [({"__name__": "k"}, i * S, v, False) for i, v in enumerate([1e16, 1.0, -1e16])] + [({"__name__": "big"}, i * S, 1e308, False) for i in range(3)]
    table = rekeyed(spark.createDataFrame(rows, "labels map<string,string>, ts long, value double, stale boolean"))
    at = lambda q: MetricPlanner(table, Grid(2 * S, 2 * S, S)).run(q).first().value
    assert at("sum_over_time(k[1m])") == 1 and at("avg_over_time(k[1m])") == pytest.approx(1 / 3)
    assert at("avg_over_time(big[1m])") == pytest.approx(1e308) and at("sum_over_time(big[1m])") == math.inf
    assert at("sum(big)") == 1e308


def test_durations():
    window = lambda q: resolved(parse(q), 60.0, 3600.0)
    assert window("x[step() * 2]") == Selector((("__name__", "=", "x"),), 120 * S)
    assert window("x[min_of(range(), 10m) + 30]").window == 630 * S and window("x[2 ^ 3 % 5]").window == 3 * S
    assert window("x offset -2 ^ 2").left.offset == -2 * S and window("x offset (1m - step())").offset == 0
    assert window("max_over_time(x[1h:step()])").args[0].step == 60 * S
    assert parse("x[5m + 30s]").window == 330 * S
    assert format_query(parse("rate(x[step() * 2])")) == "rate(x[(step() * 2)])"
    for bad in ["x[5m - 5m]", "x[1m / 0]", "x[400d]", "x[range() - 1h]"]:
        with pytest.raises(QueryError):
            window(bad)


def test_sampling_hash():
    import xxhash

    assert hash_of({"b": "2", "a": "1"}) == xxhash.xxh64_hexdigest(b"\x01a\x011\x01b\x012")
    assert hash_of({"a": "x" * 300}) == xxhash.xxh64_hexdigest(b"\x01a\xff\x2c\x01\x00" + b"x" * 300)


def test_labels_with_separators(spark):
    odd = {"a": "x\x02y\x01z\x03\x05", "b": "1"}
    df = spark.createDataFrame([(odd,)], "labels map<string,string>").select(labels_of(key_of(F.col("labels"))).alias("l"))
    assert df.first().l == odd


def test_rollups_answer_queries(spark):
    day = 86400 * S
    origin = 1704067200 * S
    grid = (origin + 2 * day, origin + 6 * day, day // 2)
    samples, logs = event_samples(spark, SF), event_logs(spark, SF)
    raw = Engine(samples, logs)
    rolled = Engine(samples.filter(F.lit(False)), logs.filter(F.lit(False)), minutes=rollups.log_minutes(logs, with_meta=True), hours=rollups.metric_hours(samples))
    flat = lambda df: sorted((sorted(r.labels.items()), r.step, round(r.value, 9)) for r in df.collect())
    for q in ["increase(events_value[1d])", 'max_over_time(events_value{event_type="view"}[12h] offset 6h)', "sum(changes(events_value[1d]))"]:
        assert flat(raw.metric_query(q, *grid)) == flat(rolled.metric_query(q, *grid)) != []
    for q in ['sum by (team) (count_over_time({event_type=~".+"}[1d]))', 'bytes_rate({event_type="view"}[12h])']:
        assert flat(raw.log_query(q, *grid)) == flat(rolled.log_query(q, *grid)) != []
    assert rolled.log_query('count_over_time({event_type="view"} |= "user=1" [1d])', *grid).count() == 0  # lines are needed: raw rows


def test_division_by_zero_alone_is_nan(spark):
    rows = [({"app": "a"}, {}, "app\x01a", S, "v=inf"), ({"app": "b"}, {}, "app\x01b", S, "v=3")]
    logs = spark.createDataFrame(rows, "stream map<string,string>, meta map<string,string>, key string, ts long, line string")
    out = lambda q: {r.labels["app"]: r.value for r in LogPlanner(logs, Grid(2 * S, 2 * S, S)).run(q).collect()}
    q = 'sum by (app) (sum_over_time({app=~".+"} | logfmt | unwrap v [1m])) / '
    half = out(q + "2")
    assert half["a"] == math.inf and half["b"] == 1.5
    assert math.isnan(out(q + "0")["b"])
