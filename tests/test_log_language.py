import pytest
from pyspark.sql import functions as F

from skein.functions.labels import key_of
from skein.functions.templates import TemplateError, compile_template
from skein.functions.units import bytes_of, duration_ns, seconds_of
from skein.plans import logql
from skein.plans.grid import Grid
from skein.plans.logql import LogPlanner, flatten_json, pattern_regex
from skein.plans.logql_parser import parse
from skein.plans.promql_parser import QueryError
from skein.sources.model import as_logs

S = 10**9


@pytest.fixture(scope="module")
def logs(spark):
    rows = [
        ({"app": "a"}, {}, 1 * S, '{"v": 1.50, "deep": {"x-y": true, "n": null, "l": [1]}, "app": "z"}'), ({"app": "a"}, {}, 2 * S, "not json v=2"), ({"app": "b"}, {"app": "meta", "id": "7"}, 3 * S, 'v=3 t=1h30m q="a b"'), ({"app": "b"}, {}, 4 * S, "from 192.168.1.9 to ::1"), ({"app": "b"}, {}, 5 * S, ""),
    ]
    df = spark.createDataFrame(rows, "stream map<string,string>, meta map<string,string>, ts long, line string")
    return df.withColumn("key", key_of(F.col("stream")))


def run(logs, query, start=0, end=100 * S, step=10 * S):
    return LogPlanner(logs, Grid(start, end, step)).run(query).collect()


def test_json_flattening(logs):
    r = run(logs, '{app="a"} | json')
    assert r[1].labels == {"app": "a", "v": "1.50", "deep_x_y": "true", "app_extracted": "z"}
    assert r[0].labels["__error__"] == "JSONParserErr"
    assert flatten_json("[1]") is None and flatten_json(None) is None


def test_metadata_collides_with_stream(logs):
    assert run(logs, '{app="b"} | id="7"')[0].labels == {"app": "b", "app_extracted": "meta", "id": "7"}


def test_logfmt_and_units(logs):
    assert run(logs, '{app="b"} | logfmt | t > 1h')[0].labels["q"] == "a b"
    assert [r.labels.get("__error__") for r in run(logs, '{app="a"} | logfmt | v > 1s')] == ["LabelFilterErr"]


def test_ip_filters(logs):
    assert len(run(logs, '{app="b"} |= ip("192.168.0.0/16")')) == 1
    assert len(run(logs, '{app="b"} |= ip("::1")')) == 1
    assert len(run(logs, '{app="b"} != ip("192.168.1.1-192.168.1.10")')) == 2


def test_errors_fail_metric_queries(logs):
    with pytest.raises(Exception, match="JSONParserErr"):
        run(logs, 'count_over_time({app="a"} | json [1m])')
    assert len(run(logs, 'count_over_time({app="a"} | json | __error__="" [100s])', end=100 * S, step=100 * S)) == 1


def test_units(spark):
    df = spark.createDataFrame([("1h30m",), ("2ms",), ("x",), ("1.5KiB",), ("200",)], "t string")
    got = df.select(seconds_of(F.col("t")).alias("s"), bytes_of(F.col("t")).alias("b")).collect()
    assert [r.s for r in got] == [5400.0, 0.002, None, None, None]
    assert [r.b for r in got] == [None, None, None, 1536.0, 200.0]
    assert duration_ns("1d2h") == 26 * 3600 * S
    with pytest.raises(ValueError):
        duration_ns("5 m")


@pytest.mark.parametrize(
    ("template", "expected"),
    [
        ("{{.a}}-{{.none}}", "Xy-"), ('{{ .a | lower | replace "x" "q" }}', "qy"), ('{{ if hasPrefix "X" .a }}yes{{ else }}no{{ end }}', "yes"), ("{{ add 1 .n 2 }}", "8"), ("{{ printf }}", None),
        ("{{ with .n }}<{{ . }}>{{ end }}", "<5>"), ("{{ .a | trunc 1 }}{{ alignRight 4 .n }}", "X   5"), ('{{ default "d" .none }}', "d"), ("{{ __line__ | len }}", "4"), ("a {{- .n -}} b", "a5b"), ("{{ range .a }}{{ end }}", None), ('{{ .a | b64enc }}', "WHk="), ('{{ regexReplaceAll "(y)" .a "${1}${1}" }}', "Xyy"),
    ],
)
def test_templates(spark, template, expected):
    df = spark.createDataFrame([("line", {"a": "Xy", "n": "5"})], "line string, bag map<string,string>")
    field = lambda n: F.coalesce(F.element_at("bag", n), F.lit(""))
    if expected is None:
        with pytest.raises(TemplateError):
            compile_template(template, field, F.col("line"), F.lit(0))
    else:
        assert df.select(compile_template(template, field, F.col("line"), F.lit(0)).alias("x")).first().x == expected


@pytest.mark.parametrize("query", ['{a="b"', '{a="b"} | unwrap x | json', 'sum_over_time({a="b"}[5m])', 'count_over_time({a="b"} | unwrap x [5m])', 'rate({a="b"}[5m]) by (x)', '{a="b"} | regexp "x"', "nothing"])
def test_refused(spark, logs, query):
    with pytest.raises(QueryError):
        LogPlanner(logs, Grid(0, S, S)).run(query)


def test_pattern_captures():
    names = []
    assert pattern_regex("<ip> - <_> [<t>]", names) and names == ["ip", "t"]
    assert parse('{a="b"} |= "x" or "y"').stages[0][2] == (("text", "x"), ("text", "y"))


def _stages(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_large_limits_take_no_single_task(spark, monkeypatch):
    logs = as_logs(spark.range(3000), {"app": F.lit("a")}, F.expr("(id div 7) * 1000003"), F.concat(F.lit("k="), (F.col("id") * 7919 % 3000).cast("string")))
    planner = LogPlanner(logs, Grid(0, 10 * S, S))
    rows = lambda n, backward: [(r.ts, r.line) for r in planner.run('{app="a"} | logfmt | k >= 500', n, backward).collect()]
    whole = {b: rows(1 << 30, b) for b in (True, False)}
    assert "TakeOrdered" not in _stages(planner.run('{app="a"}', 1 << 30)) and "TakeOrdered" in _stages(planner.run('{app="a"}', 900))
    assert len(whole[True]) == 2500 and whole[False] != whole[True]
    for backward in (True, False):
        assert whole[backward] == sorted(whole[backward], key=lambda r: (-r[0] if backward else r[0], r[1]))
        assert rows(900, backward) == whole[backward][:900]  # one task takes them
    monkeypatch.setattr(logql, "MOST_TOP", 4)
    monkeypatch.setattr(logql, "SLICES", 3)
    for task_rows in (100, 10_000):  # 3 slices of 1,000: Spark's sort, and slices dealt to tasks
        monkeypatch.setattr(logql, "TASK_ROWS", task_rows)
        for n in (5, 900, 2499, 2700):
            assert rows(n, n % 2 == 0) == whole[n % 2 == 0][:n]
    monkeypatch.setattr(logql, "SLICES", 4096)
    monkeypatch.setattr(logql, "TASK_ROWS", 100)
    for backward in (True, False):
        assert rows(1 << 30, backward) == whole[backward]
        assert planner.run('{app="a"}', 1 << 30, backward).rdd.getNumPartitions() > 20 and "SinglePartition" not in _stages(planner.run('{app="a"}', 1 << 30, backward))
    assert planner.run('{app="b"}', 1 << 30).collect() == []
