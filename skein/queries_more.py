"""Further registered queries, for what `queries` does not reach: native histograms, contexts, templates, ingest, trace lookups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .api import Engine
from .functions import native_histogram as nh
from .functions.labels import labels_of, value_of
from .operators import discovery, errors, rollups, rule_files
from .plans.grid import Grid
from .plans.logql import LogPlanner
from .plans.promql import MetricPlanner
from .plans.traceql import TracePlanner, metric_window, neighbourhood
from .queries import _C, _E, _I, _IT, _L, _LR, _RR, _T, DAY, GRID, ORACLES, ORIGIN, QUERIES, G, _flat, _s, _w, log_lines, log_metric, metric, prom_histogram_rows, trace_spans
from .sources import ingest
from .sources.tables import conversation_spans, event_logs, event_samples, table

_ALL = '{event_type=~".+"}'
H12 = DAY // 2


def add(name: str, run, sql: str | None) -> None:
    QUERIES[name] = run
    if sql:
        ORACLES[name] = sql


# -- metric language

_NOW = f"{_I} || SELECT event_type, step, value AS v FROM i"
metric("prom_quoted_name", f'{{"{_E}"}}', _NOW)
metric("prom_sort", f"sort_desc({_E})", _NOW)
metric("prom_sort_by_label", f'sort_by_label({_E}, "event_type")', _NOW)
metric("prom_context", "(end() - start()) / step() + range() / step() + min_of(1, 2) + max_of(3, 4)", f"{G} || SELECT step, 2 * {(GRID.end - GRID.start) // GRID.step} + 5 AS v FROM g", ())
metric("prom_duration_expression", f"sum_over_time({_E}[step() * 2])", f"{_w(DAY)} || SELECT event_type, step, sum(value) AS v FROM w GROUP BY event_type, step")
metric("prom_offset_expression", f"count_over_time({_E}[min_of(1d, range())] offset (step() + 6h))", f"{_w(DAY, 18 * 3600 * 10**9)} || SELECT event_type, step, count(*) AS v FROM w GROUP BY event_type, step")
metric("prom_ts_of_min_over_time", f"ts_of_min_over_time({_E}[1d])", f"{_w(DAY)} || SELECT event_type, step, arg_min(ts, value) / 1e9 AS v FROM (SELECT * FROM w QUALIFY value > min(value) OVER (PARTITION BY event_type, step) OR ts = max(ts) OVER (PARTITION BY event_type, step, value)) GROUP BY event_type, step")
metric("prom_ts_of_last_over_time", f"ts_of_last_over_time({_E}[1d])", f"{_w(DAY)} || SELECT event_type, step, max(ts) / 1e9 AS v FROM w GROUP BY event_type, step")
metric("prom_coalesced", f'label_replace({_E}{{event_type="view"}} offset 0s, "event_type", "same", "", "")', f"{_I} || SELECT 'same' AS event_type, step, value AS v FROM i WHERE event_type = 'view'")
ORACLES["prom_double_exponential_smoothing"] = f"""WITH RECURSIVE {_w(DAY)}, q AS (SELECT event_type, step, value, row_number() OVER (PARTITION BY event_type, step ORDER BY ts) AS rn FROM w),
    c(event_type, step, rn, level, last, trend) AS (SELECT event_type, step, rn, value, 0.0::DOUBLE, 0.0::DOUBLE FROM q WHERE rn = 1
        UNION ALL SELECT event_type, step, rn, 0.3 * value + 0.7 * (level + t), level, t FROM (SELECT q.event_type, q.step, q.rn, q.value, c.level, CASE WHEN c.rn = 1 THEN q.value - c.level ELSE 0.6 * (c.level - c.last) + 0.4 * c.trend END AS t FROM c JOIN q ON q.event_type = c.event_type AND q.step = c.step AND q.rn = c.rn + 1))
    SELECT event_type, CAST(step / 1000000000 AS BIGINT) AS step_s, round(level, 6) + 0.0 AS value FROM c WHERE rn > 1 QUALIFY row_number() OVER (PARTITION BY event_type, step ORDER BY rn DESC) = 1"""
_BREACH = "q.v > 66"
ORACLES["alert_lifecycle"] = f"""WITH RECURSIVE {_w(DAY)}, a AS (SELECT event_type AS key, step, count(*) AS v FROM w GROUP BY ALL), q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY step) AS rn FROM a),
    c(key, rn, step, state, since, seen) AS (SELECT key, rn, step, CASE WHEN {_BREACH} THEN 'pending' ELSE 'inactive' END, CASE WHEN {_BREACH} THEN step ELSE 0 END, CASE WHEN {_BREACH} THEN step ELSE 0 END FROM q WHERE rn = 1
        UNION ALL SELECT q.key, q.rn, q.step,
            CASE WHEN {_BREACH} THEN CASE WHEN c.state IN ('inactive', 'resolved') THEN 'pending' WHEN c.state = 'pending' AND q.step - c.since < {H12} THEN 'pending' ELSE 'firing' END
                 WHEN c.state IN ('firing', 'recovering') THEN CASE WHEN q.step - c.seen < {H12} THEN 'recovering' ELSE 'resolved' END ELSE 'inactive' END,
            CASE WHEN {_BREACH} AND c.state IN ('inactive', 'resolved') THEN q.step WHEN {_BREACH} OR c.state IN ('firing', 'recovering') THEN c.since ELSE 0 END,
            CASE WHEN {_BREACH} THEN q.step WHEN c.state IN ('firing', 'recovering') THEN c.seen ELSE 0 END
        FROM c JOIN q ON q.key = c.key AND q.rn = c.rn + 1)
    SELECT key, CAST(step / 1000000000 AS BIGINT) AS step_s, state FROM c"""

_HB = f"{_w(DAY)}, b AS (SELECT event_type, step, count(*) FILTER (value <= 10) AS c1, count(*) FILTER (value <= 50) AS c2, count(*) FILTER (value <= 100) AS c3, count(*) AS n FROM w GROUP BY event_type, step)"


def _classic(query: str, names: list[str]):
    return lambda spark, sf_dir: _flat(MetricPlanner(prom_histogram_rows(spark, sf_dir), GRID, DAY).run(query), names)


_HQ = "CASE WHEN c1 >= {q} * n THEN 10 * {q} * n / c1 WHEN c2 >= {q} * n THEN 10 + 40 * ({q} * n - c1) / (c2 - c1) WHEN c3 >= {q} * n THEN 50 + 50 * ({q} * n - c2) / (c3 - c2) ELSE 100 END"
add("prom_histogram_quantiles", _classic(f'histogram_quantiles(sum_over_time({_E}[1d]), "q", 0.5, 0.9)', ["event_type", "q"]), f"WITH {_HB} " + " UNION ALL ".join(f"SELECT event_type, '{q}' AS q, CAST(step / 1000000000 AS BIGINT) AS step_s, round({_HQ.format(q=q)}, 6) + 0.0 AS value FROM b" for q in (0.5, 0.9)))
add("prom_histogram_fraction", _classic(f"histogram_fraction(10, 75, sum_over_time({_E}[1d]))", ["event_type"]), f"WITH {_HB} SELECT event_type, CAST(step / 1000000000 AS BIGINT) AS step_s, round((c2 + (c3 - c2) * 0.5 - c1) / n, 6) + 0.0 AS value FROM b")


def native_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of each event type and half day as a native histogram of powers of two."""
    s = event_samples(spark, sf_dir)
    none = F.create_map().cast("map<int,double>")
    i = F.ceil(F.log2(F.greatest("value", F.lit(1e-9)))).cast("int")
    small = F.col("value") <= 0.001
    one = nh.struct(F.lit(0), F.lit(0.001), F.when(small, 1.0).otherwise(0.0), F.lit(1.0), F.col("value"), F.when(small, none).otherwise(F.create_map(i, F.lit(1.0))), none)
    end = F.col("ts") - 1 - F.pmod(F.col("ts") - 1, F.lit(H12)) + H12
    rows = nh.summed(s.select("key", end.alias("ts"), one.alias("h")), ["key", "ts"])
    return rows.select(labels_of(F.col("key")).alias("labels"), "key", "ts", F.lit(None).cast("double").alias("value"), F.lit(False).alias("stale"), "h")


def native(name: str, query: str, value: str, names: tuple[str, ...] = ("event_type",), more: str = "") -> None:
    """value: an aggregate over w by the names and the step, or over `more`, CTEs that end in one named x."""
    by = "".join(f"{n}, " for n in names)
    sql = f"WITH {_w(DAY)}{more} SELECT {by}CAST(step / 1000000000 AS BIGINT) AS step_s, round(CAST({value} AS DOUBLE), 6) + 0.0 AS value FROM {'x' if more else 'w'}" + ("" if more else f" GROUP BY {by}step")
    add(name, lambda spark, sf_dir: _flat(MetricPlanner(native_samples(spark, sf_dir), GRID, DAY).run(query), list(names)), sql)


_D = f"sum_over_time({_E}[1d])"
native("prom_native_count", f"histogram_count({_D})", "count(*)")
native("prom_native_sum", f"histogram_sum(sum({_D}))", "sum(value)", ())
native("prom_native_avg", f"histogram_avg({_D})", "avg(value)")
native("prom_native_trim", f"histogram_count({_D} </ 16) + histogram_count({_D} >/ 64)", "count(*) FILTER (value <= 16 OR value > 64)")
native("prom_native_scaled", f"histogram_count({_D} * 2 - {_D} / 2)", "1.5 * count(*)")
native("prom_native_windows", f"count_over_time({_E}[1d])", "count(DISTINCT ts_end)", more=f", y AS (SELECT event_type, step, (ts - 1) - (ts - 1) % {H12} + {H12} AS ts_end FROM w), x AS (SELECT event_type, step, count(DISTINCT ts_end) AS c FROM y GROUP BY ALL)")
ORACLES["prom_native_windows"] = ORACLES["prom_native_windows"].replace("CAST(count(DISTINCT ts_end) AS DOUBLE)", "CAST(c AS DOUBLE)")
_NB = ", b AS (SELECT event_type, step, pow(2, ceil(log2(value))) AS high, count(*) AS n FROM w WHERE value > 0.001 GROUP BY ALL), z AS (SELECT event_type, step, count(*) AS total, avg(value) AS mean, count(*) FILTER (value <= 0.001) AS small FROM w GROUP BY ALL)"
native("prom_native_stdvar", f"histogram_stdvar({_D})", "v", more=f"{_NB}, x AS (SELECT event_type, step, (coalesce((SELECT sum(n * pow(sqrt(high * high / 2) - mean, 2)) FROM b WHERE b.event_type = z.event_type AND b.step = z.step), 0) + small * mean * mean) / total AS v FROM z)")
native("prom_native_query_quantile", f"histogram_quantile(0.9, {_D})", "v", more=f"{_NB}, c AS (SELECT b.event_type, b.step, high, n, total, sum(n) OVER (PARTITION BY b.event_type, b.step ORDER BY high) + small AS seen FROM b JOIN z ON z.event_type = b.event_type AND z.step = b.step), x AS (SELECT event_type, step, high / 2 * pow(2, (0.9 * total - (seen - n)) / n) AS v FROM c WHERE seen >= 0.9 * total QUALIFY row_number() OVER (PARTITION BY event_type, step ORDER BY high) = 1)")


def prom_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    planner = MetricPlanner(event_samples(spark, sf_dir), GRID, DAY)
    planner.run(f"quantile(1.5, rate({_E}[1d]))")
    return planner.annotations()


add("prom_annotations", prom_annotations, "SELECT * FROM (VALUES ('info', 'metric might not be a counter, name does not end in _total/_sum/_count/_bucket: \"events_value\"'), ('warning', 'quantile value should be between 0 and 1, got 1.5')) v(kind, message)")

# -- log language

log_metric("log_unwrap_rate", f"sum by (event_type) (rate({_ALL} | logfmt | unwrap bytes(size) [1d]))", "SELECT event_type, step, sum(user_id * 100) / 86400.0 AS v FROM w GROUP BY event_type, step", digits=9)
log_metric("log_approx_topk", f"approx_topk(2, sum by (event_type) (count_over_time({_ALL}[1d])))", "SELECT event_type, step, v FROM (SELECT event_type, step, count(*) AS v FROM w GROUP BY event_type, step) QUALIFY row_number() OVER (PARTITION BY step ORDER BY v DESC, event_type) <= 2")
log_metric("log_sort", f"sort_desc(sum by (event_type) (count_over_time({_ALL}[1d])))", "SELECT event_type, step, count(*) AS v FROM w GROUP BY event_type, step")
log_metric("log_label_replace", f'label_replace(sum by (event_type) (count_over_time({_ALL}[1d])), "kind", "$1!", "event_type", "(..).*")', "SELECT event_type, concat(substr(event_type, 1, 2), '!') AS kind, step, count(*) AS v FROM w GROUP BY ALL", ("event_type", "kind"))
log_metric("log_div_by_zero", f"sum(count_over_time({_ALL}[1d])) / (sum(count_over_time({_ALL}[1d])) * 0)", "SELECT step, 'NaN'::DOUBLE AS v FROM w GROUP BY step", ())
log_metric("log_offset", f"sum by (event_type) (count_over_time({_ALL}[1d] offset 12h))", f"SELECT l.event_type, g.step, count(*) AS v FROM g JOIN l ON l.ts > g.step - {DAY + H12} AND l.ts <= g.step - {H12} GROUP BY ALL")
log_lines("log_error_model", f'{_ALL} | json | __error__="JSONParserErr"', "SELECT event_type, 'JSONParserErr' AS __error__, ts, line FROM r", ("event_type", "__error__"))
log_metric("log_rate_counter", f"rate_counter({_ALL} | logfmt | keep event_type, took | unwrap duration(took) [1d])", f"""WITH s AS (SELECT event_type, ts, CAST(event_id % 500 AS DOUBLE) / 1000 AS value FROM l), {_C}, y AS (SELECT g.step, c.* FROM g JOIN c ON c.ts > g.step - {DAY} AND c.ts <= g.step),
    q AS (SELECT event_type, step, arg_max(value, ts) - arg_min(value, ts) + arg_max(lost, ts) - arg_min(lost, ts) AS gain, arg_min(value, ts) AS a, (max(ts) - min(ts)) / 1e9 AS span, count(*) AS n, (min(ts) - (step - {DAY})) / 1e9 AS l0, (step - max(ts)) / 1e9 AS r0 FROM y GROUP BY event_type, step),
    e AS (SELECT *, CASE WHEN l0 >= 1.1 * span / (n - 1) THEN span / (n - 1) / 2 ELSE l0 END AS l1, CASE WHEN r0 >= 1.1 * span / (n - 1) THEN span / (n - 1) / 2 ELSE r0 END AS r1 FROM q)
    SELECT event_type, step, CASE WHEN n < 2 THEN 0 ELSE gain * (span + CASE WHEN gain > 0 AND a >= 0 THEN least(l1, span * a / gain) ELSE l1 END + r1) / span / 86400 END AS v FROM e""", digits=9)

_U = "CAST(user_id AS VARCHAR)"


def template(name: str, text: str, sql: str, line=None) -> None:
    """line_format after logfmt, against a SQL text of the same fields."""
    log_lines(f"log_template_{name}", f"{_ALL} | logfmt | line_format `{text}`", f"SELECT event_type, ts, {sql} AS line FROM r", line=line)


template("trim", '{{ .level | upper | trimPrefix "I" }}-{{ trimSuffix "o" .level | title }}-{{ trimAll "e" .level }}', "concat(CASE WHEN level = 'info' THEN 'NFO' ELSE upper(level) END, '-', CASE level WHEN 'info' THEN 'Inf' WHEN 'warn' THEN 'Warn' ELSE 'Error' END, '-', trim(level, 'e'))")
template("pad", '{{ alignLeft 6 .level }}|{{ alignRight 6 .level }}|{{ trunc 2 .level }}|{{ substr 1 3 .level }}|{{ repeat 2 .user }}|{{ .level | replace "r" "l" }}', f"concat(rpad(level, 6, ' '), '|', lpad(level, 6, ' '), '|', substr(level, 1, 2), '|', substr(level, 2, 2), '|', {_U}, {_U}, '|', replace(level, 'r', 'l'))")
template("replace_n", '{{ Replace .ip "." "_" 2 }} {{ Replace .ip "." "$1" -1 }}', "concat('10_0_', user_id % 4, '.7 10$10$1', user_id % 4, '$17')")
template("test", '{{ contains "arn" .level }} {{ hasPrefix "e" .level }} {{ hasSuffix "o" .level }} {{ count "r" .level }} {{ len .level }}', "concat(contains(level, 'arn'), ' ', starts_with(level, 'e'), ' ', ends_with(level, 'o'), ' ', len(level) - len(replace(level, 'r', '')), ' ', len(level))")
template("encoding", "{{ .msg | urlencode }} {{ .msg | b64enc }} {{ .msg | b64enc | b64dec }} {{ html \"<a&b>\" }}", "'got+it Z290IGl0 got it &lt;a&amp;b&gt;'")
template("int", "{{ add .user 3 }} {{ sub .user 1 }} {{ mul .user 2 }} {{ div .user 7 }} {{ mod .user 7 }} {{ min .user 5 }} {{ max .user 5 }}", "concat(user_id + 3, ' ', user_id - 1, ' ', user_id * 2, ' ', user_id // 7, ' ', user_id % 7, ' ', least(user_id, 5), ' ', greatest(user_id, 5))")
template("float", "{{ round (divf .user 8) 2 | mulf 100 | int }} {{ floor (divf .user 2) | int }} {{ ceil (divf .user 2) | int }} {{ addf .user 0.5 | mulf 2 | int }}", "concat(CAST(floor(floor(user_id / 8 * 100 + 0.5) / 100 * 100) AS BIGINT), ' ', user_id // 2, ' ', (user_id + 1) // 2, ' ', user_id * 2 + 1)")
template("units", "{{ bytes .size | int }} {{ duration_seconds .took | mulf 1000 | int }}", "concat(user_id * 100, ' ', CAST(floor(CAST(event_id % 500 AS DOUBLE) / 1000 * 1000) AS BIGINT))")
template("logic", '{{ if and (eq .level "info") (gt .user 9) }}a{{ else if or (eq .level "warn") (not .nothing) }}b{{ end }}{{ default "none" .nothing }}', "concat(CASE WHEN level = 'info' AND user_id > 9 THEN 'a' ELSE 'b' END, 'none')")
template("regex", '{{ regexReplaceAll "10[.]([0-9]+)" .ip "<${1}>" }} {{ regexReplaceAllLiteral "[0-9]+" .user "$1" }}', "concat('<0>.', user_id % 4, '.7 $1')")
template("entry", "{{ len __line__ }} {{ __timestamp__ | unixEpoch }} {{ __timestamp__ | unixEpochMillis }} {{ print .user .level }}", f"concat(len(line), ' ', ts // 1000000000, ' ', ts // 1000000, ' ', {_U}, level)")
log_lines("log_template_loop", f"{_ALL} | line_format `{{{{ range $k, $v := fromJson __line__ }}}}{{{{ if gt $v 50 }}}}{{{{ continue }}}}{{{{ end }}}}{{{{ $k }}}}={{{{ $v }}}};{{{{ end }}}}`", "SELECT event_type, ts, CASE WHEN CAST(json_extract_string(props, '$.k') AS INT) > 50 THEN '' ELSE concat('k=', json_extract_string(props, '$.k'), ';') END AS line FROM r", line=lambda: F.col("props"))
template("index", '{{ index . "level" }} {{ slice .level 1 3 }} {{ js "a\'b" }}', "concat(level, ' ', substr(level, 2, 2), ' a\\''b')")

# -- traces

trace_spans("trace_chain", '{ name = "user" } > { name = "assistant" } > { name = "user" }', "SELECT DISTINCT c.trace, c.id, c.name FROM t c JOIN t b ON b.trace = c.trace AND b.id = c.parent JOIN t a ON a.trace = b.trace AND a.id = b.parent WHERE c.name = 'user' AND b.name = 'assistant' AND a.name = 'user'")
_HITS = "SELECT trace, id, parent, CAST(id AS INT) AS k FROM t WHERE trace = '5' AND name = 'user'"
add("trace_neighbourhood", lambda spark, sf_dir: neighbourhood(conversation_spans(spark, sf_dir), "5", '{ name = "user" }', 1, 1).select("trace", "id", "name"), f"WITH {_T}, h AS ({_HITS}) SELECT trace, id, name FROM t WHERE trace = '5' AND (id IN (SELECT id FROM h) OR parent IN (SELECT id FROM h) OR id IN (SELECT parent FROM h))")
add("trace_find", lambda spark, sf_dir: TracePlanner(conversation_spans(spark, sf_dir)).find(service="front", min_duration=300_000_000, resource={"region": "r1"}).select("trace", "id", "name"), f"WITH {_T} SELECT trace, id, name FROM t WHERE service = 'front' AND \"end\" - start >= 300000000 AND region = 'r1'")
add("trace_find_newest", lambda spark, sf_dir: TracePlanner(conversation_spans(spark, sf_dir)).find(root_only=True, start=ORIGIN, limit=7).select("trace", "id", "start"), f"WITH {_T} SELECT trace, id, start FROM t WHERE parent IS NULL ORDER BY start DESC, trace, id LIMIT 7")
_WE = ORIGIN + 2 * 3600 * 10**9
add("trace_window_search", lambda spark, sf_dir: TracePlanner(conversation_spans(spark, sf_dir)).window_search("{ status = error }", ORIGIN, _WE, 10), f"WITH {_T}, l AS (SELECT * FROM t WHERE start >= {ORIGIN} AND start <= {_WE}), m AS (SELECT trace, count(*) AS matching_spans FROM l WHERE status = 2 GROUP BY trace) SELECT trace, min(start) AS start, max(\"end\") AS \"end\", max(\"end\") - min(start) AS duration, count(*) AS stored_spans, any_value(matching_spans) AS matching_spans, (SELECT count(*) FROM m) AS matched_traces FROM l JOIN m USING (trace) GROUP BY trace ORDER BY start DESC, trace LIMIT 10")


def trace_integrity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over conversations whose second turns have lost their parent: traces with two roots."""
    spans = conversation_spans(spark, sf_dir).withColumn("parent", F.when(F.col("id") != "1", F.col("parent")))
    return TracePlanner(spans).integrity("{ status = error }")


add("trace_integrity", trace_integrity, f"WITH {_T} SELECT trace, 'trace_root_conflict' AS problem FROM t GROUP BY trace HAVING count(*) FILTER (id IN ('0', '1')) > 1 AND count(*) FILTER (status = 2) > 0")
_MW = metric_window(ORIGIN + 7 * 10**9, ORIGIN + 6 * 3600 * 10**9)


def trace_default_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = Engine(spans=conversation_spans(spark, sf_dir)).trace_metrics("{} | count_over_time()", ORIGIN + 7 * 10**9, ORIGIN + 6 * 3600 * 10**9)
    return out.select((F.col("step") / 10**9).cast("long").alias("step_s"), "value")


add("trace_default_window", trace_default_window, f"WITH {_T}, k AS (SELECT unnest(range(0, {_MW.count - 1})) AS i) SELECT CAST(({_MW.start} + (k.i + 1) * {_MW.step}) // 1000000000 AS BIGINT) AS step_s, CAST(count(t.id) AS DOUBLE) AS value FROM k LEFT JOIN t ON t.start > {_MW.start} AND t.start <= {_MW.end} AND (t.start - {_MW.start} - 1) // {_MW.step} = k.i GROUP BY k.i")

# -- ingest: payloads made of events come back as rows


def _payloads(spark: SparkSession, sf_dir: str, body: Column) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("ns", F.unix_micros(F.col("ts").cast("timestamp")) * 1000)
    return e.select(F.to_json(body).alias("payload"))


def _attribute(name: str, value: Column, kind: str = "stringValue") -> Column:
    return F.struct(F.lit(name).alias("key"), F.struct(value.alias(kind)).alias("value"))


def _resource(*pairs: Column) -> Column:
    return F.struct(F.array(*pairs).alias("attributes"))


def ingest_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    meta = F.to_json(F.struct(F.col("user_id").cast("string").alias("user")))
    value = F.array(F.col("ns").cast("string"), F.col("props"), meta)
    body = F.struct(F.array(F.struct(F.struct("event_type").alias("stream"), F.array(value).alias("values"))).alias("streams"))
    out = ingest.stream_push(_payloads(spark, sf_dir, body))
    return out.select(value_of(F.col("stream"), "event_type").alias("event_type"), value_of(F.col("meta"), "user").alias("user"), "ts", "line")


add("ingest_streams", ingest_streams, "SELECT event_type, CAST(user_id AS VARCHAR) AS \"user\", epoch_ns(ts) AS ts, props AS line FROM events")


def ingest_remote_write(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = F.array(F.struct(F.lit("name").alias("name"), F.lit("x").alias("value")), F.struct(F.lit("event_type").alias("name"), F.col("event_type").alias("value")))
    sample = F.struct("value", F.call_function("div", F.col("ns"), F.lit(1_000_000).cast("long")).alias("timestamp"), (F.col("event_id") % 9 == 0).alias("stale"))
    body = F.struct(F.array(F.struct(labels.alias("labels"), F.array(sample).alias("samples"))).alias("timeseries"))
    return ingest.remote_write(_payloads(spark, sf_dir, body)).select(value_of(F.col("labels"), "event_type").alias("event_type"), "ts", "value", "stale")


add("ingest_remote_write", ingest_remote_write, "SELECT event_type, epoch_ns(ts) // 1000000 * 1000000 AS ts, value, event_id % 9 = 0 AS stale FROM events")


def ingest_otlp_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    record = F.struct(F.col("ns").cast("string").alias("timeUnixNano"), F.upper("event_type").alias("severityText"), F.struct(F.col("props").alias("stringValue")).alias("body"), F.array(_attribute("user", F.col("user_id").cast("string"), "intValue")).alias("attributes"))
    body = F.struct(F.array(F.struct(_resource(_attribute("service.name", F.col("event_type"))).alias("resource"), F.array(F.struct(F.array(record).alias("logRecords"))).alias("scopeLogs"))).alias("resourceLogs"))
    out = ingest.otlp_logs(_payloads(spark, sf_dir, body))
    return out.select(value_of(F.col("stream"), "service_name").alias("service"), value_of(F.col("meta"), "user").alias("user"), value_of(F.col("meta"), "level").alias("level"), "ts", "line")


add("ingest_otlp_logs", ingest_otlp_logs, "SELECT event_type AS service, CAST(user_id AS VARCHAR) AS \"user\", lower(event_type) AS level, epoch_ns(ts) AS ts, props AS line FROM events")


def _otlp_metric(metric_: Column) -> Column:
    return F.struct(F.array(F.struct(_resource(_attribute("service.name", F.col("event_type"))).alias("resource"), F.array(F.struct(F.array(metric_).alias("metrics"))).alias("scopeMetrics"))).alias("resourceMetrics"))


def ingest_otlp_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    point = F.struct(F.col("ns").cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"))
    total = F.struct(F.lit("http.requests").alias("name"), F.struct(F.array(point).alias("dataPoints"), F.lit(True).alias("isMonotonic"), F.lit(2).alias("aggregationTemporality")).alias("sum"))
    out = ingest.otlp_metrics(_payloads(spark, sf_dir, _otlp_metric(total)))
    return out.select(value_of(F.col("labels"), "__name__").alias("name"), value_of(F.col("labels"), "job").alias("job"), "ts", "value")


add("ingest_otlp_sums", ingest_otlp_sums, "SELECT 'http_requests_total' AS name, event_type AS job, epoch_ns(ts) AS ts, value FROM events")


def _histogram_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A histogram of one observation for each event, with an exemplar."""
    count = lambda low, high: F.when((F.col("value") > low) & (F.col("value") <= high), "1").otherwise("0")
    inf = float("inf")
    exemplar = F.struct(F.col("ns").cast("string").alias("timeUnixNano"), F.col("value").alias("asDouble"), F.hex("event_id").alias("traceId"))
    point = F.struct(F.col("ns").cast("string").alias("timeUnixNano"), F.lit("1").alias("count"), F.col("value").alias("sum"), F.array(count(-inf, 10.0), count(10.0, 50.0), count(50.0, inf)).alias("bucketCounts"), F.array(F.lit(10.0), F.lit(50.0)).alias("explicitBounds"), F.array(exemplar).alias("exemplars"))
    return _payloads(spark, sf_dir, _otlp_metric(F.struct(F.lit("took").alias("name"), F.struct(F.array(point).alias("dataPoints")).alias("histogram"))))


def ingest_otlp_histograms(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.otlp_metrics(_histogram_payloads(spark, sf_dir))
    return out.groupBy(value_of(F.col("labels"), "__name__").alias("name"), value_of(F.col("labels"), "le").alias("le"), value_of(F.col("labels"), "job").alias("job")).agg(F.round(F.sum("value"), 6).alias("value"))


add("ingest_otlp_histograms", ingest_otlp_histograms, "SELECT 'took_bucket' AS name, le, event_type AS job, CAST(sum(CASE WHEN value <= b THEN 1 ELSE 0 END) AS DOUBLE) AS value FROM events CROSS JOIN (VALUES ('10', 10.0), ('50', 50.0), ('+Inf', 1e300)) x(le, b) GROUP BY ALL UNION ALL SELECT 'took_count', '', event_type, CAST(count(*) AS DOUBLE) FROM events GROUP BY ALL UNION ALL SELECT 'took_sum', '', event_type, round(sum(value), 6) FROM events GROUP BY ALL")


def ingest_exemplars(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = ingest.otlp_exemplars(_histogram_payloads(spark, sf_dir))
    return out.select(value_of(F.col("labels"), "le").alias("le"), value_of(F.col("labels"), "job").alias("job"), value_of(F.col("exemplar"), "trace_id").alias("trace_id"), "ts", "value")


add("ingest_exemplars", ingest_exemplars, "SELECT CASE WHEN value <= 10 THEN '10' WHEN value <= 50 THEN '50' ELSE '+Inf' END AS le, event_type AS job, hex(event_id) AS trace_id, epoch_ns(ts) AS ts, value FROM events")


def ingest_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    span = F.struct(F.hex("event_id").alias("traceId"), F.lit("1").alias("spanId"), F.lit("").alias("parentSpanId"), F.col("event_type").alias("name"), F.lit(2).alias("kind"), F.col("ns").cast("string").alias("startTimeUnixNano"), (F.col("ns") + 5).cast("string").alias("endTimeUnixNano"), F.array(_attribute("user", F.col("user_id").cast("string"))).alias("attributes"))
    body = F.struct(F.array(F.struct(_resource(_attribute("service.name", F.lit("shop"))).alias("resource"), F.array(F.struct(F.array(span).alias("spans"))).alias("scopeSpans"))).alias("resourceSpans"))
    out = ingest.otlp_spans(_payloads(spark, sf_dir, body))
    return out.select("trace", "id", "parent", "name", "service", "start", "end", value_of(F.col("attrs"), "user").alias("user"))


add("ingest_spans", ingest_spans, "SELECT hex(event_id) AS trace, '1' AS id, CAST(NULL AS VARCHAR) AS parent, event_type AS name, 'shop' AS service, epoch_ns(ts) AS start, epoch_ns(ts) + 5 AS \"end\", CAST(user_id AS VARCHAR) AS \"user\" FROM events")


def ingest_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    message = F.concat(F.lit("token="), F.col("user_id").cast("string"), F.lit(" refused"))
    body = F.struct((F.col("ns") / F.lit(1e9)).alias("timestamp"), F.lit("p").alias("project"), F.struct(F.array(F.struct(F.col("event_type").alias("type"), message.alias("value"))).alias("values")).alias("exception"))
    out = ingest.error_events(_payloads(spark, sf_dir, body))
    return out.groupBy("project", "kind", "message").agg(F.count("*").alias("n"))


add("ingest_errors", ingest_errors, "SELECT 'p' AS project, event_type AS kind, 'token=[masked] refused' AS message, count(*) AS n FROM events GROUP BY ALL")

# -- discovery, rollups, rules


def metric_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("metric"), F.lit("gauge").alias("type"), F.concat(F.lit("h"), F.col("user_id") % 12).alias("help"), F.lit("").alias("unit"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"))
    return discovery.metric_metadata(rows, GRID.end).select("metric", "help", "ts")


add("metric_metadata", metric_metadata, f"SELECT * FROM (SELECT event_type AS metric, concat('h', user_id % 12) AS help, max(epoch_ns(ts)) AS ts FROM events WHERE epoch_ns(ts) > {GRID.end - 30 * DAY} GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY metric ORDER BY ts DESC, help) <= 8")


def parity_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the least and the greatest value of a day differ."""
    sides = [_flat(MetricPlanner(event_samples(spark, sf_dir), GRID, DAY).run(f"{f}_over_time({_E}[1d])"), ["event_type"]) for f in ("min", "max")]
    return discovery.compare(*sides, ["event_type", "step_s"])


add("parity_compare", parity_compare, f"WITH {_w(DAY)}, c AS (SELECT event_type, CAST(step / 1000000000 AS BIGINT) AS step_s, round(min(value), 6) AS l, round(max(value), 6) AS r FROM w GROUP BY event_type, step) SELECT * FROM c WHERE l <> r")
_GRID3 = (GRID.start, GRID.end, GRID.step)


def rollup_routed_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log query that the minute rollup answers: there are no raw entries."""
    logs = event_logs(spark, sf_dir)
    e = Engine(logs=logs.filter(F.lit(False)), minutes=rollups.log_minutes(logs, with_meta=True))
    return _flat(e.log_query(f"sum by (team) (count_over_time({_ALL}[1d]))", *_GRID3), ["team"])


add("rollup_routed_logs", rollup_routed_logs, f"WITH {_L} SELECT team, CAST(step / 1000000000 AS BIGINT) AS step_s, CAST(count(*) AS DOUBLE) AS value FROM g JOIN l ON l.ts > g.step - {DAY} AND l.ts <= g.step GROUP BY team, step")


def rollup_routed_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A metric query that the hour rollup answers: there are no raw samples."""
    s = event_samples(spark, sf_dir)
    e = Engine(s.filter(F.lit(False)), hours=rollups.metric_hours(s))
    return _flat(e.metric_query(f"max by (event_type) (max_over_time({_E}[1d] offset 6h))", *_GRID3), ["event_type"])


add("rollup_routed_metrics", rollup_routed_metrics, f"WITH {_w(DAY, 6 * 3600 * 10**9)} SELECT event_type, CAST(step / 1000000000 AS BIGINT) AS step_s, round(max(value), 6) AS value FROM w GROUP BY event_type, step")
add("retained_rows", lambda spark, sf_dir: rollups.retained(event_samples(spark, sf_dir), GRID.start).select(value_of(F.col("labels"), "event_type").alias("event_type"), "ts", "value"), f"SELECT event_type, epoch_ns(ts) AS ts, value FROM events WHERE epoch_ns(ts) >= {GRID.start}")
_GRAPH = {"condition": "C", "data": [
    {"refId": "A", "datasourceUid": "metrics", "model": {"expr": f"sum by (event_type) (sum_over_time({_E}[1d]))"}}, {"refId": "R", "datasourceUid": "__expr__", "model": {"type": "reduce", "reducer": "last", "expression": "A"}},
    {"refId": "B", "datasourceUid": "__expr__", "model": {"type": "math", "expression": "$R / 10 - 1"}}, {"refId": "C", "datasourceUid": "__expr__", "model": {"type": "threshold", "expression": "B", "conditions": [{"evaluator": {"type": "gte", "params": [300]}}]}},
]}


def graph_preview(spark: SparkSession, sf_dir: str) -> DataFrame:
    samples = event_samples(spark, sf_dir)
    out = rule_files.preview(_GRAPH, lambda _, q: MetricPlanner(samples, GRID, DAY).run(q))
    return out.select(value_of(F.col("labels"), "event_type").alias("event_type"), "value")


add("graph_preview", graph_preview, f"{_RR} SELECT event_type, CAST(CASE WHEN v / 10 - 1 >= 300 THEN 1 ELSE 0 END AS DOUBLE) AS value FROM d")
_RULES = f'{{"groups": [{{"name": "g", "rules": [{{"record": "a:sum", "expr": "sum by (event_type) (sum_over_time({_E}[1d]))", "labels": {{"zone": "z"}}}}, {{"alert": "x", "expr": "up"}}]}}]}}'


def rule_import(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .operators import rules

    groups, _ = rule_files.import_rules(_RULES)
    out = rules.record_group(event_samples(spark, sf_dir), groups[0].rules, GRID.end)
    return out.select(value_of(F.col("labels"), "__name__").alias("metric"), value_of(F.col("labels"), "zone").alias("zone"), value_of(F.col("labels"), "event_type").alias("event_type"), F.round("value", 6).alias("value"))


add("rule_import", rule_import, f"{_RR} SELECT 'a:sum' AS metric, 'z' AS zone, event_type, round(v, 6) AS value FROM d")


def error_shapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").filter("event_type = 'error'")
    logs = e.select(F.concat(F.lit("s"), F.col("user_id") % 2).alias("service"), (F.unix_micros(F.col("ts").cast("timestamp")) * 1000).alias("ts"), F.concat(F.lit("user "), F.col("user_id").cast("string"), F.lit(" failed")).alias("line"), F.lit(True).alias("error"))
    out = errors.shape_windows(logs, GRID.end, baseline=30 * 60 * 24, current=5 * 60 * 24)
    return out.select("service", "sample", "baseline", "current")


_LO, _MID = GRID.end - 35 * 60 * 24 * 60 * 10**9, GRID.end - 5 * 60 * 24 * 60 * 10**9
add("error_shapes", error_shapes, f"WITH e AS (SELECT concat('s', user_id % 2) AS service, epoch_ns(ts) AS ts, concat('user ', user_id, ' failed') AS line FROM events WHERE event_type = 'error' AND epoch_ns(ts) >= {_LO} AND epoch_ns(ts) < {GRID.end}) SELECT service, min(line) AS sample, count(*) FILTER (ts < {_MID}) AS baseline, count(*) FILTER (ts >= {_MID}) AS current FROM e GROUP BY service")


def reliability_durations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans of the current and the baseline minutes by decade of their duration."""
    spans = conversation_spans(spark, sf_dir)
    logs = spans.select("service", F.col("start").alias("ts"), (F.col("status") == 2).alias("error"))
    out = errors.reliability_windows(errors.reliability_bins(logs, spans), ORIGIN + 40 * 60 * 10**9)
    rows = out.select("service", F.posexplode(F.arrays_zip("baseline_durations", "current_durations")).alias("bucket", "d"))
    return rows.select("service", "bucket", F.col("d.baseline_durations").alias("baseline"), F.col("d.current_durations").alias("current"))


_BUCKET = "least(5, greatest(0, CAST(ceil(log10(greatest(\"end\" - start, 1) / 1e6)) AS INT)))"
_FROM, _TO, _SPLIT = ORIGIN + 5 * 60 * 10**9, ORIGIN + 40 * 60 * 10**9, ORIGIN + 35 * 60 * 10**9
add("reliability_durations", reliability_durations, f"WITH {_T}, x AS (SELECT service, {_BUCKET} AS bucket, start - start % 60000000000 AS minute FROM t WHERE start >= {_FROM} AND start < {_TO}), k AS (SELECT service, CAST(b AS INT) AS bucket FROM (SELECT DISTINCT service FROM x) CROSS JOIN range(6) r(b)) SELECT k.service, k.bucket, count(x.minute) FILTER (x.minute < {_SPLIT}) AS baseline, count(x.minute) FILTER (x.minute >= {_SPLIT}) AS current FROM k LEFT JOIN x ON x.service = k.service AND x.bucket = k.bucket GROUP BY k.service, k.bucket")
