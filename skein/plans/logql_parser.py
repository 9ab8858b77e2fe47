"""Parser of the log language: selectors, pipelines, and metric queries over them."""

from __future__ import annotations

import re
from dataclasses import dataclass

from ..functions.units import BYTES, duration_ns
from .promql_parser import _LEVEL, Aggregate, Binary, Call, Negative, Number, QueryError, Stream, Text, _Parser, tokens_of, unquote


@dataclass(frozen=True)
class LogQuery:
    matchers: tuple[tuple[str, str, str], ...]
    stages: tuple[tuple, ...] = ()


@dataclass(frozen=True)
class RangeAggregate:
    op: str
    logs: LogQuery
    window: int
    offset: int = 0
    unwrap: tuple[str, str | None] | None = None
    param: object = None
    names: tuple[str, ...] = ()
    without: bool | None = None


NEEDS_UNWRAP = {"avg_over_time", "sum_over_time", "min_over_time", "max_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "first_over_time", "last_over_time", "rate_counter"}
NO_UNWRAP = {"bytes_rate", "bytes_over_time", "count_over_time", "approx_count_distinct"}
RANGE_OPS = NEEDS_UNWRAP | NO_UNWRAP | {"rate", "absent_over_time"}
_GROUPED = {"avg_over_time", "min_over_time", "max_over_time", "stddev_over_time", "stdvar_over_time", "quantile_over_time", "first_over_time", "last_over_time"}
VECTOR_OPS = {"sum", "avg", "min", "max", "count", "stddev", "stdvar", "topk", "bottomk", "approx_topk", "sort", "sort_desc"}
_FLAGS = {"--strict", "--keep-empty"}

_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<flag>--[a-z-]+)
    |(?P<duration>(?:\d+(?:\.\d+)?(?:ns|us|µs|ms|[smhdwy]))+)(?![\w.])
    |(?P<bytes>\d+(?:\.\d+)?(?i:[kmgtp]i?b|b))(?!\w)
    |(?P<number>\d+\.?\d*(?:[eE][+-]?\d+)?|\.\d+)
    |(?P<name>[A-Za-z_][\w:]*)
    |(?P<string>"(?:[^"\\]|\\.)*"|`[^`]*`)
    |(?P<op>\|=|\|~|\|>|!>|=~|!~|==|!=|<=|>=|[-+*/%^<>=(){}\[\],.|])""",
    re.VERBOSE,
)


class _LogParser(Stream):
    matching = _Parser.matching

    def expression(self, level: int = 1):
        left = self.unary()
        while (op := self.text) in _LEVEL and self.kind in ("op", "name") and op != "atan2" and _LEVEL[op] >= level:
            if isinstance(left, LogQuery):
                raise QueryError("a log query is no operand")
            self.take()
            is_bool = bool(self.accept("bool"))
            matching = self.matching()
            right = self.expression(_LEVEL[op] if op == "^" else _LEVEL[op] + 1)
            left = Binary(op, left, right, is_bool, matching)
        return left

    def unary(self):
        if self.accept("-"):
            return Negative(self.expression(6))
        if self.kind == "number":
            return Number(float(self.take()))
        if self.accept("("):
            inner = self.expression()
            self.expect(")")
            return inner
        if self.text == "{":
            return self.logs()[0]
        if self.kind != "name":
            raise QueryError(f"unexpected {self.text or 'the end'!r}")
        name = self.take()
        if name in RANGE_OPS:
            return self.range_aggregate(name)
        if name in VECTOR_OPS:
            return self.vector_aggregate(name)
        if name == "vector":
            self.expect("(")
            value = float(self.take())
            self.expect(")")
            return Call("vector", (Number(value),))
        if name == "label_replace":
            self.expect("(")
            args = [self.expression()]
            while self.accept(","):
                args.append(Text(unquote(self.take())))
            self.expect(")")
            return Call(name, tuple(args))
        raise QueryError(f"unknown function {name}")

    def vector_aggregate(self, op: str):
        how = self.accept("by", "without")
        names = self.names() if how else ()
        self.expect("(")
        param = None
        if op in ("topk", "bottomk", "approx_topk"):
            param = Number(float(self.take()))
            self.expect(",")
        inner = self.expression()
        self.expect(")")
        if not how and (how := self.accept("by", "without")):
            names = self.names()
        if op in ("sort", "sort_desc"):
            return Call(op, (inner,))
        return Aggregate("topk" if op == "approx_topk" else op, inner, param, names, how == "without")

    def range_aggregate(self, op: str) -> RangeAggregate:
        self.expect("(")
        param = None
        if op == "quantile_over_time":
            param = Number(float(self.take()))
            self.expect(",")
        elif op == "approx_count_distinct":
            param = Text(self.take())
            self.expect(",")
        logs, window, offset = self.logs()
        if window is None:
            raise QueryError(f"{op} needs a range")
        self.expect(")")
        how = self.accept("by", "without")
        names = self.names() if how else ()
        unwrap = next((s[1:] for s in logs.stages if s[0] == "unwrap"), None)
        if unwrap and op in NO_UNWRAP or not unwrap and op in NEEDS_UNWRAP:
            raise QueryError(f"{op} {'takes no' if unwrap else 'needs an'} unwrap")
        if how and op not in _GROUPED and not (op == "approx_count_distinct" and how == "by"):
            raise QueryError(f"no grouping for {op}")
        return RangeAggregate(op, logs, window, offset, unwrap, param, names, None if how is None else how == "without")

    def logs(self) -> tuple[LogQuery, int | None, int]:
        if self.accept("("):
            out = self.logs()
            self.expect(")")
            return out
        self.expect("{")
        matchers = []
        while not self.accept("}"):
            name = self.take()
            op = self.expect("=", "!=", "=~", "!~")
            matchers.append((name, op, unquote(self.take())))
            if self.text != "}":
                self.expect(",")
        stages, window, offset = [], None, 0
        while True:
            if self.accept("["):
                window = duration_ns(self.take())
                self.expect("]")
            elif self.accept("offset"):
                offset = duration_ns(self.take())
            elif self.text in ("|=", "|~", "|>", "!=", "!~", "!>") and self.kind == "op" and self.tokens[self.at + 1][0] in ("string", "name") and (window is None or self.text[0] == "|"):
                stages.append(self.line_filter())
            elif self.accept("|"):
                stages.append(self.stage())
            else:
                break
        seen = [s[0] for s in stages]
        if "unwrap" in seen and any(s not in ("filter", "unwrap") for s in seen[seen.index("unwrap") :]):
            raise QueryError("only label filters may follow unwrap")
        return LogQuery(tuple(matchers), tuple(stages)), window, offset

    def line_filter(self) -> tuple:
        op, values = self.take(), []
        while True:
            if self.accept("ip"):
                self.expect("(")
                values.append(("ip", unquote(self.take())))
                self.expect(")")
            else:
                values.append(("text", unquote(self.take())))
            if not self.accept("or"):
                return ("line", op, tuple(values))

    def stage(self) -> tuple:
        name = self.text
        if name in ("json", "logfmt"):
            self.take()
            flags = []
            while self.kind == "flag":
                flags.append(self.take())
                if flags[-1] not in _FLAGS:
                    raise QueryError(f"unknown flag {flags[-1]}")
            fields = []
            while self.kind == "name" and self.tokens[self.at + 1][1] in ("=", ",", "|", ")", "[", "") or self.kind == "name" and fields == [] and self.tokens[self.at + 1][0] == "end":
                label = self.take()
                fields.append((label, unquote(self.take()) if self.accept("=") else label))
                if not self.accept(","):
                    break
            return (name, tuple(fields), tuple(flags))
        if name in ("regexp", "pattern", "line_format"):
            self.take()
            return (name, unquote(self.take()))
        if name in ("unpack", "decolorize"):
            return (self.take(),)
        if name == "label_format":
            self.take()
            out = []
            while True:
                label = self.take()
                self.expect("=")
                out.append((label, "template", unquote(self.take())) if self.kind == "string" else (label, "label", self.take()))
                if not self.accept(","):
                    return (name, tuple(out))
        if name in ("drop", "keep"):
            self.take()
            out = []
            while True:
                label = self.take()
                op = self.accept("=", "!=", "=~", "!~")
                out.append((label, op, unquote(self.take()) if op else None))
                if not self.accept(","):
                    return (name, tuple(out))
        if name == "unwrap":
            self.take()
            label, conversion = self.take(), None
            if self.accept("("):
                if label not in ("duration", "duration_seconds", "bytes"):
                    raise QueryError(f"unknown conversion {label}")
                conversion, label = label, self.take()
                self.expect(")")
            return (name, label, conversion)
        return ("filter", self.filter_or())

    def filter_or(self) -> tuple:
        left = self.filter_and()
        while self.accept("or"):
            left = ("or", left, self.filter_and())
        return left

    def filter_and(self) -> tuple:
        left = self.filter_one()
        while self.accept("and", ",") or self.kind == "name" and self.text != "or" and self.tokens[self.at + 1][1] in ("=", "!=", "=~", "!~", "==", "<", ">", "<=", ">="):
            left = ("and", left, self.filter_one())
        return left

    def filter_one(self) -> tuple:
        if self.accept("("):
            inner = self.filter_or()
            self.expect(")")
            return inner
        name = self.take()
        op = self.expect("=", "!=", "=~", "!~", "==", "<", ">", "<=", ">=")
        if self.accept("ip"):
            self.expect("(")
            pattern = unquote(self.take())
            self.expect(")")
            return ("ip", name, op, pattern)
        kind, sign = self.kind, -1 if self.accept("-") else 1
        kind, text = self.kind, self.take()
        if kind == "string":
            return ("text", name, op, unquote(text))
        if kind == "duration":
            return ("duration", name, op, sign * duration_ns(text) / 1e9)
        if kind == "bytes":
            m = re.fullmatch(r"([\d.]+)(\w+)", text)
            return ("bytes", name, op, sign * float(m[1]) * BYTES[m[2].lower()])
        return ("number", name, op, sign * float(text))


def parse(text: str):
    p = _LogParser(tokens_of(text, _TOKEN))
    out = p.expression()
    if p.kind != "end":
        raise QueryError(f"unexpected {p.text!r}")
    return out
