"""Parser of the metric language: a token scanner and a precedence climber over frozen nodes."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass, field, fields, is_dataclass, replace

from ..functions.units import duration_ns


@dataclass(frozen=True)
class Number:
    value: float


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Span:
    """A duration that needs the query's step or range: an operator or function and its arguments, in seconds."""

    op: str
    args: tuple = ()


@dataclass(frozen=True)
class Selector:
    matchers: tuple[tuple[str, str, str], ...]
    window: int | Span | None = None
    offset: int | Span = 0
    at: object = None  # None, "start", "end" or nanoseconds


@dataclass(frozen=True)
class Subquery:
    inner: object
    window: int | Span
    step: int | Span | None
    offset: int | Span = 0
    at: object = None


@dataclass(frozen=True)
class Call:
    name: str
    args: tuple


@dataclass(frozen=True)
class Aggregate:
    op: str
    inner: object
    param: object = None
    names: tuple[str, ...] = ()
    without: bool = False


@dataclass(frozen=True)
class Matching:
    names: tuple[str, ...] = ()
    on: bool = False
    side: str | None = None  # "left" or "right": the side with many
    include: tuple[str, ...] = ()


@dataclass(frozen=True)
class Binary:
    op: str
    left: object
    right: object
    is_bool: bool = False
    matching: Matching = field(default_factory=Matching)


@dataclass(frozen=True)
class Negative:
    inner: object


class QueryError(ValueError):
    """A query that does not parse or does not type."""


AGGREGATES = {"sum", "avg", "min", "max", "count", "group", "stddev", "stdvar", "topk", "bottomk", "quantile", "count_values", "limitk", "limit_ratio"}
_WITH_PARAM = {"topk", "bottomk", "quantile", "count_values", "limitk", "limit_ratio"}
TRIMS = {"</", ">/"}
_LEVEL = {"or": 1, "and": 2, "unless": 2, "==": 3, "!=": 3, "</": 3, ">/": 3, "<=": 3, "<": 3, ">=": 3, ">": 3, "+": 4, "-": 4, "*": 5, "/": 5, "%": 5, "atan2": 5, "^": 6}
_TOKEN = re.compile(
    r"""\s+|\#[^\n]*
    |(?P<duration>(?:\d+(?:ms|[smhdwy]))+)(?![\w.])
    |(?P<number>0[xX][0-9a-fA-F]+|(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?|(?i:inf|nan)(?![\w:]))
    |(?P<name>[A-Za-z_][\w:]*|:[A-Za-z_][\w:]*)
    |(?P<string>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`[^`]*`)
    |(?P<op>=~|!~|==|!=|<=|>=|</|>/|[-+*/%^<>=(){}\[\],:@])""",
    re.VERBOSE,
)


def tokens_of(text: str, pattern: re.Pattern = _TOKEN) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = pattern.match(text, at)
        if not m or m.end() == at:
            raise QueryError(f"unexpected {text[at : at + 10]!r} at {at}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return [*out, ("end", "")]


def unquote(text: str) -> str:
    if text[0] == "`":
        return text[1:-1]
    plain = {"n": "\n", "t": "\t", "r": "\r", "a": "\a", "b": "\b", "f": "\f", "v": "\v"}

    def one(m: re.Match) -> str:
        c = m[1]
        return chr(int(c[1:], 16)) if c[0] in "xuU" and len(c) > 1 else plain.get(c, c)

    return re.sub(r"\\(x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|.)", one, text[1:-1], flags=re.DOTALL)


class Stream:
    """Tokens with a place."""

    def __init__(self, tokens: list[tuple[str, str]]):
        self.tokens, self.at = tokens, 0

    @property
    def kind(self) -> str:
        return self.tokens[self.at][0]

    @property
    def text(self) -> str:
        return self.tokens[self.at][1]

    def take(self) -> str:
        self.at += 1
        return self.tokens[self.at - 1][1]

    def accept(self, *texts: str) -> str | None:
        return self.take() if self.text in texts and self.kind != "string" else None

    def expect(self, *texts: str) -> str:
        if self.text not in texts:
            raise QueryError(f"expected {' or '.join(texts)}, found {self.text or 'the end'!r}")
        return self.take()

    def names(self) -> tuple[str, ...]:
        self.expect("(")
        out = []
        while not self.accept(")"):
            out.append(unquote(self.take()) if self.kind == "string" else self.take())
            if self.text != ")":
                self.expect(",")
        return tuple(out)


class _Parser(Stream):
    def expression(self, level: int = 1):
        if self.accept("-"):
            left = Negative(self.expression(6))
        elif self.accept("+"):
            left = self.expression(6)
        else:
            left = self.postfix(self.primary())
        while (op := self.text) in _LEVEL and self.kind in ("op", "name") and _LEVEL[op] >= level:
            self.take()
            is_bool = bool(self.accept("bool"))
            matching = self.matching()
            right = self.expression(_LEVEL[op] if op == "^" else _LEVEL[op] + 1)
            if is_bool and (_LEVEL[op] != 3 or op in TRIMS):
                raise QueryError("bool is for comparisons only")
            if matching.side and _LEVEL[op] in (1, 2):
                raise QueryError("no grouping for set operations")
            left = Binary(op, left, right, is_bool, matching)
        return left

    def matching(self) -> Matching:
        m = Matching()
        if how := self.accept("on", "ignoring"):
            m = replace(m, names=self.names(), on=how == "on")
            if side := self.accept("group_left", "group_right"):
                m = replace(m, side=side[6:], include=self.names() if self.text == "(" else ())
        return m

    def primary(self):
        kind, text = self.kind, self.text
        if kind == "number":
            self.take()
            return Number(float(int(text, 16)) if text[:2].lower() == "0x" else float(text))
        if kind == "duration":
            return Number(duration_ns(self.take()) / 1e9)
        if kind == "string":
            return Text(unquote(self.take()))
        if self.accept("("):
            inner = self.expression()
            self.expect(")")
            return inner
        if text == "{":
            return self.selector(None)
        if kind != "name":
            raise QueryError(f"unexpected {text or 'the end'!r}")
        self.take()
        if text in AGGREGATES and self.text in ("(", "by", "without"):
            return self.aggregate(text)
        if self.text == "(":
            self.take()
            args = []
            while not self.accept(")"):
                args.append(self.expression())
                if self.text != ")":
                    self.expect(",")
            return Call(text, tuple(args))
        return self.selector(text)

    def aggregate(self, op: str) -> Aggregate:
        names, without = (), False
        if how := self.accept("by", "without"):
            names, without = self.names(), how == "without"
        self.expect("(")
        param = None
        if op in _WITH_PARAM:
            param = self.expression()
            self.expect(",")
        inner = self.expression()
        self.expect(")")
        if how := self.accept("by", "without"):
            names, without = self.names(), how == "without"
        return Aggregate(op, inner, param, names, without)

    def selector(self, name: str | None) -> Selector:
        matchers = [("__name__", "=", name)] if name else []
        if self.accept("{"):
            while not self.accept("}"):
                if self.kind == "string":
                    label = unquote(self.take())
                    if self.text in (",", "}"):  # a quoted metric name
                        matchers.append(("__name__", "=", label))
                        self.accept(",")
                        continue
                else:
                    label = self.take()
                op = self.expect("=", "!=", "=~", "!~")
                matchers.append((label, op, unquote(self.take())))
                if self.text != "}":
                    self.expect(",")
        if not any([_excludes_empty(op, v) for _, op, v in matchers]):  # a list: every pattern is compiled
            raise QueryError("a selector needs a matcher that does not match the empty string")
        return Selector(tuple(matchers))

    def duration(self, signed_atom: bool = False) -> int | Span:
        """Nanoseconds of a duration expression; an offset without parentheses is one signed term."""
        return _nanoseconds(self._span_signed() if signed_atom else self._span_sum())

    def _span_sum(self):
        left = self._span_product()
        while op := self.accept("+", "-"):
            left = _span(op, left, self._span_product())
        return left

    def _span_product(self):
        left = self._span_unary()
        while op := self.accept("*", "/", "%"):
            left = _span(op, left, self._span_unary())
        return left

    def _span_unary(self):
        if self.accept("-"):
            return _span("-", 0.0, self._span_unary())
        if self.accept("+"):
            return self._span_unary()
        left = self._span_atom()
        return _span("^", left, self._span_unary()) if self.accept("^") else left

    def _span_signed(self):
        negative = self.accept("-")
        if not negative:
            self.accept("+")
        inner = self._span_atom()
        return _span("-", 0.0, inner) if negative else inner

    def _span_atom(self):
        if self.accept("("):
            inner = self._span_sum()
            self.expect(")")
            return inner
        if self.kind == "number":
            return float(self.take())
        if self.kind == "duration":
            return duration_ns(self.take()) / 1e9
        name = self.expect("step", "range", "min_of", "max_of")
        self.expect("(")
        args = []
        if name in ("min_of", "max_of"):
            args = [self._span_sum()]
            self.expect(",")
            args.append(self._span_sum())
        self.expect(")")
        return _span(name, *args)

    def postfix(self, node):
        while True:
            if self.accept("["):
                window = self.duration()
                if self.kind == "name" and self.text.startswith(":"):  # a colon before a function name
                    self.tokens[self.at : self.at + 1] = [("op", ":"), ("name", self.text[1:])]
                if self.accept(":"):
                    step = None if self.text == "]" else self.duration()
                    node = Subquery(node, window, step)
                else:
                    if not isinstance(node, Selector) or node.window:
                        raise QueryError("a range needs a selector")
                    node = replace(node, window=window)
                self.expect("]")
            elif self.accept("offset"):
                node = self._shifted(node, offset=self.duration(signed_atom=True))
            elif self.accept("@"):
                if how := self.accept("start", "end"):
                    self.expect("("), self.expect(")")
                    node = self._shifted(node, at=how)
                else:
                    sign = -1 if self.accept("-") else 1
                    node = self._shifted(node, at=sign * round(float(self.take()) * 1e9))
            else:
                return node

    @staticmethod
    def _shifted(node, **change):
        if not isinstance(node, Selector | Subquery):
            raise QueryError("offset and @ need a selector or a subquery")
        return replace(node, **change)


#: The longest duration of an expression: a year.
LONGEST = 365 * 86400 * 10**9


def _span(op: str, *args):
    """A number of seconds where all is known, else a Span."""
    return _span_value(op, args) if op not in ("step", "range") and not any(isinstance(a, Span) for a in args) else Span(op, args)


def _span_value(op: str, args) -> float:
    a, b = args
    if op in ("/", "%") and b == 0:
        raise QueryError("a duration divides by zero")
    try:
        out = {"+": lambda: a + b, "-": lambda: a - b, "*": lambda: a * b, "/": lambda: a / b, "%": lambda: math.fmod(a, b), "^": lambda: float(a**b), "min_of": lambda: min(a, b), "max_of": lambda: max(a, b)}[op]()
    except (OverflowError, TypeError, ZeroDivisionError) as e:
        raise QueryError("bad duration") from e
    return out


def _nanoseconds(span):
    if isinstance(span, Span):
        return span
    if not abs(span) * 1e9 <= LONGEST:
        raise QueryError("a duration is out of range")
    return round(span * 1e9)


def resolved(node, step: float, length: float):
    """The node with every duration a number: step() and range() (seconds) are the outer query's, in subqueries too."""

    def known(span):
        if not isinstance(span, Span):
            return span
        if span.op in ("step", "range"):
            return step if span.op == "step" else length
        return _span_value(span.op, [known(a) for a in span.args])

    def walk(x):
        if isinstance(x, tuple):
            return tuple(walk(y) for y in x)
        if not is_dataclass(x):
            return x
        if isinstance(x, Span):
            return _nanoseconds(known(x))
        out = replace(x, **{f.name: walk(getattr(x, f.name)) for f in fields(x)})
        if isinstance(out, Selector | Subquery) and (out.window is not None and out.window <= 0 or getattr(out, "step", None) is not None and out.step <= 0):
            raise QueryError("a range and a resolution must be positive")
        return out

    return walk(node)


def _excludes_empty(op: str, value: str) -> bool:
    if op in ("=", "!="):
        return (value != "") == (op == "=")
    try:
        empty = re.fullmatch(value, "") is not None
    except re.error as e:
        raise QueryError(f"bad regular expression: {value}") from e
    return empty == (op == "!~")


def parse(text: str):
    p = _Parser(tokens_of(text))
    out = p.expression()
    if p.kind != "end":
        raise QueryError(f"unexpected {p.text!r}")
    return out


def format_query(node) -> str:
    """The node as text, in one canonical form."""
    if isinstance(node, Number):
        return f"{node.value:g}" if node.value == node.value and abs(node.value) != float("inf") else {True: "NaN"}.get(node.value != node.value, "+Inf" if node.value > 0 else "-Inf")
    if isinstance(node, Text):
        return '"' + node.value.replace("\\", "\\\\").replace('"', '\\"') + '"'
    if isinstance(node, Selector):
        name = next((v for k, op, v in node.matchers if k == "__name__" and op == "="), "")
        rest = ", ".join(f'{k}{op}"{v}"' for k, op, v in node.matchers if not (k == "__name__" and op == "=" and v == name))
        return name + (f"{{{rest}}}" if rest or not name else "") + (f"[{_span_text(node.window)}]" if node.window else "") + _modifiers(node)
    if isinstance(node, Subquery):
        return f"{format_query(node.inner)}[{_span_text(node.window)}:{_span_text(node.step) if node.step else ''}]" + _modifiers(node)
    if isinstance(node, Call):
        return f"{node.name}({', '.join(map(format_query, node.args))})"
    if isinstance(node, Aggregate):
        how = f" {'without' if node.without else 'by'} ({', '.join(node.names)}) " if node.names or node.without else ""
        return f"{node.op}{how}({', '.join(format_query(a) for a in (node.param, node.inner) if a is not None)})"
    if isinstance(node, Negative):
        return "-" + format_query(node.inner)
    m = node.matching
    words = [node.op] + ["bool"] * node.is_bool
    if m.on or m.names:
        words.append(f"{'on' if m.on else 'ignoring'} ({', '.join(m.names)})")
    if m.side:
        words.append(f"group_{m.side} ({', '.join(m.include)})")
    return f"{_wrapped(node.left)} {' '.join(words)} {_wrapped(node.right)}"


def _wrapped(node) -> str:
    return f"({format_query(node)})" if isinstance(node, Binary) else format_query(node)


def _span_text(ns) -> str:
    if isinstance(ns, float):
        return f"{ns:g}"
    if isinstance(ns, Span):
        return f"{ns.op}({', '.join(map(_span_text, ns.args))})" if ns.op.isidentifier() else f"({f' {ns.op} '.join(map(_span_text, ns.args))})"
    out, rest = "", abs(ns) // 1_000_000
    for unit, size in (("w", 604_800_000), ("d", 86_400_000), ("h", 3_600_000), ("m", 60_000), ("s", 1000), ("ms", 1)):
        if rest >= size:
            out += f"{rest // size}{unit}"
            rest %= size
    return ("-" if ns < 0 else "") + (out or "0s")


def _modifiers(node) -> str:
    at = "" if node.at is None else f" @ {node.at}()" if isinstance(node.at, str) else f" @ {node.at / 1e9:g}"
    return at + (f" offset {_span_text(node.offset)}" if node.offset else "")
