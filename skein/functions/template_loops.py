"""Templates that columns cannot express: loops, variables, JSON values, index and slice. They run row by row in one Arrow UDF."""

from __future__ import annotations

import base64
import html
import json
import math
import re
import urllib.parse
from collections.abc import Callable
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import BYTES, duration_ns

#: What sends a template here.
_NEEDS = re.compile(r"\{\{-?\s*(?:range|break|continue)\b|\{\{[^}]*(?:\$|\b(?:fromJson|index|slice|js)\b)")
_ITEM = re.compile(r'\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|`[^`]*`)|(?P<number>-?\d+(?:\.\d+)?)|(?P<var>\$\w*)|(?P<field>(?:\.[A-Za-z_]\w*)+)|(?P<dot>\.)|(?P<name>[A-Za-z_]\w*)|(?P<op>:=|[=()|,]))')
MOST_OUTPUT = 16_777_216


class TemplateError(ValueError):
    """A template that does not parse, or fails on a row."""


def needs_loops(text: str) -> bool:
    return bool(_NEEDS.search(text))


def show(v) -> str:
    """A value as text: whole floats without a fraction, lists in brackets, maps by key."""
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, float):
        if math.isnan(v) or math.isinf(v):
            return "NaN" if v != v else "+Inf" if v > 0 else "-Inf"
        return str(int(v)) if v == int(v) and abs(v) < 1e21 else repr(v)
    if isinstance(v, list):
        return "[" + " ".join(map(show, v)) + "]"
    if isinstance(v, dict):
        return "map[" + " ".join(f"{k}:{show(x)}" for k, x in sorted(v.items())) + "]"
    return str(v)


def truth(v) -> bool:
    return v is not None and v is not False and v != "" and v != 0 and v != [] and v != {}


def _int(v) -> int:
    try:
        return int(v) if isinstance(v, int | bool) else int(str(v), 10) if isinstance(v, str) else int(v)
    except (ValueError, OverflowError):
        try:
            return int(float(v))
        except (ValueError, OverflowError):
            return 0


def _float(v) -> float:
    try:
        return float(v)
    except (TypeError, ValueError):
        return 0.0


def _wrapped(x: int) -> int:
    return (x + (1 << 63)) % (1 << 64) - (1 << 63)


def _div(a: int, b: int) -> int:
    if b == 0:
        raise TemplateError("division by zero")
    q = abs(a) // abs(b)
    return q if (a < 0) == (b < 0) else -q


def _round(v, places, threshold=0.5) -> float:
    power = 10.0 ** _int(places)
    digit = _float(v) * power
    return (math.ceil(digit) if digit - math.trunc(digit) >= threshold else math.floor(digit)) / power


def _bytes(v) -> float:
    m = re.fullmatch(r"\s*(\d+(?:\.\d*)?)\s*([A-Za-z]*)\s*", str(v))
    return float(m[1]) * ({"": 1} | BYTES).get(m[2].lower(), 0) if m else 0.0


def _seconds(v) -> float:
    try:
        return duration_ns(str(v).lstrip("+-")) / 1e9 * (-1 if str(v).startswith("-") else 1)
    except ValueError:
        return 0.0


def _compare(f: Callable) -> Callable:
    def run(a, b) -> bool:
        number = lambda x: isinstance(x, int | float) and not isinstance(x, bool)
        try:
            return f(float(a), float(b)) if number(a) or number(b) or isinstance(a, str) and isinstance(b, str) and _numeric(a) and _numeric(b) else f(a, b)
        except (TypeError, ValueError) as e:
            raise TemplateError("values do not compare") from e

    return run


def _numeric(s: str) -> bool:
    try:
        float(s)
        return True
    except ValueError:
        return False


def _index(item, *at):
    for i in at:
        if isinstance(item, dict):
            item = item.get(show(i))
        elif isinstance(item, list | str):
            n = _int(i)
            if not 0 <= n < len(item):
                raise TemplateError("index out of range")
            item = item.encode()[n] if isinstance(item, str) else item[n]
        else:
            raise TemplateError("nothing to index")
    return item


def _slice(item, *at):
    if not isinstance(item, list | str):
        raise TemplateError("nothing to slice")
    raw = item.encode() if isinstance(item, str) else item
    low, high = (_int(at[0]) if at else 0), (_int(at[1]) if len(at) > 1 else len(raw))
    if not 0 <= low <= high <= len(raw):
        raise TemplateError("slice out of range")
    return raw[low:high].decode(errors="replace") if isinstance(item, str) else raw[low:high]


def _js(*a) -> str:
    #: What must not stand in a script as it is.
    special = {"\\": "\\\\", "'": "\\'", '"': '\\"', "<": "\\u003C", ">": "\\u003E", "&": "\\u0026", "=": "\\u003D"}
    return "".join(special.get(c) or (f"\\u{ord(c):04X}" if ord(c) < 32 else c) for c in "".join(map(show, a)))


def _from_json(text):
    try:
        return json.loads(text)
    except (TypeError, ValueError):
        return None


def _regex(p, s, r, literal: bool) -> str:
    with_groups = (lambda m: r) if literal else re.sub(r"\\", r"\\\\", r)
    if not literal:
        with_groups = re.sub(r"\$\{(\w+)\}|\$(\w+)", lambda m: f"\\g<{m[1] or m[2]}>", with_groups)
    return re.sub(p.replace("(?P<", "(?P<"), with_groups, s)


def _indent(n, s) -> str:
    pad = " " * _int(n)
    return pad + s.replace("\n", "\n" + pad)


FUNCTIONS: dict[str, Callable] = {
    "upper": str.upper, "ToUpper": str.upper, "lower": str.lower, "ToLower": str.lower, "title": lambda s: " ".join(w[:1].upper() + w[1:] for w in s.split(" ")),
    "trim": str.strip, "TrimSpace": str.strip, "trimAll": lambda cut, s: s.strip(cut), "Trim": lambda s, cut: s.strip(cut), "TrimLeft": lambda s, cut: s.lstrip(cut), "TrimRight": lambda s, cut: s.rstrip(cut),
    "trimPrefix": lambda p, s: s.removeprefix(p), "TrimPrefix": lambda s, p: s.removeprefix(p), "trimSuffix": lambda p, s: s.removesuffix(p), "TrimSuffix": lambda s, p: s.removesuffix(p),
    "replace": lambda a, b, s: s.replace(a, b), "Replace": lambda s, a, b, n: s.replace(a, b, max(-1, _int(n))), "repeat": lambda n, s: s * _int(n), "indent": _indent, "nindent": lambda n, s: "\n" + _indent(n, s),
    "alignLeft": lambda n, s: s[: _int(n)].ljust(_int(n)), "alignRight": lambda n, s: s[-_int(n) :].rjust(_int(n)) if _int(n) else "", "trunc": lambda n, s: s[: _int(n)] if _int(n) >= 0 else s[_int(n) :],
    "substr": lambda a, b, s: s[max(0, _int(a)) :] if _int(b) < 0 else s[max(0, _int(a)) : _int(b)],
    "contains": lambda a, s: a in s, "hasPrefix": lambda a, s: s.startswith(a), "hasSuffix": lambda a, s: s.endswith(a), "count": lambda p, s: len(re.findall(p, s)), "len": lambda v: len(v.encode()) if isinstance(v, str) else len(v),
    "index": _index, "slice": _slice, "urlencode": urllib.parse.quote_plus, "urlquery": lambda *a: urllib.parse.quote_plus("".join(map(show, a))), "urldecode": urllib.parse.unquote_plus,
    "b64enc": lambda s: base64.b64encode(s.encode()).decode(), "b64dec": lambda s: base64.b64decode(s).decode(errors="replace"), "html": lambda *a: html.escape("".join(map(show, a))).replace("&quot;", "&#34;").replace("&#x27;", "&#39;"), "js": _js,
    "int": _int, "float64": _float, "add": lambda *a: _wrapped(sum(map(_int, a))), "sub": lambda a, b: _wrapped(_int(a) - _int(b)), "mul": lambda *a: reduce(lambda x, y: _wrapped(x * y), map(_int, a)), "div": lambda a, b: _div(_int(a), _int(b)),
    "mod": lambda a, b: _int(a) - _int(b) * _div(_int(a), _int(b)), "min": lambda *a: min(map(_int, a)), "max": lambda *a: max(map(_int, a)),
    "addf": lambda *a: sum(map(_float, a)), "subf": lambda a, *b: _float(a) - sum(map(_float, b)), "mulf": lambda *a: math.prod(map(_float, a)), "divf": lambda a, *b: reduce(lambda x, y: x / y if y else math.nan, map(_float, b), _float(a)),
    "minf": lambda *a: min(map(_float, a)), "maxf": lambda *a: max(map(_float, a)), "floor": lambda v: float(math.floor(_float(v))), "ceil": lambda v: float(math.ceil(_float(v))), "round": _round,
    "bytes": _bytes, "duration": _seconds, "duration_seconds": _seconds, "default": lambda d, s: s if truth(s) else d, "and": lambda *a: next((x for x in a if not truth(x)), a[-1]), "or": lambda *a: next((x for x in a if truth(x)), a[-1]), "not": lambda a: not truth(a),
    "eq": lambda a, *b: any(_compare(lambda x, y: x == y)(a, x) for x in b), "ne": _compare(lambda a, b: a != b), "lt": _compare(lambda a, b: a < b), "le": _compare(lambda a, b: a <= b), "gt": _compare(lambda a, b: a > b), "ge": _compare(lambda a, b: a >= b),
    "regexReplaceAll": lambda p, s, r: _regex(p, s, r, False), "regexReplaceAllLiteral": lambda p, s, r: _regex(p, s, r, True), "fromJson": _from_json, "print": lambda *a: "".join(map(show, a)), "println": lambda *a: " ".join(map(show, a)) + "\n",
    "unixEpoch": lambda t: _int(t) // 10**9, "unixEpochMillis": lambda t: _int(t) // 10**6, "unixEpochNanos": _int, "unixToTime": lambda s: _int(s) * 10**9,
}


def _pieces(text: str) -> list[tuple[str, str]]:
    """Texts and actions, with the white space that `{{-` and `-}}` take away gone."""
    out: list[tuple[str, str]] = []
    strip = False
    for p in re.split(r"(\{\{.*?\}\})", text, flags=re.DOTALL):
        if p.startswith("{{"):
            body = p[2:-2]
            if body.startswith("- ") and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1].rstrip())
            strip = body.endswith(" -")
            out.append(("action", body.removeprefix("- ").removesuffix(" -").strip()))
        elif p:
            out.append(("text", p.lstrip() if strip else p))
            strip = False
    return out


class _Compiler:
    """Turns a template into nested nodes."""

    def __init__(self, text: str):
        self.pieces, self.at, self.depth = _pieces(text), 0, 0

    def block(self) -> list[tuple]:
        out: list[tuple] = []
        while self.at < len(self.pieces):
            kind, t = self.pieces[self.at]
            word = t.split(" ", 1)[0] if kind == "action" else ""
            if word in ("end", "else"):
                return out
            self.at += 1
            if kind == "text":
                out.append(("text", t))
            elif word in ("if", "with"):
                out.append(self.branch(word, t[len(word) :]))
            elif word == "range":
                out.append(self.loop(t[5:]))
            elif word in ("break", "continue"):
                if not self.depth:
                    raise TemplateError(f"{word} outside range")
                out.append((word,))
            elif not t.startswith("/*"):
                out.append(self.action(t))
        return out

    def close(self) -> list[tuple]:
        """The else part, up to end."""
        if self.at >= len(self.pieces):
            raise TemplateError("missing end")
        t = self.pieces[self.at][1]
        self.at += 1
        if t == "end":
            return []
        rest = t[4:].strip()
        if rest:
            word = rest.split(" ", 1)[0]
            return [self.branch(word, rest[len(word) :])]
        out = self.block()
        if self.at >= len(self.pieces) or self.pieces[self.at][1] != "end":
            raise TemplateError("missing end")
        self.at += 1
        return out

    def branch(self, word: str, text: str) -> tuple:
        test = self.action(text, silent=True)
        yes = self.block()
        return (word, test, yes, self.close())

    def loop(self, text: str) -> tuple:
        items = self.items(text)
        names: list[str] = []
        if items and items[0][0] == "var":
            k = 0
            while k < len(items) and items[k][0] == "var":
                names.append(items[k][1])
                k += 2 if k + 1 < len(items) and items[k + 1][1] == "," else 1
            if k < len(items) and items[k][1] in (":=", "="):
                items = items[k + 1 :]
            else:
                names = []
        header = self.pipeline(items)
        self.depth += 1
        body = self.block()
        self.depth -= 1
        return ("range", names, header, body, self.close())

    @staticmethod
    def items(text: str) -> list[tuple[str, str]]:
        out, at = [], 0
        while text[at:].strip():
            m = _ITEM.match(text, at)
            if not m:
                raise TemplateError(f"unexpected {text[at:]!r}")
            out.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        return out

    def action(self, text: str, silent: bool = False) -> tuple:
        items = self.items(text)
        if len(items) > 1 and items[0][0] == "var" and items[1][1] in (":=", "="):
            node = self.pipeline(items[2:])
            return ("set", items[0][1], node, items[1][1] == ":=")
        return self.pipeline(items) if silent else ("show", self.pipeline(items))

    def pipeline(self, items: list[tuple[str, str]]):
        k = 0

        def operand():
            nonlocal k
            if k >= len(items):
                raise TemplateError("a value is missing")
            kind, t = items[k]
            k += 1
            if kind == "string":
                return ("value", t[1:-1] if t[0] == "`" else json.loads(t.replace("\n", "\\n")))
            if kind == "number":
                return ("value", float(t) if "." in t else int(t))
            if t == "(":
                inner = chain()
                if k >= len(items) or items[k][1] != ")":
                    raise TemplateError("missing )")
                k += 1
                if k < len(items) and items[k][0] == "field":
                    k += 1
                    return ("fields", inner, items[k - 1][1][1:].split("."))
                return inner
            if kind == "field":
                return ("fields", ("dot",), t[1:].split("."))
            if kind == "dot":
                return ("dot",)
            if kind == "var":
                if k < len(items) and items[k][0] == "field":
                    k += 1
                    return ("fields", ("var", t), items[k - 1][1][1:].split("."))
                return ("var", t)
            if kind == "name":
                if t in ("true", "false", "nil"):
                    return ("value", {"true": True, "false": False}.get(t))
                if t in ("__line__", "__timestamp__"):
                    return (t,)
                if t in FUNCTIONS:
                    return ("call", t, [])
            raise TemplateError(f"unexpected {t!r}")

        def command(piped):
            nonlocal k
            kind, t = items[k] if k < len(items) else ("", "")
            if kind == "name" and t in FUNCTIONS:
                k += 1
                args = []
                while k < len(items) and items[k][1] not in ("|", ")"):
                    args.append(operand())
                return ("call", t, args + ([piped] if piped is not None else []))
            return operand()

        def chain():
            nonlocal k
            out = command(None)
            while k < len(items) and items[k][1] == "|":
                k += 1
                out = command(out)
            return out

        out = chain()
        if k != len(items):
            raise TemplateError(f"unexpected {items[k][1]!r}")
        return out


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


class Template:
    """A template that runs on a bag of labels, a line and a time."""

    def __init__(self, text: str):
        c = _Compiler(text)
        self.nodes = c.block()
        if c.at != len(c.pieces):
            raise TemplateError("unbalanced end")

    def run(self, bag: dict[str, str], line: str, ts: int) -> str:
        self.out: list[str] = []
        self.size, self.line, self.ts = 0, line, ts
        self._block(self.nodes, bag, [{"$": bag}])
        return "".join(self.out)

    def _emit(self, text: str) -> None:
        self.size += len(text)
        if self.size > MOST_OUTPUT:
            raise TemplateError("the output is too large")
        self.out.append(text)

    def _block(self, nodes: list[tuple], dot, scopes: list[dict]) -> None:
        scopes = [*scopes, {}]
        for n in nodes:
            if n[0] == "text":
                self._emit(n[1])
            elif n[0] == "show":
                self._emit(show(self._value(n[1], dot, scopes)))
            elif n[0] == "set":
                self._set(n, dot, scopes)
            elif n[0] in ("if", "with"):
                inner = [*scopes, {}]
                v = self._set(n[1], dot, inner) if n[1][0] == "set" else self._value(n[1], dot, inner)
                self._block(n[2] if truth(v) else n[3], v if n[0] == "with" and truth(v) else dot, inner)
            elif n[0] == "range":
                self._loop(n, dot, scopes)
            else:
                raise _Break if n[0] == "break" else _Continue

    def _set(self, n: tuple, dot, scopes: list[dict]):
        v = self._value(n[2], dot, scopes)
        home = scopes[-1] if n[3] else next((s for s in reversed(scopes) if n[1] in s), None)
        if home is None:
            raise TemplateError(f"undefined {n[1]}")
        home[n[1]] = v
        return v

    def _loop(self, n: tuple, dot, scopes: list[dict]) -> None:
        _, names, header, body, rest = n
        v = self._value(header, dot, scopes)
        pairs = list(enumerate(v)) if isinstance(v, list) else sorted(v.items()) if isinstance(v, dict) else list(enumerate(range(v))) if isinstance(v, int) and not isinstance(v, bool) else None
        if pairs is None and truth(v):
            raise TemplateError("range over a value that is no list")
        if not pairs:
            return self._block(rest, dot, scopes)
        for key, item in pairs:
            own = {names[-1]: item} if names else {}
            if len(names) > 1:
                own[names[0]] = key
            try:
                self._block(body, item, [*scopes, own])
            except _Continue:
                continue
            except _Break:
                break
        return None

    def _value(self, n: tuple, dot, scopes: list[dict]):
        kind = n[0]
        if kind == "value":
            return n[1]
        if kind == "dot":
            return dot
        if kind == "var":
            for s in reversed(scopes):
                if n[1] in s:
                    return s[n[1]]
            raise TemplateError(f"undefined {n[1]}")
        if kind == "fields":
            v = self._value(n[1], dot, scopes)
            for f in n[2]:
                v = v.get(f) if isinstance(v, dict) else None
            return "" if v is None and n[1] == ("dot",) else v
        if kind in ("__line__", "__timestamp__"):
            return self.line if kind == "__line__" else self.ts
        args = [self._value(a, dot, scopes) for a in n[2]]
        try:
            return FUNCTIONS[n[1]](*args)
        except (TypeError, ValueError, AttributeError, IndexError, re.error) as e:
            raise TemplateError(f"{n[1]}: {e}") from e


def loop_template(text: str, bag: Column, line: Column, ts: Column) -> Column:
    """The template's text for each row; null where it fails."""
    template = Template(text)  # a template that does not parse fails when the query is planned

    @F.pandas_udf("string")
    def run(names: pd.Series, values: pd.Series, lines: pd.Series, times: pd.Series) -> pd.Series:
        def one(k, v, line, at):
            try:
                return template.run(dict(zip(k, v, strict=True)), line, int(at))
            except TemplateError:
                return None

        return pd.Series([one(*x) for x in zip(names, values, lines, times, strict=True)], dtype="object")

    return run(F.map_keys(bag), F.map_values(bag), line, ts)
