"""Line and label templates as columns: text, fields, pipelines of functions, if and with. Loops and values that are no text go to `template_loops`."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from .units import bytes_of, seconds_of

_ITEM = re.compile(r'\s*(?:(?P<string>"(?:[^"\\]|\\.)*"|`[^`]*`)|(?P<number>-?\d+(?:\.\d+)?)|(?P<field>\.[A-Za-z_]\w*)|(?P<dot>\.)|(?P<name>[A-Za-z_]\w*)|(?P<op>[()|]))')


def _text(c: Column) -> Column:
    return c.cast("string")


def _int(c: Column) -> Column:
    return F.coalesce(_text(c).try_cast("bigint"), _text(c).try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def _float(c: Column) -> Column:
    return F.coalesce(_text(c).try_cast("double"), F.lit(0.0))


def _true(c: Column) -> Column:
    return ~F.coalesce(_text(c), F.lit("")).isin("", "false", "0")


def _fold(f: Callable[[Column, Column], Column], kind: Callable[[Column], Column]):
    def run(*args: Column) -> Column:
        out = kind(args[0])
        for a in args[1:]:
            out = f(out, kind(a))
        return out

    return run


def _quote(c: Column) -> Column:
    """A string that a regular expression takes for itself."""
    return F.concat(F.lit("\\Q"), c, F.lit("\\E"))


def _compare(f):
    return lambda a, b: F.when(_text(a).try_cast("double").isNotNull() & _text(b).try_cast("double").isNotNull(), f(_float(a), _float(b))).otherwise(f(_text(a), _text(b)))


def _pad_left(n: Column, s: Column) -> Column:
    return F.when(F.length(s) >= _int(n), F.right(s, _int(n).cast("int"))).otherwise(F.lpad(s, _int(n).cast("int"), F.lit(" ")))


def _pad_right(n: Column, s: Column) -> Column:
    return F.rpad(s, _int(n).cast("int"), F.lit(" "))


def _trunc(n: Column, s: Column) -> Column:
    k = _int(n).cast("int")
    return F.when(k >= 0, F.left(s, k)).otherwise(F.right(s, -k))


def _title(s: Column) -> Column:
    return F.array_join(F.transform(F.split(s, " "), lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.substring(w, 2, 1 << 30))), " ")


def _rounded(v: Column, places: Column, threshold: Column | None = None) -> Column:
    """To a number of places; up where the fraction of the last one reaches the threshold."""
    power = F.pow(F.lit(10.0), _int(places))
    digit = _float(v) * power
    part = digit - F.when(digit < 0, F.ceil(digit)).otherwise(F.floor(digit))
    return F.when(part >= (F.lit(0.5) if threshold is None else threshold), F.ceil(digit)).otherwise(F.floor(digit)).cast("double") / power


#: Functions by name; the piped value comes last.
FUNCTIONS: dict[str, Callable[..., Column]] = {
    "upper": F.upper, "ToUpper": F.upper, "lower": F.lower, "ToLower": F.lower, "title": _title,
    "trim": lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""), "TrimSpace": lambda s: F.regexp_replace(s, r"^\s+|\s+$", ""),
    "trimAll": lambda cut, s: F.btrim(s, cut), "Trim": lambda s, cut: F.btrim(s, cut), "TrimLeft": lambda s, cut: F.ltrim(s, cut), "TrimRight": lambda s, cut: F.rtrim(s, cut),
    "trimPrefix": lambda p, s: F.when(F.startswith(s, p), F.substr(s, F.length(p) + 1)).otherwise(s), "TrimPrefix": lambda s, p: F.when(F.startswith(s, p), F.substr(s, F.length(p) + 1)).otherwise(s),
    "trimSuffix": lambda p, s: F.when(F.endswith(s, p), F.left(s, F.length(s) - F.length(p))).otherwise(s), "TrimSuffix": lambda s, p: F.when(F.endswith(s, p), F.left(s, F.length(s) - F.length(p))).otherwise(s),
    "replace": lambda a, b, s: F.replace(s, a, b), "Replace": lambda s, a, b, n: F.when(_int(n) < 0, F.replace(s, a, b)).otherwise(F.call_function("array_join", F.split(s, _quote(a), (_int(n) + 1).cast("int")), b)),
    "repeat": lambda n, s: F.repeat(s, _int(n).cast("int")), "indent": lambda n, s: F.concat(F.repeat(F.lit(" "), _int(n).cast("int")), F.replace(s, F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), _int(n).cast("int"))))),
    "nindent": lambda n, s: F.concat(F.lit("\n"), F.repeat(F.lit(" "), _int(n).cast("int")), F.replace(s, F.lit("\n"), F.concat(F.lit("\n"), F.repeat(F.lit(" "), _int(n).cast("int"))))),
    "alignLeft": _pad_right, "alignRight": _pad_left, "trunc": _trunc, "substr": lambda a, b, s: F.substr(s, (_int(a) + 1).cast("int"), F.when(_int(b) < 0, F.length(s)).otherwise((_int(b) - _int(a)).cast("int"))),
    "contains": lambda a, s: F.contains(s, a), "hasPrefix": lambda a, s: F.startswith(s, a), "hasSuffix": lambda a, s: F.endswith(s, a),
    "count": lambda p, s: F.regexp_count(s, p), "len": F.octet_length,
    "urlencode": F.url_encode, "urlquery": F.url_encode, "urldecode": lambda s: F.coalesce(F.try_url_decode(s), s), "b64enc": lambda s: F.base64(s.cast("binary")), "b64dec": lambda s: F.unbase64(s).cast("string"),
    "html": lambda s: F.replace(F.replace(F.replace(F.replace(F.replace(s, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&#34;")), F.lit("'"), F.lit("&#39;")),
    "int": _int, "float64": _float, "add": _fold(lambda a, b: a + b, _int), "sub": _fold(lambda a, b: a - b, _int), "mul": _fold(lambda a, b: a * b, _int),
    "div": _fold(lambda a, b: F.call_function("div", a, F.nullif(b, F.lit(0).cast("bigint"))), _int), "mod": _fold(lambda a, b: F.try_mod(a, b), _int), "min": _fold(F.least, _int), "max": _fold(F.greatest, _int),
    "addf": _fold(lambda a, b: a + b, _float), "subf": _fold(lambda a, b: a - b, _float), "mulf": _fold(lambda a, b: a * b, _float), "divf": _fold(F.try_divide, _float), "minf": _fold(F.least, _float), "maxf": _fold(F.greatest, _float),
    "floor": lambda v: F.floor(_float(v)).cast("double"), "ceil": lambda v: F.ceil(_float(v)).cast("double"), "round": _rounded,
    "bytes": bytes_of, "duration": seconds_of, "duration_seconds": seconds_of,
    "default": lambda d, s: F.when(_true(s), _text(s)).otherwise(d), "and": _fold(lambda a, b: a & b, _true), "or": lambda *a: F.coalesce(*[F.when(_true(x), _text(x)) for x in a], _text(a[-1])), "not": lambda a: ~_true(a),
    "eq": _compare(lambda a, b: a == b), "ne": _compare(lambda a, b: a != b), "lt": _compare(lambda a, b: a < b), "le": _compare(lambda a, b: a <= b), "gt": _compare(lambda a, b: a > b), "ge": _compare(lambda a, b: a >= b),
    "regexReplaceAll": lambda p, s, r: F.regexp_replace(s, p, F.regexp_replace(r, r"\$\{(\d+)\}", r"\$$1")), "regexReplaceAllLiteral": lambda p, s, r: F.regexp_replace(s, p, F.regexp_replace(r, r"([\\$])", r"\\$1")),
    "print": lambda *a: F.concat_ws("", *[_text(x) for x in a]), "println": lambda *a: F.concat(F.concat_ws(" ", *[_text(x) for x in a]), F.lit("\n")),
    "unixEpoch": lambda t: F.call_function("div", _int(t), F.lit(10**9).cast("bigint")), "unixEpochMillis": lambda t: F.call_function("div", _int(t), F.lit(10**6).cast("bigint")), "unixEpochNanos": _int, "unixToTime": lambda s: _int(s) * 1_000_000_000,
}


class TemplateError(ValueError):
    """A template that does not parse."""


def _items(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while text[at:].strip():
        m = _ITEM.match(text, at)
        if not m:
            raise TemplateError(f"unexpected {text[at:]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


def compile_template(text: str, field: Callable[[str], Column], line: Column, ts: Column) -> Column:
    """The template's text; a field that is missing is empty."""
    parts = re.split(r"(\{\{.*?\}\})", text, flags=re.DOTALL)
    pieces: list[tuple[str, str]] = []
    for p in parts:
        if p.startswith("{{"):
            body = p[2:-2]
            if body.startswith("- ") and pieces and pieces[-1][0] == "text":
                pieces[-1] = ("text", pieces[-1][1].rstrip())
            pieces.append(("action", body.removeprefix("- ").removesuffix(" -").strip()))
            if body.endswith(" -"):
                pieces.append(("strip", ""))
        elif p:
            pieces.append(("text", p.lstrip() if pieces and pieces[-1][0] == "strip" else p))
    pieces = [p for p in pieces if p[0] != "strip"]
    at = 0

    def pipeline(items: list[tuple[str, str]], dot: Column | None) -> Column:
        k = 0

        def operand() -> Column:
            nonlocal k
            kind, t = items[k]
            k += 1
            if kind == "string":
                return F.lit(t[1:-1] if t[0] == "`" else re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), t[1:-1]))
            if kind == "number":
                return F.lit(float(t) if "." in t else int(t))
            if kind == "field":
                return field(t[1:])
            if kind == "dot":
                if dot is None:
                    raise TemplateError("no value for .")
                return dot
            if t == "(":
                out = chain()
                k += 1
                return out
            if kind == "name" and t in ("__line__", "__timestamp__"):
                return line if t == "__line__" else ts
            if kind == "name" and t in ("true", "false"):
                return F.lit(t == "true")
            raise TemplateError(f"unexpected {t!r}")

        def command(piped: Column | None) -> Column:
            nonlocal k
            kind, t = items[k]
            if kind == "name" and t in FUNCTIONS:
                k += 1
                args = []
                while k < len(items) and items[k][1] not in ("|", ")"):
                    args.append(operand())
                return FUNCTIONS[t](*args, *([piped] if piped is not None else []))
            return operand()

        def chain() -> Column:
            nonlocal k
            value = command(None)
            while k < len(items) and items[k][1] == "|":
                k += 1
                value = command(value)
            return value

        return chain()

    def block(dot: Column | None) -> Column:
        nonlocal at
        out = []
        while at < len(pieces):
            kind, t = pieces[at]
            if kind == "text":
                out.append(F.lit(t))
                at += 1
                continue
            word = t.split(" ", 1)[0]
            if word in ("end", "else"):
                break
            at += 1
            if word in ("if", "with"):
                out.append(branch(t, dot))
            elif word in ("range", "break", "continue"):
                raise TemplateError("loops are not supported")
            elif not t.startswith("/*"):
                out.append(F.coalesce(_text(pipeline(_items(t), dot)), F.lit("")))
        return F.concat(*out) if out else F.lit("")

    def branch(t: str, dot: Column | None) -> Column:
        nonlocal at
        value = pipeline(_items(t.split(" ", 1)[1]), dot)
        then = block(value if t.startswith("with") else dot)
        rest = F.lit("")
        if pieces[at][1].startswith("else"):
            follow = pieces[at][1][4:].strip()
            at += 1
            if follow:
                return F.when(_true(value), then).otherwise(branch(follow, dot))
            rest = block(dot)
        at += 1  # end
        return F.when(_true(value), then).otherwise(rest)

    out = block(None)
    if at != len(pieces):
        raise TemplateError("unbalanced end")
    return out
