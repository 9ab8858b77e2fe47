"""Durations and byte sizes, as literals and as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Nanoseconds of a unit, fixed values.
DURATION_NS = {"ns": 1, "us": 1_000, "µs": 1_000, "ms": 1_000_000, "s": 10**9, "m": 60 * 10**9, "h": 3600 * 10**9, "d": 86400 * 10**9, "w": 7 * 86400 * 10**9, "y": 365 * 86400 * 10**9}
#: Bytes of a unit, in lower case, fixed values.
BYTES = {"b": 1, "kb": 10**3, "mb": 10**6, "gb": 10**9, "tb": 10**12, "pb": 10**15, "kib": 2**10, "mib": 2**20, "gib": 2**30, "tib": 2**40, "pib": 2**50, "k": 10**3, "m": 10**6, "g": 10**9, "t": 10**12}

_PART = re.compile(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h|d|w|y)")


def duration_ns(text: str) -> int:
    """Nanoseconds of a literal such as 1h30m."""
    total, at = 0, 0
    for m in _PART.finditer(text):
        if m.start() != at:
            break
        total += round(float(m[1]) * DURATION_NS[m[2]])
        at = m.end()
    if not text or at != len(text):
        raise ValueError(f"not a duration: {text}")
    return total


def seconds_of(text: Column) -> Column:
    """Seconds of a duration string; null if it is none. A bare number has no unit and is none, but 0."""
    whole = text.rlike(r"^[-+]?(?:\d+(?:\.\d*)?(?:ns|us|µs|ms|s|m|h|d|w|y))+$")
    parts = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|s|m|h|d|w|y)"), F.lit(1))
    units = F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d*)?)(ns|us|µs|ms|s|m|h|d|w|y)"), F.lit(2))
    scale = F.create_map(*[F.lit(x) for k, v in DURATION_NS.items() for x in (k, v / 1e9)])
    total = F.aggregate(F.zip_with(parts, units, lambda n, u: n.cast("double") * scale[u]), F.lit(0.0), lambda a, x: a + x)
    sign = F.when(text.startswith("-"), -1.0).otherwise(1.0)
    return F.when(whole, sign * total).when(text == "0", 0.0)


def bytes_of(text: Column) -> Column:
    """Bytes of a size such as 1.5KiB or 200; null if it is none."""
    number = F.regexp_extract(text, r"^\s*(\d+(?:\.\d*)?)\s*([A-Za-z]*)\s*$", 1)
    unit = F.lower(F.regexp_extract(text, r"^\s*(\d+(?:\.\d*)?)\s*([A-Za-z]*)\s*$", 2))
    scale = F.create_map(*[F.lit(x) for k, v in {**BYTES, "": 1}.items() for x in (k, float(v))])
    return F.when(number != "", number.try_cast("double") * scale[unit])
