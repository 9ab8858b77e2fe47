"""Label sets: maps with a canonical string beside them, as maps are neither join nor comparison keys."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NAME = "__name__"


def no_labels() -> Column:
    return F.create_map().cast("map<string,string>")


#: What separates names, values and labels in a canonical string, and how values spell these characters; fixed values.
_ESCAPES = {"\x03": "\x03\x04", "\x01": "\x03\x05", "\x02": "\x03\x06"}


def _escaped(value: Column) -> Column:
    for char, spelled in _ESCAPES.items():
        value = F.replace(value, F.lit(char), F.lit(spelled))
    return value


def _unescaped(value: Column) -> Column:
    for char, spelled in reversed(_ESCAPES.items()):
        value = F.replace(value, F.lit(spelled), F.lit(char))
    return value


def key_of(labels: Column) -> Column:
    """The same for equal sets; an empty value is an absent label."""
    pairs = F.filter(F.map_entries(labels), lambda e: e["value"] != "")
    return F.array_join(F.sort_array(F.transform(pairs, lambda e: F.concat(e["key"], F.lit("\x01"), _escaped(e["value"])))), "\x02")


def key_from(values: dict[str, Column]) -> Column:
    """`key_of` a set whose names are known: plain columns, where lambdas over a map are interpreted row by row."""
    pairs = {k: v.cast("string") for k, v in sorted(values.items())}
    return F.concat_ws("\x02", *[F.when(v != "", F.concat(F.lit(f"{k}\x01"), _escaped(v))) for k, v in pairs.items()])


def keep(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: k.isin(names)) if names else no_labels()


def drop(labels: Column, names: list[str]) -> Column:
    return F.map_filter(labels, lambda k, v: ~k.isin(names)) if names else labels


def put(labels: Column, name: str, value: Column) -> Column:
    """Sets a label; an empty value removes it."""
    rest = drop(labels, [name])
    return F.when(value == "", rest).otherwise(F.map_concat(rest, F.create_map(F.lit(name), value)))


def value_of(labels: Column, name: str) -> Column:
    return F.coalesce(F.element_at(labels, name), F.lit(""))


def rekeyed(df: DataFrame) -> DataFrame:
    return df.withColumn("key", key_of(F.col("labels")))


_FORBIDDEN = re.compile(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<|[*+?}]\+")


def java_regex(pattern: str) -> str:
    """A linear-time regular expression in Java's syntax; what that syntax adds (look-around, back references, possessive repeats) is refused."""
    if _FORBIDDEN.search(re.sub(r"\\\\", "", pattern)):
        raise ValueError(f"unsupported regular expression: {pattern}")
    return pattern.replace("(?P<", "(?<")


def matches(value: Column, op: str, operand: str) -> Column:
    """A label matcher; regular expressions match the whole value, and dots also match line ends."""
    if op in ("=", "!="):
        hit = value == operand
    else:
        hit = value.rlike(f"(?s)\\A(?:{java_regex(operand)})\\z")
    return ~hit if op.startswith("!") else hit


def selects(labels: Column, name: str, op: str, operand: str) -> Column:
    """A matcher on a label of a set. Equality reads the map as a plain column where the map is made of columns, so that it reaches the scan."""
    if op == "=" and operand:
        return labels[name] == operand
    return matches(value_of(labels, name), op, operand)


def labels_of(key: Column) -> Column:
    """The label set of a canonical string. Grouping by the string and reading the set from it keeps maps out of aggregation buffers, which hash aggregation cannot hold."""
    read = F.str_to_map(key, F.lit("\x02"), F.lit("\x01"))
    return F.when(key == "", no_labels()).when(F.contains(key, F.lit("\x03")), F.transform_values(read, lambda k, v: _unescaped(v))).otherwise(read)
