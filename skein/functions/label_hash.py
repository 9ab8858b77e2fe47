"""The hash of a label set by which series are sampled: XXH64 over length-prefixed names and values, in order of names."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def _prefixed(text: str) -> bytes:
    """One byte of length below 255, else 255 and three bytes."""
    raw = text.encode()
    return (bytes([len(raw)]) if len(raw) < 255 else b"\xff" + len(raw).to_bytes(3, "little")) + raw


def hash_of(labels: dict[str, str]) -> str:
    """16 hexadecimal digits, which order as the numbers do."""
    import xxhash

    return xxhash.xxh64_hexdigest(b"".join(_prefixed(x) for pair in sorted(labels.items()) for x in pair))


def label_hash(labels: Column) -> Column:
    @F.pandas_udf("string")
    def hashes(names: pd.Series, values: pd.Series) -> pd.Series:
        return pd.Series([hash_of(dict(zip(n, v, strict=True))) for n, v in zip(names, values, strict=True)])

    return hashes(F.map_keys(labels), F.map_values(labels))
