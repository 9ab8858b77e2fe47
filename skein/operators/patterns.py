"""Log patterns: lines that differ in some words only, with counts over time.

Lines are grouped by shape (word count and place of punctuation); within a shape a small tree keyed by the first word holds
clusters, and a line joins the most similar one of at least 0.4, whose differing words become wildcards. The order of lines
matters, so each shape is taken in order of time, a batch at a time; only its clusters are held, at most 500.

A shape of many lines is cut into segments of time, one task each. Segments are followed side by side from the clusters as they are
before the first; those up to the first that changes its clusters are right, and the others are followed again from there. So each
segment's clusters are as if all before it had been read one by one, and tasks stay as large as a segment.
"""

from __future__ import annotations

import json
import re
from collections import OrderedDict
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.traceql import _settled

WILD, SIMILAR, MOST_CLUSTERS, MOST_BYTES, MOST_WORDS = "<_>", 0.4, 500, 4096, 128
#: How many lines of a shape one task takes at most, how many a segment of a larger shape has (more if they have about the same time), and in how many slices of time they are counted.
TOGETHER, SEGMENT, SLICES = 200_000, 100_000, 4_096
_SPLIT = re.compile(r"[^\s=:,;\[\](){}\"']+|[=:,;\[\](){}\"']")


class Clusters:
    """The clusters of one shape, the least recently used leave first."""

    def __init__(self, most: int = MOST_CLUSTERS, kept: list = (), following: int = 0):
        """kept: (number, words) of earlier clusters, the least recently used first; following: the number of the next one."""
        self.most = most
        self.kept: OrderedDict[int, list[str]] = OrderedDict((k, list(c)) for k, c in kept)
        self.gone: dict[int, list[str]] = {}
        self.tree: dict[str, list[int]] = {}
        for k in sorted(self.kept):
            self.tree.setdefault(self.first(self.kept[k]), []).append(k)
        self.next = following
        self.used: set[int] = set()
        self.changed = False

    @staticmethod
    def first(words: list[str]) -> str:
        return WILD if any(c.isdigit() for c in words[0]) else words[0]

    def state(self) -> dict:
        """What a later segment starts with, and what tells whether it was right to start others before."""
        return {"kept": list(self.kept.items()) if self.changed else [], "next": self.next, "changed": self.changed, "evicted": bool(self.gone), "used": [k for k in self.kept if k in self.used]}

    def add(self, words: list[str]) -> int:
        first = self.first(words)
        best, score = None, (0.0, -1)
        for k in self.tree.get(first, []):
            c = self.kept[k]
            same = sum(a == b for a, b in zip(c, words, strict=True))
            wild = c.count(WILD)
            if (same / len(words), wild) > score:
                best, score = k, (same / len(words), wild)
        if best is None or score[0] < SIMILAR:
            best = self.next
            self.next += 1
            self.kept[best] = list(words)
            self.changed = True
            self.tree.setdefault(first, []).append(best)
            if len(self.kept) > self.most:
                old, c = self.kept.popitem(last=False)
                self.gone[old] = c
                for ks in self.tree.values():
                    if old in ks:
                        ks.remove(old)
        else:
            c = self.kept[best]
            self.kept[best] = [a if a == b else WILD for a, b in zip(c, words, strict=True)]
            self.changed = self.changed or self.kept[best] != c
            self.kept.move_to_end(best)
        self.used.add(best)
        return best

    def rendered(self, k: int) -> str:
        return " ".join(self.kept.get(k) or self.gone[k])


def _words(line: str) -> list[str] | None:
    words = _SPLIT.findall(line)
    return words if 2 <= len(words) <= MOST_WORDS else None


def log_patterns(logs: DataFrame, step: int, together: int = TOGETHER, segment: int = SEGMENT, most: int = MOST_CLUSTERS) -> DataFrame:
    """pattern, step (start of a bucket of time), count."""
    shape = F.concat_ws("|", F.size(F.regexp_extract_all("line", F.lit(_SPLIT.pattern), F.lit(0))).cast("string"), F.regexp_replace("line", r"""[^=:,;\[\](){}"']+""", " "))
    lines = logs.filter((F.octet_length("line") <= MOST_BYTES))
    rows = lines.select("ts", "line", F.xxhash64(shape).alias("shape"), (F.col("ts") - F.pmod("ts", F.lit(step))).alias("step"))
    span = lines.agg(F.min("ts").alias("low"), F.max("ts").alias("high")).first()
    large = []
    if span.low is not None:
        width = (span.high - span.low) // SLICES + 1
        at = F.coalesce(F.call_function("div", F.col("ts") - span.low, F.lit(width).cast("long")), F.lit(0).cast("long")).alias("at")  # nulls are first
        by = rows.groupBy("shape", at).count().groupBy("shape").agg(F.sum("count").alias("n"), F.collect_list(F.struct("at", "count")).alias("slices"))
        large = by.filter(F.col("n") > together).collect()
    if not large:
        return _mined(rows, most).groupBy("pattern", "step").agg(F.sum("count").alias("count"))
    dealt, chains, n = [], {}, 0
    for r in large:
        first, seen = n, 0
        for x in sorted(r["slices"], key=lambda x: x["at"]):
            n = first + seen // segment
            dealt.append((r["shape"], x["at"], n))
            seen += x["count"]
        n += 1
        chains[r["shape"]] = sorted({d[2] for d in dealt if d[2] >= first})
    deal = rows.sparkSession.createDataFrame(dealt, "shape long, at long, segment int")
    small = rows.join(F.broadcast(deal.select("shape").distinct()), "shape", "left_anti")
    parts = rows.withColumn("at", at).join(F.broadcast(deal), ["shape", "at"]).repartitionById(n, "segment").sortWithinPartitions("segment", "ts", "line")
    out = _mined_in_segments(_settled(parts.select("shape", "segment", "step", "line")), chains, most)
    return _mined(small, most).unionByName(out).groupBy("pattern", "step").agg(F.sum("count").alias("count"))


def _mined_in_segments(parts: DataFrame, chains: dict[int, list[int]], most: int) -> DataFrame:
    """parts: a segment in each partition, in order; chains: the segments of each shape in order of time."""

    def through(batches: Iterator[pd.DataFrame], starts: dict[int, dict], seen: Callable[[Clusters, int, int], None]) -> tuple[Clusters, pd.DataFrame] | None:
        c = batch = None
        for batch in batches:
            if c is None:
                start = starts.get(int(batch["segment"].iloc[0]))
                if start is None:
                    return None  # not in this round
                c = Clusters(most, start["kept"], start["next"])
            for line, s in zip(batch["line"], batch["step"], strict=True):
                if words := _words(line):
                    seen(c, c.add(words), s)
        return None if c is None else (c, batch)

    def round_of(starts: dict[int, dict]) -> dict[int, dict]:
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            if done := through(batches, starts, lambda c, k, s: None):
                yield pd.DataFrame({"segment": [int(done[1]["segment"].iloc[0])], "state": [json.dumps(done[0].state())]})

        return {r["segment"]: json.loads(r["state"]) for r in parts.mapInPandas(run, "segment int, state string").collect()}

    state = {shape: {"kept": [], "next": 0} for shape in chains}
    at, width, starts = dict.fromkeys(chains, 0), dict.fromkeys(chains, 1), {}
    while any(at[shape] < len(chain) for shape, chain in chains.items()):
        now = {shape: chain[at[shape] : at[shape] + width[shape]] for shape, chain in chains.items()}
        ends = round_of({x: state[shape] for shape, xs in now.items() for x in xs})
        for shape, xs in now.items():
            for i, x in enumerate(xs):
                end = ends[x]
                if i and end["evicted"]:  # which cluster leaves depends on what the segments before it used
                    width[shape] = 1
                    break
                starts[x], at[shape] = state[shape], at[shape] + 1
                used = set(end["used"])
                kept = end["kept"] if end["changed"] and not i else _reordered(state[shape]["kept"], end, used)
                state[shape] = {"kept": kept, "next": end["next"]}
                if end["changed"]:
                    width[shape] = 1
                    break
            else:
                width[shape] *= 8

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts: dict[tuple[int, int], int] = {}

        def seen(c: Clusters, k: int, s: int) -> None:
            counts[k, s] = counts.get((k, s), 0) + 1

        if done := through(batches, starts, seen):
            c, batch = done
            out = [(k, s, n, None) for (k, s), n in counts.items()] + [(k, None, None, c.rendered(k)) for k in c.gone]
            yield pd.DataFrame(out, columns=["k", "step", "n", "pattern"]).assign(shape=batch["shape"].iloc[0]).astype({"step": "Int64", "n": "Int64"})

    schema = "k long, step long, n long, pattern string, shape long"
    left = [(k, None, None, " ".join(c), shape) for shape, s in state.items() for k, c in s["kept"]]
    every = parts.mapInPandas(count, schema).unionByName(parts.sparkSession.createDataFrame(left, schema))
    # The text of a cluster is what it was when it left, or is in the end: one row of it has that.
    by = every.groupBy("shape", "k").agg(F.max("pattern").alias("pattern"), F.collect_list(F.when(F.col("n").isNotNull(), F.struct("step", "n"))).alias("c"))
    return by.select("pattern", F.explode("c").alias("c")).select("pattern", "c.step", F.col("c.n").alias("count"))


def _reordered(kept: list, end: dict, used: set[int]) -> list:
    """The clusters after a segment that was started with these in an older order of use."""
    words = dict(end["kept"] if end["changed"] else kept)
    return [(k, words[k]) for k, _ in kept if k not in used] + [(k, words[k]) for k in end["used"]]


def _mined(rows: DataFrame, most: int) -> DataFrame:
    """pattern, step, count of shapes that one task each takes."""

    def mine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shapes: dict[int, Clusters] = {}
        counts: dict[tuple[int, int, int], int] = {}
        last = None

        def flush(shape: int) -> pd.DataFrame:
            c = shapes.pop(shape)
            out = [(c.rendered(k), s, n) for (h, k, s), n in counts.items() if h == shape]
            for key in [x for x in counts if x[0] == shape]:
                del counts[key]
            return pd.DataFrame(out, columns=["pattern", "step", "count"])

        for batch in batches:
            for line, h, s in zip(batch["line"], batch["shape"], batch["step"], strict=True):
                if last is not None and h != last and last in shapes:
                    yield flush(last)
                last = h
                if words := _words(line):
                    k = shapes.setdefault(h, Clusters(most)).add(words)
                    counts[h, k, s] = counts.get((h, k, s), 0) + 1
        for h in list(shapes):
            yield flush(h)

    return rows.repartition("shape").sortWithinPartitions("shape", "ts", "line").mapInPandas(mine, "pattern string, step long, count long")
