"""Suffix-array dedup: bytes under strings of `LENGTH` bytes that also start earlier go.

A string's anchor is its leftmost least-hashed k-gram; equal strings have it at the same place, so only strings around equal
anchors can be equal, and a few percent of the positions are anchors. The strings of neighbouring starts with one anchor
are a context, some 130 bytes.
1. Blocks of documents send a hash of each anchor and context, packed, to buckets of anchors. Of equal contexts all but the
   first are repeats as a whole. A first one stays in question only if its anchor has other contexts.
2. Contexts in question go to buckets with their bytes. Stretches of strings that occur in more than one of them are cut out,
   equal stretches collapse to the first, and the suffix array of the stretches of an anchor, by the linear Lyndon grouping
   construction, brings equal strings together: each run of suffixes with LENGTH bytes in common keeps its first only.
   Anchors with more than `HOT` contexts (inside a common line, say) go by hashes of single strings instead, through step 1.
3. Spans of repeats come back to the blocks, and their union leaves the texts.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts_for, table
from .lyndon_suffixes import suffix_array
from .shingles import mixed

LENGTH, GRAM, PACK_BYTES, HOT = 100, 32, 16_000_000, 20_000
_M = np.uint64(0x9E3779B97F4A7C15)
_BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_PLACE = np.uint64((1 << 32) - 1)


def _squeeze(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes() if isinstance(x, np.ndarray) else x)


def _open(x: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(x)


def _numbers(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(_open(x), kind)


def gram_hashes(raw: np.ndarray, *lengths: int) -> list[np.ndarray]:
    """Hashes of all substrings of each length, by doubling."""
    levels = {1: _BYTES[raw]}
    size = 1
    while size * 2 <= max(lengths):
        h = levels[size]
        levels[size * 2] = mixed(h[: max(len(h) - size, 0)] * _M + h[size:])
        size *= 2
    out = []
    for length in lengths:
        h, done = None, 0
        for size in sorted(levels, reverse=True):
            if length & size:
                part = levels[size][done:]
                h = part if h is None else mixed(h[: len(part)] * _M + part[: len(h)])
                done += size
        out.append(h)
    return out


def _least(a: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each window."""
    size = 1
    while size * 2 <= width:
        a = np.minimum(a[:-size], a[size:])
        size *= 2
    return np.minimum(a[: len(a) - (width - size)], a[width - size :]) if width > size else a


def contexts(raw: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Anchor hash, context hash, first start and number of starts of the contexts of one text."""
    if len(raw) < length:
        none = np.zeros(0, np.uint64)
        return none, none, np.zeros(0, np.int64), np.zeros(0, np.int64)
    h, whole = gram_hashes(raw, gram, length)
    whole = whole[: len(raw) - length + 1]
    # The high bits order k-grams, the place breaks ties to the left. Texts beyond 4 GB are no texts of a row.
    anchor = (_least((h & ~_PLACE) | np.arange(len(h), dtype=np.uint64), length - gram + 1) & _PLACE).astype(np.int64)[: len(whole)]
    first = np.flatnonzero(np.r_[True, anchor[1:] != anchor[:-1]])
    last = np.r_[first[1:], len(anchor)] - 1
    at = anchor[first]
    # Two strings cover the context, as it has fewer starts than a string has bytes.
    key = mixed((whole[first] * _M + whole[last]) * _M + ((last - first) * length + at - first).astype(np.uint64))
    return h[at], key, first, last - first + 1


def pack_texts(docs: DataFrame) -> DataFrame:
    """block, ids, sizes, bytes: documents in blocks of bounded size."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([ids], pa.list_(pa.int64())), pa.array([np.array([len(t) for t in texts], np.int64).tobytes()]), pa.array([_squeeze(b"".join(texts))])], ["ids", "sizes", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                ids.append(batch.column(0)[i].as_py())
                texts.append((batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass"))
                size += len(texts[-1])
                if size >= PACK_BYTES:
                    yield flush()
                    ids, texts, size = [], [], 0
        if ids:
            yield flush()

    packed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "ids array<long>, sizes binary, bytes binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


class _Entries:
    """The contexts of a block, in the order of questions: by bucket, then anchor, context, doc_id and start."""

    def __init__(self, row: dict, buckets: int):
        self.raw = np.frombuffer(_open(row["bytes"]), np.uint8)
        sizes = np.frombuffer(row["sizes"], np.int64)
        starts = np.cumsum(sizes) - sizes
        parts = [contexts(self.raw[a : a + n]) for a, n in zip(starts, sizes, strict=True)]
        a, c, first, count = (np.concatenate([p[i] for p in parts]) for i in range(4))
        doc = np.repeat(np.arange(len(sizes)), [len(p[0]) for p in parts])
        # Null ids come first. A row that repeats a doc_id comes later by its place.
        ids = np.array([-(1 << 63) if i is None else i for i in row["ids"]], np.int64)
        order = np.lexsort((first, doc, ids[doc], c, a, a % np.uint64(buckets)))
        self.anchor, self.key, self.first, self.count, self.doc = a[order], c[order], first[order], count[order], doc[order]
        self.ids, self.starts = ids[self.doc], starts
        new = np.ones(len(order), bool)
        new[1:] = (self.anchor[1:] != self.anchor[:-1]) | (self.key[1:] != self.key[:-1])
        self.asked = np.flatnonzero(new)  # the first of each context in this block; the others are repeats
        self.again = np.flatnonzero(~new)
        self.cuts = np.searchsorted((self.anchor % np.uint64(buckets))[self.asked], np.arange(buckets + 1))

    def spans(self, at: np.ndarray) -> np.ndarray:
        """(start in the block, number of starts) of entries."""
        return np.stack([self.starts[self.doc[at]] + self.first[at], self.count[at]], 1)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


_ASK = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("p", pa.binary())])
_ASK_DDL = "bucket int, block long, a binary, c binary, d binary, p binary"


def judge_contexts(asked: DataFrame, hot: int) -> DataFrame:
    """An answer for each question, in its order: 0 new and alone, 1 a repeat, 2 in question, 3 in question under a hot anchor."""

    def judge(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, parts = [], []
        for batch in batches:
            for row in _rows(batch):
                blocks.append(row["block"])
                parts.append((_numbers(row["a"], np.uint64), _numbers(row["c"], np.uint64), _numbers(row["d"], np.int64), _numbers(row["p"], np.int64)))
        turn = sorted(range(len(blocks)), key=blocks.__getitem__)  # for rows that repeat a doc_id
        blocks, parts = [blocks[i] for i in turn], [parts[i] for i in turn]
        cuts = np.cumsum([0] + [len(p[0]) for p in parts])
        a, c, d, p = (np.concatenate([x[i] for x in parts]) for i in range(4))
        del parts
        order = np.lexsort((p, d, c, a))
        a, c = a[order], c[order]
        group = np.ones(len(a), bool)
        group[1:] = a[1:] != a[:-1]
        first = group.copy()
        first[1:] |= c[1:] != c[:-1]
        number = np.cumsum(group) - 1
        kinds = np.bincount(number, first)[number]
        answer = np.empty(len(a), np.uint8)
        answer[order] = np.where(~first, 1, np.where(kinds > hot, 3, np.where(kinds > 1, 2, 0)))
        for i, block in enumerate(blocks):
            yield pa.RecordBatch.from_arrays([pa.array([block]), pa.array([key[0].as_py()], pa.int32()), pa.array([_squeeze(answer[cuts[i] : cuts[i + 1]])])], ["block", "bucket", "answer"])

    return asked.groupBy("bucket").applyInArrow(judge, "block long, bucket int, answer binary")


_SEND = pa.schema([("kind", pa.int32()), ("bucket", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("c", pa.binary()), ("d", pa.binary()), ("p", pa.binary()), ("o", pa.binary()), ("n", pa.binary()), ("b", pa.binary())])
_SEND_DDL = "kind int, bucket int, block long, a binary, c binary, d binary, p binary, o binary, n binary, b binary"


def repeated_strings(anchors: np.ndarray, order_of: np.ndarray, offsets: np.ndarray, counts: np.ndarray, data: np.ndarray, length: int = LENGTH) -> list[tuple[int, int, int]]:
    """(context, first start, number of starts) of the strings that an earlier context has.

    order_of ranks the contexts by document and start; offsets are the anchors' places in them; data has their bytes, one
    after the other, count + length - 1 each. Contexts are distinct.
    """
    sizes = counts + length - 1
    starts = np.cumsum(sizes) - sizes
    (whole,) = gram_hashes(data, length)
    of = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(of)) - np.repeat(np.cumsum(counts) - counts, counts)
    key = mixed((whole[starts[of] + place] * _M + anchors[of]) * _M + (offsets[of] - place).astype(np.uint64))
    sort = np.argsort(key, kind="stable")
    k = key[sort]
    twice = np.zeros(len(k), bool)
    twice[1:] = k[1:] == k[:-1]
    twice[:-1] |= twice[1:].copy()
    often = np.zeros(len(k), bool)
    often[sort] = twice
    at = np.flatnonzero(often)
    if not len(at):
        return []
    new = np.r_[True, (np.diff(at) > 1) | (of[at][1:] != of[at][:-1])]
    begin = at[new]
    end = at[np.r_[new[1:], True]] + 1
    stretches: dict[tuple, list[tuple[int, int, int]]] = defaultdict(list)  # by anchor, place and bytes
    raw = data.tobytes()
    for i, s, n in zip(of[begin].tolist(), place[begin].tolist(), (end - begin).tolist(), strict=True):
        low = int(starts[i]) + s
        stretches[int(anchors[i]), int(offsets[i]) - s, raw[low : low + n + length - 1]].append((int(order_of[i]), i, s))
    out: list[tuple[int, int, int]] = []
    by_anchor: dict[int, list[tuple[int, int, int, bytes]]] = defaultdict(list)
    for (anchor, _, text), seen in stretches.items():
        seen.sort()
        n = len(text) - length + 1
        out += [(i, s, n) for _, i, s in seen[1:]]
        by_anchor[anchor].append((*seen[0], text))
    for group in by_anchor.values():
        if len(group) > 1:
            out += _suffix_repeats(group, length)
    return out


def _suffix_repeats(group: list[tuple[int, int, int, bytes]], length: int) -> list[tuple[int, int, int]]:
    """The same for the stretches (rank, context, start, bytes) of one anchor, by their suffix array."""
    symbols: list[int] = []
    owner: list[int] = []
    for g, (_, _, _, text) in enumerate(group):
        symbols += [c + 1 for c in text]
        symbols.append(0)
        n = len(text) - length + 1
        owner += [g] * n + [-1] * length
    joined = b"\0".join(g[3] for g in group)
    out = []
    run: list[tuple[int, int, int]] = []  # rank, context, start
    last = None
    bases = np.cumsum([0] + [len(g[3]) + 1 for g in group]).tolist()
    for i in suffix_array(symbols):
        g = owner[i]
        if g < 0:
            continue
        string = joined[i : i + length]
        if string != last:
            if len(run) > 1:
                out += [(c, s, 1) for _, c, s in sorted(run)[1:]]
            run, last = [], string
        rank, context, start, _ = group[g]
        run.append((rank, context, start + i - bases[g]))
    if len(run) > 1:
        out += [(c, s, 1) for _, c, s in sorted(run)[1:]]
    return out


def find_repeats(packs: DataFrame, buckets: int, hot: int = HOT) -> DataFrame:
    """block, spans: packed pairs (start in the block, number of starts) of the strings that start earlier, too."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                e = _Entries(row, buckets)
                out = []
                for k, (a, b) in enumerate(zip(e.cuts, e.cuts[1:], strict=False)):
                    if b > a:
                        at = e.asked[a:b]
                        out.append({"bucket": k, "block": row["block"], "a": _squeeze(e.anchor[at]), "c": _squeeze(e.key[at]), "d": _squeeze(e.ids[at]), "p": _squeeze(e.first[at])})
                yield pa.RecordBatch.from_pylist(out, _ASK)

    answers = judge_contexts(packs.select("block", "ids", "sizes", "bytes").mapInArrow(ask, _ASK_DDL), hot)
    told = packs.join(answers.groupBy("block").agg(F.collect_list(F.struct("bucket", "answer")).alias("answers")), "block", "left")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Kind 0: spans that are repeats already. Kind 1: contexts in question. Kind 2: the strings under hot anchors."""
        for batch in batches:
            for row in _rows(batch):
                e = _Entries(row, buckets)
                answer = np.zeros(len(e.asked), np.uint8)
                for a in row["answers"] or []:
                    answer[e.cuts[a["bucket"]] : e.cuts[a["bucket"] + 1]] = _numbers(a["answer"], np.uint8)
                blank = dict.fromkeys(_SEND.names) | {"block": row["block"]}
                again = np.concatenate([e.again, e.asked[answer == 1]])
                out = [blank | {"kind": 0, "bucket": int(row["block"] % buckets), "b": _squeeze(e.spans(again))}]
                at = e.asked[answer == 2]
                if len(at):
                    base = e.starts[e.doc[at]] + e.first[at]
                    offset = _anchor_places(e, at)
                    cuts = np.searchsorted(e.anchor[at] % np.uint64(buckets), np.arange(buckets + 1))
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if y > x:
                            s = slice(x, y)
                            text = b"".join(e.raw[p : p + n + LENGTH - 1].tobytes() for p, n in zip(base[s].tolist(), e.count[at][s].tolist(), strict=True))
                            out.append(blank | {"kind": 1, "bucket": k, "a": _squeeze(e.anchor[at][s]), "d": _squeeze(e.ids[at][s]), "c": _squeeze(e.first[at][s]), "p": _squeeze(base[s]), "o": _squeeze(offset[s]), "n": _squeeze(e.count[at][s]), "b": _squeeze(text)})
                at = e.asked[answer == 3]
                if len(at):
                    n = e.count[at]
                    of = np.repeat(np.arange(len(at)), n)
                    place = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
                    base = (e.starts[e.doc[at]] + e.first[at])[of] + place
                    h = np.concatenate([gram_hashes(e.raw[p : p + m + LENGTH - 1], LENGTH)[0] for p, m in zip((e.starts[e.doc[at]] + e.first[at]).tolist(), n.tolist(), strict=True)])
                    d, p = e.ids[at][of], e.first[at][of] + place
                    order = np.lexsort((p, d, h, h % np.uint64(buckets)))
                    h, d, p, base = h[order], d[order], p[order], base[order]
                    cuts = np.searchsorted(h % np.uint64(buckets), np.arange(buckets + 1))
                    for k, (x, y) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        if y > x:
                            out.append(blank | {"kind": 2, "bucket": k, "a": _squeeze(h[x:y]), "d": _squeeze(d[x:y]), "c": _squeeze(p[x:y]), "p": _squeeze(base[x:y])})
                yield pa.RecordBatch.from_pylist(out, _SEND)

    def resolve(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[int, list[np.ndarray]] = defaultdict(list)
        parts, strings = [], []
        for batch in batches:
            for row in _rows(batch):
                if row["kind"] == 0:
                    found[row["block"]].append(_numbers(row["b"], np.int64).reshape(-1, 2))
                elif row["kind"] == 1:
                    parts.append((row["block"], *(_numbers(row[k], np.uint64 if k == "a" else np.int64) for k in "adcpon"), _open(row["b"])))
                else:
                    strings.append((row["block"], *(_numbers(row[k], np.uint64 if k == "a" else np.int64) for k in "adcp")))
        if parts:
            block = np.repeat(np.array([x[0] for x in parts], np.int64), [len(x[1]) for x in parts])
            a, d, first, base, offset, count = (np.concatenate([x[i] for x in parts]) for i in range(1, 7))
            rank = np.empty(len(a), np.int64)
            rank[np.lexsort((first, block, d))] = np.arange(len(a))
            hits = repeated_strings(a, rank, offset, count, np.frombuffer(b"".join(x[7] for x in parts), np.uint8))
            if hits:
                c, s, n = np.array(hits, np.int64).T
                _add(found, block[c], np.stack([base[c] + s, n], 1))
        if strings:
            block = np.repeat(np.array([x[0] for x in strings], np.int64), [len(x[1]) for x in strings])
            h, d, p, base = (np.concatenate([x[i] for x in strings]) for i in range(1, 5))
            order = np.lexsort((p, block, d, h))
            again = order[1:][h[order][1:] == h[order][:-1]]
            _add(found, block[again], np.stack([base[again], np.ones(len(again), np.int64)], 1))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.int64()), pa.array([_squeeze(np.concatenate(v)) for v in found.values()])], ["block", "spans"])

    sent = told.select("block", "ids", "sizes", "bytes", "answers").mapInArrow(send, _SEND_DDL)
    return sent.groupBy("bucket").applyInArrow(resolve, "block long, spans binary")


def _add(found: dict[int, list[np.ndarray]], block: np.ndarray, spans: np.ndarray) -> None:
    order = np.argsort(block, kind="stable")
    names, starts = np.unique(block[order], return_index=True)
    for b, part in zip(names.tolist(), np.split(spans[order], starts[1:]), strict=True):
        found[b].append(part)


def _anchor_places(e: _Entries, at: np.ndarray) -> np.ndarray:
    """Where the anchor lies in each context: its last string's window begins at or before it, so it is looked for by its hash."""
    out = np.empty(len(at), np.int64)
    for i, (p, n, a) in enumerate(zip((e.starts[e.doc[at]] + e.first[at]).tolist(), e.count[at].tolist(), e.anchor[at].tolist(), strict=True)):
        h = gram_hashes(e.raw[p : p + n + LENGTH - 1], GRAM)[0]
        hits = np.flatnonzero(h[n - 1 : LENGTH - GRAM + 1] == np.uint64(a))
        out[i] = n - 1 + hits[0]
    return out


def removed_runs(spans: list[np.ndarray], starts: np.ndarray, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of the maximal runs of bytes under spans (start, number of starts) in a block of documents that begin at starts."""
    if not spans or not sum(map(len, spans)):
        return (np.zeros(0, np.int64),) * 3
    low, count = np.concatenate(spans).T
    order = np.argsort(low, kind="stable")
    low, high = low[order], (low + count + length - 1)[order]
    doc = np.searchsorted(starts, low, "right") - 1
    end = np.maximum.accumulate(high)  # spans never cross documents
    new = np.r_[True, (low[1:] > end[:-1]) | (doc[1:] != doc[:-1])]
    return doc[new], low[new], end[np.r_[new[1:], True]]


def _without(raw: bytes, at: int, size: int, low: list[int], high: list[int]) -> tuple[int, int, int, bytes]:
    """Size, removed bytes, runs and kept bytes of a document."""
    if not low:
        return size, 0, 0, raw[at : at + size]
    kept = b"".join(raw[a:b] for a, b in zip([at, *high], [*low, at + size], strict=True))
    return size, size - len(kept), len(low), kept


def dedup_substrings(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (binary: the remaining bytes).

    Null and empty texts have no bytes. Order is by doc_id (null first), then start; rows that repeat a doc_id come in any
    fixed order, so of equal ones all but one go. Strings never cross documents and are judged on the input.
    """
    spark = docs.sparkSession
    chars = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    packs = cut(pack_texts(docs))
    spans = find_repeats(packs, parts_for(spark, chars / 1e6, 12))
    full = packs.join(spans.groupBy("block").agg(F.collect_list("spans").alias("spans")), "block", "left")

    def remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _rows(batch):
                raw, sizes = _open(row["bytes"]), np.frombuffer(row["sizes"], np.int64)
                starts = np.cumsum(sizes) - sizes
                doc, low, high = removed_runs([_numbers(s, np.int64).reshape(-1, 2) for s in row["spans"] or []], starts)
                cuts = np.searchsorted(doc, np.arange(len(sizes) + 1))
                for at in range(0, len(sizes), 256):
                    part = [_without(raw, int(starts[i]), int(sizes[i]), low[cuts[i] : cuts[i + 1]].tolist(), high[cuts[i] : cuts[i + 1]].tolist()) for i in range(at, min(at + 256, len(sizes)))]
                    yield pa.RecordBatch.from_arrays([pa.array(row["ids"][at : at + 256], pa.int64()), *(pa.array([x[i] for x in part], pa.int64()) for i in range(3)), pa.array([x[3] for x in part], pa.binary())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return full.select("ids", "sizes", "bytes", "spans").mapInArrow(remove, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = dedup_substrings(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2(F.col("kept"), 256).alias("kept_sha256"))


QUERIES = {"op8_suffix_dedup": op8_suffix_dedup}
ORACLES: dict[str, str] = {}
