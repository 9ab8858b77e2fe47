"""N-gram Jaccard join by a blocked sparse matrix product of the document by n-gram incidence.

1. Columns: blocks of documents send their shingle hashes, packed, to buckets of hashes; a bucket counts in how many distinct
   sets each is (exact copies of a set count once) and gives back the entries of those in two or more - the only columns that
   add to an overlap.
2. Rows: a set of n shingles needs ceil(0.8 n) of them in such columns to reach the threshold with any other; other rows go.
   Ordered by (frequency, hash), two sets that reach it share a column among their first n - ceil(0.8 n) + 1, of which
   those with frequency one come first and can be skipped.
3. Blocks: rows are sorted by their most frequent column, so that groups of near copies lie together, and cut into blocks of
   bounded size. Pairs of blocks that share such a leading column, with compatible sizes, are multiplied, some columns at a
   time; overlaps accumulate, and pairs of rows go as soon as their sizes and the columns left cannot reach the threshold.
   A product gives a spanning forest of its links, not all of them.
4. Components of the links, with the copies of each set.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts_for, table
from .components import connected_components
from .shingles import Shingler, set_key

#: A set gives a row to each bucket in which it shares columns; with as many buckets as sets share columns, rows grow as the input does.
LEAST_BUCKETS = 64
PACK, BLOCK_ROWS, BLOCK_ENTRIES, COLUMNS = 2_000_000, 128, 150_000, 4096


def _squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes())


def _numbers(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def linked(overlap, n1, n2):
    """100 * intersection >= 80 * union, by the overlap and the sizes."""
    return 9 * overlap >= 4 * (n1 + n2)


def document_sets(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """doc_id, n (distinct shingles), cls (a key of the set); with keyed also t1, t2 (hashes of the text)."""
    hashes = ["t1", "t2"] if keyed else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        for batch in batches:
            sets = [shingler.shingles(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(s) for s in sets], pa.int64()), pa.array([set_key(s) for s in sets], pa.int64()), *(batch.column(h) for h in hashes)], ["doc_id", "n", "cls", *hashes])

    further = [c.alias(h) for c, h in zip(text_key(F.col("text")), hashes, strict=False)]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *further).mapInArrow(run, ", ".join(f"{c} long" for c in ["doc_id", "n", "cls", *hashes]))


def text_key(text: Column) -> tuple[Column, Column]:
    """Two hashes by which a text is known."""
    return F.xxhash64(text), F.xxhash64(text, F.lit(1))


def shared_columns(docs: DataFrame, buckets: int) -> DataFrame:
    """cls, n, h, df (packed): the entries of sets in columns that at least two distinct sets have, a row for each set and bucket.

    A bucket is a range of hashes, so that it stands for their highest bits, and 7 of their 8 bytes are sent.
    Frequencies stop at 255: they order columns, and any order that all rows share will do.
    """

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingler = Shingler()
        sets: dict[int, np.ndarray] = {}
        size = 0

        def flush() -> pa.RecordBatch:
            keys = np.array(list(sets), np.int64)
            sizes = np.array([len(s) for s in sets.values()], np.int64)
            h = np.concatenate(list(sets.values()))
            row = np.repeat(np.arange(len(keys), dtype=np.uint32), sizes)
            bucket = (((h >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int32)
            order = np.argsort(bucket, kind="stable")
            cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
            h, row = h[order], row[order]
            names = pa.array([keys.tobytes()] * buckets, pa.binary()), pa.array([_squeeze(sizes)] * buckets, pa.binary())
            out = [pa.array(np.arange(buckets, dtype=np.int32)), *names, pa.array([h[a:b].view(np.uint8).reshape(-1, 8)[:, :7].tobytes() for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary()), pa.array([_squeeze(row[a:b]) for a, b in zip(cuts, cuts[1:], strict=False)], pa.binary())]
            return pa.RecordBatch.from_arrays(out, ["bucket", "keys", "sizes", "h", "row"])

        for batch in batches:
            for t in batch.column(0):
                s = shingler.shingles(t.as_py())
                if len(s) and (k := set_key(s)) not in sets:
                    sets[k] = s
                    size += len(s)
                    if size >= PACK:
                        yield flush()
                        sets, size = {}, 0
        if sets:
            yield flush()

    def count(key: tuple, packs: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hs, keys, sizes = [], [], []
        for batch in packs:
            for i in range(batch.num_rows):
                k = np.frombuffer(batch.column(1)[i].as_py(), np.int64)
                n = _numbers(batch.column(2)[i].as_py(), np.int64)
                low = np.frombuffer(batch.column(3)[i].as_py(), np.uint8).reshape(-1, 7)
                wide = np.zeros((len(low), 8), np.uint8)
                wide[:, :7] = low
                h = wide.view(np.uint64).ravel()
                row = _numbers(batch.column(4)[i].as_py(), np.uint32)
                hs.append(h), keys.append(k[row]), sizes.append(n[row].astype(np.int32))
        h, k, n = np.concatenate(hs), np.concatenate(keys), np.concatenate(sizes)
        hs, keys, sizes = [], [], []
        order = np.argsort(h, kind="stable")
        h = h[order]
        near = np.zeros(len(h), bool)
        near[1:] = h[1:] == h[:-1]
        near[:-1] |= near[1:].copy()
        h, k, n = h[near], k[order[near]], n[order[near]]
        order = np.lexsort((k, h))
        h, k, n = h[order], k[order], n[order]
        first = np.ones(len(h), bool)
        first[1:] = (h[1:] != h[:-1]) | (k[1:] != k[:-1])
        h, k, n = h[first], k[first], n[first]
        _, place, df = np.unique(h, return_inverse=True, return_counts=True)
        keep = (df > 1)[place]
        h, k, n, df = h[keep] | (np.uint64(key[0].as_py() & 255) << np.uint64(56)), k[keep], n[keep], np.minimum(df[place][keep], 255).astype(np.uint8)
        order = np.argsort(k, kind="stable")
        h, k, n, df = h[order], k[order], n[order], df[order]
        at = np.flatnonzero(np.r_[True, k[1:] != k[:-1]]) if len(k) else np.zeros(0, np.int64)
        end = np.r_[at[1:], len(k)][: len(at)]
        for low in range(0, max(len(at), 1), 50_000):
            spans = [*zip(at[low : low + 50_000].tolist(), end[low : low + 50_000].tolist(), strict=True)]
            part = at[low : low + 50_000]
            yield pa.RecordBatch.from_arrays([pa.array(k[part]), pa.array(n[part].astype(np.int64)), pa.array([h[x:y].tobytes() for x, y in spans], pa.binary()), pa.array([df[x:y].tobytes() for x, y in spans], pa.binary())], ["cls", "n", "h", "df"])

    packed = docs.select("text").mapInArrow(pack, "bucket int, keys binary, sizes binary, h binary, row binary")
    return packed.groupBy("bucket").applyInArrow(count, "cls long, n long, h binary, df binary")


def candidate_rows(entries: DataFrame) -> DataFrame:
    """cls, n, columns (sorted by frequency), lead (the columns of the prefix that others may share), label (the most frequent column)."""

    def arrange(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns, leads, labels = [], [], []
            for n, parts in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                h = np.frombuffer(b"".join([p["h"] for p in parts]), np.int64)
                h = h[np.lexsort((h, np.frombuffer(b"".join([p["df"] for p in parts]), np.uint8)))]
                columns.append(h)
                leads.append(h[: len(h) + (-4 * n // 5) + 1])
                labels.append(int(h[-1]))
            kind = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(columns, kind), pa.array(leads, kind), pa.array(labels, pa.int64())], ["cls", "n", "columns", "lead", "label"])

    rows = entries.groupBy("cls", "n").agg(F.sum(F.octet_length("df")).alias("m"), F.collect_list(F.struct("h", "df")).alias("parts"))
    return rows.filter("5 * m >= 4 * n").select("cls", "n", "parts").mapInArrow(arrange, "cls long, n long, columns array<long>, lead array<long>, label long")


def row_blocks(rows: DataFrame, partitions: int) -> DataFrame:
    """block, cls, n, offsets and columns as packed arrays, lead (structs of column, n): a row for each block of bounded size."""
    lead = pa.list_(pa.struct([("h", pa.int64()), ("n", pa.int64())]))

    def cut_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict] = []
        size = 0

        def flush() -> pa.RecordBatch:
            cls = np.array([r["cls"] for r in held], np.int64)
            n = np.array([r["n"] for r in held], np.int64)
            offsets = np.cumsum([0] + [len(r["columns"]) for r in held])
            columns = np.concatenate([np.sort(np.array(r["columns"], np.int64)) for r in held])
            spans: dict[int, tuple[int, int]] = {}
            for r in held:
                for h in r["lead"]:
                    low, high = spans.get(h, (r["n"], r["n"]))
                    spans[h] = (min(low, r["n"]), max(high, r["n"]))
            leads = [{"h": h, "n": v} for h, s in spans.items() for v in sorted({*s})]
            return pa.RecordBatch.from_arrays([pa.array([held[0]["cls"]]), *(pa.array([x.astype(np.int64).tobytes()], pa.binary()) for x in (cls, n, offsets, columns)), pa.array([leads], lead)], ["block", "cls", "n", "offsets", "columns", "lead"])

        for batch in batches:
            for r in batch.to_pylist():
                if held and (len(held) >= BLOCK_ROWS or size + len(r["columns"]) > BLOCK_ENTRIES):
                    yield flush()
                    held, size = [], 0
                held.append(r)
                size += len(r["columns"])
        if held:
            yield flush()

    dealt = rows.repartitionByRange(partitions, "label", "n", "cls").sortWithinPartitions("label", "n", "cls")
    return dealt.select("cls", "n", "columns", "lead").mapInArrow(cut_up, "block long, cls binary, n binary, offsets binary, columns binary, lead array<struct<h:long,n:long>>")


def _product(a: tuple, b: tuple, same: bool) -> Iterator[tuple[int, int]]:
    """A spanning forest of the linked rows of two blocks, each (cls, n, offsets, columns)."""
    (ka, na, oa, ca), (kb, nb, ob, cb) = a, b
    ra, rb = np.repeat(np.arange(len(ka)), np.diff(oa)), np.repeat(np.arange(len(kb)), np.diff(ob))
    common = np.intersect1d(ca, cb) if not same else np.unique(ca)
    pa_, pb_ = np.searchsorted(common, ca), np.searchsorted(common, cb)
    ia = (pa_ < len(common)) & (common[np.minimum(pa_, len(common) - 1)] == ca) if len(common) else np.zeros(len(ca), bool)
    ib = (pb_ < len(common)) & (common[np.minimum(pb_, len(common) - 1)] == cb) if len(common) else np.zeros(len(cb), bool)
    ra, pa_, rb, pb_ = ra[ia], pa_[ia], rb[ib], pb_[ib]
    alive = linked(np.minimum(na[:, None], nb[None, :]), na[:, None], nb[None, :])
    if same:
        alive &= np.triu(np.ones_like(alive), 1)
    else:
        alive &= ka[:, None] != kb[None, :]
    overlap = np.zeros(alive.shape, np.float32)
    left_a, left_b = np.bincount(ra, minlength=len(ka)), np.bincount(rb, minlength=len(kb))
    sizes = na[:, None] + nb[None, :]
    for low in range(0, len(common), COLUMNS):
        alive &= 9 * (overlap + np.minimum(left_a[:, None], left_b[None, :])) >= 4 * sizes
        if not alive.any():
            return
        wide = min(COLUMNS, len(common) - low)
        sa, sb = (pa_ >= low) & (pa_ < low + wide), (pb_ >= low) & (pb_ < low + wide)
        da, db = np.zeros((len(ka), wide), np.float32), np.zeros((len(kb), wide), np.float32)
        da[ra[sa], pa_[sa] - low] = 1
        db[rb[sb], pb_[sb] - low] = 1
        overlap += da @ db.T
        left_a, left_b = left_a - np.bincount(ra[sa], minlength=len(ka)), left_b - np.bincount(rb[sb], minlength=len(kb))
    x, y = np.nonzero(alive & (9 * overlap >= 4 * sizes))
    root: dict[int, int] = {}

    def find(v: int) -> int:
        while root.setdefault(v, v) != v:
            root[v] = root[root[v]]
            v = root[v]
        return v

    for i, j in zip(ka[x].tolist(), kb[y].tolist(), strict=True):
        p, q = find(i), find(j)
        if p != q:
            root[p] = q
            yield i, j


def block_links(blocks: DataFrame) -> DataFrame:
    """a, b: links between keys of sets that span the components of all links."""
    leads = blocks.select("block", F.explode("lead").alias("l")).groupBy("block", "l.h").agg(F.min("l.n").alias("low"), F.max("l.n").alias("high"))
    x, y = leads.toDF("x", "h", "xl", "xh"), leads.toDF("y", "h", "yl", "yh")
    pairs = x.join(y, "h").filter("x <= y and 5 * yh >= 4 * xl and 5 * xh >= 4 * yl").select("x", "y").distinct()
    data = blocks.select("block", F.struct("cls", "n", "offsets", "columns").alias("d"))
    both = pairs.join(data.toDF("x", "dx"), "x").join(data.toDF("y", "dy"), "y")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                a, b = ({k: np.frombuffer(v, np.int64) for k, v in batch.column(c)[i].as_py().items()} for c in ("dx", "dy"))
                same = batch.column("x")[i].as_py() == batch.column("y")[i].as_py()
                found = [*_product(tuple(a.values()), tuple(b.values()), same)]
                yield pa.RecordBatch.from_arrays([pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.int64())], ["a", "b"])

    return both.select("x", "y", "dx", "dy").mapInArrow(run, "a long, b long")


def near_groups(docs: DataFrame, keyed: bool = False) -> DataFrame:
    """The columns of document_sets and g, a key of the component: those reachable by links of Jaccard similarity 0.8 or more over 5-word shingles."""
    spark = docs.sparkSession
    sets = cut(document_sets(docs, keyed))
    chars = docs.agg(F.sum(F.length("text")).alias("n")).first()["n"] or 0
    buckets = max(LEAST_BUCKETS, parts_for(spark, chars / 1e6, 14))
    rows = candidate_rows(shared_columns(docs, buckets))
    blocks = cut(row_blocks(rows, parts_for(spark, 0)))
    roots = connected_components(block_links(blocks))
    return sets.join(roots.select(F.col("node").alias("cls"), "root"), "cls", "left").withColumn("g", F.coalesce("root", "cls"))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id (the smallest doc_id of its component).

    Null, empty and blank texts have no shingle and form components of their own. Rows that repeat a doc_id are rows of their
    own. Rows with a null doc_id take part; a component's id is the smallest that is not null. Texts of any length count whole:
    a long one is one set, whose columns go to all buckets. Further columns of docs, whatever their names, are not read; an
    empty table gives an empty one.
    """
    keyed = near_groups(docs)
    least = keyed.filter("n > 0").groupBy("g").agg(F.min("doc_id").alias("least"))
    out = keyed.join(least, "g", "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("least")).otherwise(F.col("doc_id")).alias("component_id"))


def near_copies(docs: DataFrame) -> DataFrame:
    """d, t1, t2, first: the rows, by doc_id and hashes of the text, of which not all can stay.

    The first row of a component, by doc_id (nulls last) and text, stays. Keys without first go; those with it are of several
    rows with the same doc_id and text, and one of these stays. Texts without a shingle are in no component and never here.
    """
    keys = cut(near_groups(docs, True).filter("n > 0").groupBy("g", "doc_id", "t1", "t2").agg(F.count("*").alias("rows")))
    key = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "t1", "t2")
    out = keys.join(keys.groupBy("g").agg(F.min(key).alias("least")), "g").withColumn("first", key.eqNullSafe(F.col("least")))
    return out.filter("not first or rows > 1").select(F.col("doc_id").alias("d"), "t1", "t2", "first")


def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))


QUERIES = {"op6_jaccard_join": op6_jaccard_join}
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLES = {
    "op6_jaccard_join": f"""
        WITH RECURSIVE d AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
        s AS (
            SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g
            FROM d
        ),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
        l AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r(doc_id, root) AS (SELECT doc_id, doc_id FROM d UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id AND r.root < e.b)
        SELECT r.doc_id, any_value(coalesce(n.n, 0)) AS n_shingles, min(r.root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
    """
}
