"""Exact top-k search by inner product with the three-phase uniform threshold.

The components of all vectors are dealt into `lists` ranges, whose partial products are the score lists of a query.
Phase 1: each tile of rows gathers the best entries of one list of each query, the lists in turn, and resolves just those; the
k-th best of all resolved scores is a safe cutoff t of the query. Phase 2: t is broadcast; lists are collected one after
the other, each only for the rows and queries with a pair that can still reach t: an entry of at least t / lists is seen or
a list to come may hold one, and the sum so far with the norms of the lists to come (Cauchy-Schwarz) is t at least. Phase 3:
once few pairs of a tile are left, their missing scores are resolved pair by pair, and the k best of each query meet in the end.

Queries are taken in blocks of bounded size against all rows, one pass over the rows for each phase and block.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, table

LISTS, BLOCK, ROWS, QUERIES_AT_ONCE = 4, 8192, 1024, 512
#: Entries a tile and query that phase 1 resolves, as a multiple of k; the share of a tile below which pairs are resolved one by one.
GATHER, SPARSE = 4, 0.04
EXACT = float(1 << 53)


def _matrix(column: pa.ListArray, wide: int | None = None) -> np.ndarray:
    """floor(256 x) of vectors of any lengths, shorter ones filled up with 0."""
    sizes = np.asarray(column.value_lengths().fill_null(0))
    flat = np.floor(np.asarray(column.flatten(), dtype=np.float64) * 256.0)
    width = max(int(sizes.max(initial=0)), wide or 0)
    if len(sizes) and (sizes == width).all():
        return flat.reshape(len(sizes), width)
    out = np.zeros((len(sizes), width))
    out[np.arange(width) < sizes[:, None]] = flat
    return out


class _Side:
    """The queries of a block."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.most = float(np.abs(vectors).max(initial=0))


class _Tile:
    """Some queries and some rows, cut into lists; in whole numbers of any size where doubles could round."""

    def __init__(self, side: _Side, rows: slice, ids: np.ndarray, x: np.ndarray):
        q = side.vectors[rows]
        width = max(q.shape[1], x.shape[1])
        q, x = (np.pad(a, ((0, 0), (0, width - a.shape[1]))) for a in (q, x))
        self.exact = side.most * float(np.abs(x).max(initial=0)) * max(width, 1) * LISTS < EXACT
        if not self.exact:
            q, x = (np.array([[int(v) for v in r] for r in a], dtype=object).reshape(a.shape) for a in (q, x))
        cuts = [width * i // LISTS for i in range(LISTS + 1)]
        self.q, self.x = ([a[:, i:j] for i, j in zip(cuts, cuts[1:], strict=False)] for a in (q, x))
        self.rows, self.ids, self.own = rows, ids, side.ids[rows][:, None] == ids[None, :]
        self.shape = self.own.shape

    def scores(self, j: int, q, x) -> np.ndarray:
        """The j-th list of some queries and rows."""
        a, b = self.q[j][q], self.x[j][x]
        return a @ b.T if a.shape[1] else np.zeros((len(a), len(b)), a.dtype)

    def pairs(self, j: int, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """The j-th list of single pairs."""
        return (self.q[j][q] * self.x[j][x]).sum(1)

    def bounds(self, t: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each list: what all lists after it can add to a pair at most, and whether one of those may hold an entry of t / lists."""
        norms = [np.sqrt((self.q[j] ** 2).sum(1))[:, None] * np.sqrt((self.x[j] ** 2).sum(1))[None, :] * (1 + 1e-9) + 1e-6 for j in range(LISTS)]
        rest, may = [np.zeros(self.shape)], [np.zeros(self.shape, bool)]
        for j in range(LISTS - 1, 0, -1):
            rest.append(rest[-1] + norms[j])
            may.append(may[-1] | (norms[j] * LISTS >= t))
        return rest[::-1], may[::-1]


def _best(q: np.ndarray, ids: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Places of the k entries of each query with the highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -scores, q))
    starts = np.r_[True, q[order][1:] != q[order][:-1]]
    first = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0))
    return order[np.arange(len(order)) - first < k]


def _tiles(batches: Iterator[pa.RecordBatch], side: _Side) -> Iterator[_Tile]:
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            part = batch.slice(at, ROWS)
            ids, x = np.asarray(part.column(0)), _matrix(part.column(1))
            for low in range(0, len(side.ids), QUERIES_AT_ONCE):
                yield _Tile(side, slice(low, min(low + QUERIES_AT_ONCE, len(side.ids))), ids, x)


def gather(batches: Iterator[pa.RecordBatch], side: _Side, k: int, work: dict | None = None) -> "_Kept":
    """Phase 1: resolved entries of each query, at most k. work counts the list entries that are computed."""
    kept, base = _Kept(k), 0
    for n, tile in enumerate(_tiles(batches, side)):
        j, every = n % LISTS, slice(None)
        ranked = np.where(tile.own, -np.inf, tile.scores(j, every, every).astype(np.float64))
        most = min(GATHER * k, len(tile.ids))
        at = np.argpartition(-ranked, most - 1, 1)[:, :most]
        q, x = np.repeat(np.arange(len(at)), most), at.ravel()
        fine = ~tile.own[q, x]
        q, x = q[fine], x[fine]
        kept.add(q + tile.rows.start, x + base, sum(tile.pairs(i, q, x) for i in range(LISTS)))
        _count(work, "gathered", ranked.size + LISTS * len(q))
        base += len(tile.ids)
    return kept


def collect(batches: Iterator[pa.RecordBatch], side: _Side, cutoff: np.ndarray, k: int, work: dict | None = None) -> "_Kept":
    """Phases 2 and 3: the k best of each query among the entries that reach its cutoff."""
    kept = _Kept(k)
    for tile in _tiles(batches, side):
        t = cutoff[tile.rows][:, None]
        alive = ~tile.own
        if tile.exact:
            rest, may = tile.bounds(t)
            partial, seen = np.zeros(tile.shape), np.zeros(tile.shape, bool)
            for j in range(LISTS):
                if alive.mean() < SPARSE:
                    q, x = np.nonzero(alive)
                    score = partial[q, x]
                    for i in range(j, LISTS):
                        score = score + tile.pairs(i, q, x)
                    _count(work, "resolved", len(q) * (LISTS - j))
                    break
                q, x = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
                s = np.full(tile.shape, -np.inf)
                s[np.ix_(q, x)] = tile.scores(j, q, x)
                _count(work, "collected", len(q) * len(x))
                seen |= s * LISTS >= t
                partial = partial + s
                alive &= (partial + rest[j] >= t) & (seen | may[j])
            else:
                q, x = np.nonzero(alive)
                score = partial[q, x]
        else:
            q, x = np.nonzero(alive)
            score = sum(tile.pairs(i, q, x) for i in range(LISTS))
        ok = score >= t[q, 0]
        kept.add(q[ok] + tile.rows.start, tile.ids[x[ok]], score[ok])
    return kept


def _count(work: dict | None, what: str, n: int) -> None:
    if work is not None:
        work[what] = work.get(what, 0) + int(n)


class _Kept:
    """The best entries so far of each query, in bounded space."""

    def __init__(self, k: int):
        self.k, self.parts, self.size = k, [], 0

    def add(self, q: np.ndarray, ids: np.ndarray, scores: np.ndarray) -> None:
        self.parts.append((q.astype(np.int64), ids, scores))
        self.size += len(q)
        if self.size > 400_000:
            self.shrink()

    def shrink(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        if not self.parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        q, ids, s = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        at = _best(q, ids, s, self.k)
        self.parts, self.size = [(q[at], ids[at], s[at])], 0
        return self.parts[0]


def _rows(kept: _Kept, names: np.ndarray | None = None) -> Iterator[pa.RecordBatch]:
    q, ids, s = kept.shrink()
    q = q if names is None else names[q]
    low, high = -(1 << 63), (1 << 63) - 1
    yield pa.RecordBatch.from_arrays([pa.array(q, pa.int64()), pa.array(ids, pa.int64()), pa.array([min(max(int(v), low), high) for v in s], pa.int64())], ["q", "vec_id", "score"])


def top_k(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK) -> DataFrame:
    """query_id, rank, vec_id, score for every row with is_query(vec_id), against all rows but those of its own id.

    Rows with a null id or vector, or with null or non-finite components, take no part. Vectors of different lengths count as
    filled up with zeros; the empty one scores 0 with all. Rows that repeat an id are candidates of their own; repeated queries
    are asked once, with any one of their vectors. Scores are exact whole numbers; beyond 64 bits they stop at the last one.
    """
    spark = vectors.sparkSession
    sound = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    sound = sound.filter(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & F.forall("v", lambda x: F.coalesce((F.abs(x) < float("inf")) & ~F.isnan(x), F.lit(False))))
    asked = sound.filter(is_query(F.col("vec_id"))).dropDuplicates(["vec_id"])
    blocks = max(1, -(-asked.count() // block))
    parts = []
    for b in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == b).toArrow().combine_chunks()  # about `block` vectors
        if not rows.num_rows:
            continue
        order = np.argsort(np.asarray(rows.column(0)))
        column = rows.column(1).combine_chunks()
        side = spark.sparkContext.broadcast(_Side(np.asarray(rows.column(0))[order], _matrix(column)[order]))
        parts.append(_block_top_k(sound, side, k))
    if not parts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _block_top_k(sound: DataFrame, side, k: int) -> DataFrame:
    def first_phase(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(gather(batches, side.value, k))

    first = sound.mapInArrow(first_phase, "q long, vec_id long, score long")
    top = Window.partitionBy("q").orderBy(F.col("score").desc())
    cutoffs = first.withColumn("n", F.row_number().over(top)).filter(F.col("n") <= k).groupBy("q").agg(F.min("score").alias("t"), F.count("*").alias("n")).filter(F.col("n") == k)
    cutoff = np.full(len(side.value.ids), -np.inf)
    for r in cutoffs.select("q", "t").toArrow().to_pylist():  # a number for each query of the block
        cutoff[r["q"]] = r["t"]
    sent = sound.sparkSession.sparkContext.broadcast(cutoff)

    def last_phases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _rows(collect(batches, side.value, sent.value, k), side.value.ids)

    found = sound.mapInArrow(last_phases, "q long, vec_id long, score long").withColumnRenamed("q", "query_id")
    ranked = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return found.withColumn("rank", ranked).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")


def op4_uniform_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_k(table(spark, sf_dir, "embeddings"), lambda i: i % 50 == 0, k=5)


ORACLES = {
    "op4_uniform_threshold": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS e FROM embeddings),
        s AS (
            SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
        ),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
    """
}
QUERIES = {"op4_uniform_threshold": op4_uniform_threshold}
