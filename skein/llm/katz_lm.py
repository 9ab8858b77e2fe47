"""LM scoring by a Katz backoff bigram model.

Counts are discounted by Good-Turing up to a count of `K`, those of 1 too; no bigram is left out (`CUTOFF` is 1). What discounting frees of a
context goes to its unseen tokens in proportion to the unigram distribution, by backoff weights that make each distribution sum
to 1 over the vocabulary and one unknown token. Unknown tokens share what discounting frees of the unigrams.

Documents are packed once into blocks of local token ids. Blocks send their distinct words, then their distinct bigrams, to
buckets by hash; a bucket adds up the counts of all blocks, stores its part of the tables (one folder a bucket), and answers
each block in the order of its question. So what moves is one entry for each distinct n-gram of a block, a frequent one lands
in a bucket once for each block, and every token is scored in its own block: seen bigram, else backoff weight times unigram.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, parts_for, shared_dir, table
from .shingles import mixed

K, CUTOFF, PACK_TOKENS = 5, 1, 800_000
TABLE_ROWS = 200_000  # n-grams that a row of a stored table packs
BEGIN = -1  # context of the first token; no token itself
END = b""  # the word of the end token: no word is empty


def _squeeze(x) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(x.tobytes() if isinstance(x, np.ndarray) else x)


def _numbers(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def good_turing(n: dict[int, int], k: int = K) -> np.ndarray:
    """Discount ratios by count 0..k (0 unused); (r - 0.5) / r where the counts of counts give none between 0 and 1."""
    out = np.ones(k + 1)
    common = (k + 1) * n.get(k + 1, 0) / n[1] if n.get(1) else 1.0
    for r in range(1, k + 1):
        d = ((r + 1) * n.get(r + 1, 0) / (r * n[r]) - common) / (1 - common) if n.get(r) and common < 1 else 0.0
        out[r] = d if 0 < d < 1 else (r - 0.5) / r
    return out


class Unigrams:
    """Discounted probabilities by count; of an unknown token at 0."""

    def __init__(self, tokens: int, kinds: int, n: dict[int, int]):
        self.tokens, self.kinds, self.discount = tokens, kinds, good_turing(n)
        freed = sum((1 - self.discount[r]) * r * n.get(r, 0) for r in range(1, K + 1)) / max(tokens, 1)
        self.unknown = max(freed, 0.5 / (tokens + 1)) if tokens else 1.0
        self.scale = (1 - self.unknown) / (1 - freed) if tokens else 0.0

    def probability(self, c: np.ndarray) -> np.ndarray:
        c = np.asarray(c)
        seen = c * np.where(c <= K, self.discount[np.minimum(c, K)], 1.0) * self.scale / max(self.tokens, 1)
        return np.where(c > 0, seen, self.unknown)


def pack_documents(docs: DataFrame) -> DataFrame:
    """block, ids, train, lengths (tokens a document), vocab, tokens: documents by the local ids of their tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def fresh():
            words: defaultdict[bytes, int] = defaultdict()
            words.default_factory = words.__len__
            words[END]  # noqa: B018  takes id 0
            return words, [], [], [], [], 0

        words, ids, train, lengths, parts, size = fresh()

        def flush() -> pa.RecordBatch:
            columns = [pa.array([ids], pa.list_(pa.int64())), pa.array([np.array(train, np.uint8).tobytes()]), pa.array([np.array(lengths, np.int64).tobytes()]), pa.array([_squeeze(b"\n".join(words))]), pa.array([_squeeze(np.concatenate(parts))])]
            return pa.RecordBatch.from_arrays(columns, ["ids", "train", "lengths", "vocab", "tokens"])

        for batch in batches:
            for i in range(batch.num_rows):
                text = batch.column(1)[i].as_py()
                found = text.encode("utf-8", "surrogatepass").lower().split() if text else []
                found.append(END)
                parts.append(np.fromiter(map(words.__getitem__, found), np.uint32, len(found)))
                ids.append(batch.column(0)[i].as_py())
                train.append(batch.column(2)[i].as_py())
                lengths.append(len(found))
                size += len(found)
                if size >= PACK_TOKENS:
                    yield flush()
                    words, ids, train, lengths, parts, size = fresh()
        if ids:
            yield flush()

    packed = docs.mapInArrow(run, "ids array<long>, train binary, lengths binary, vocab binary, tokens binary")
    return packed.withColumn("block", F.monotonically_increasing_id())


class _Block:
    """A pack, unpacked."""

    def __init__(self, row: dict, buckets: int):
        self.words = zstandard.ZstdDecompressor().decompress(row["vocab"]).split(b"\n")
        self.tokens = _numbers(row["tokens"], np.uint32).astype(np.int64)
        self.lengths = np.frombuffer(row["lengths"], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.train = np.repeat(np.frombuffer(row["train"], np.uint8), self.lengths)
        bucket = np.array([xxhash.xxh64_intdigest(w) for w in self.words], np.uint64) % np.uint64(buckets)
        self.order = np.argsort(bucket, kind="stable")  # of words, in the order of questions
        self.cuts = np.searchsorted(bucket[self.order], np.arange(buckets + 1))

    def learn(self, answers: list[dict], buckets: int) -> None:
        """Global ids and counts of the words, from the answers of the buckets."""
        self.ids, self.counts = np.zeros(len(self.words), np.int64), np.zeros(len(self.words), np.int64)
        for a in answers:
            at = self.order[self.cuts[a["bucket"]] : self.cuts[a["bucket"] + 1]]
            self.ids[at] = _numbers(a["a"], np.int64) * buckets + a["bucket"]
            self.counts[at] = _numbers(a["b"], np.int64)

    def bigrams(self, buckets: int, hot: int) -> dict:
        """Distinct (context, token) pairs that could be seen, ordered by bucket; where each token's pair is (-1: none), and the training count of each.

        The pairs of a context go to one bucket, but those of contexts that training has over `hot` times are dealt by token too.
        """
        width = len(self.words)
        context = np.empty_like(self.tokens)
        context[1:] = self.tokens[:-1]
        context[self.starts] = width  # begin
        often = np.append(self.counts >= CUTOFF, True)
        may = often[context] & often[self.tokens]
        keys, place = np.unique(context[may] * width + self.tokens[may], return_inverse=True)
        trained = np.bincount(place, self.train[may], len(keys)).astype(np.int64)
        ids = np.append(self.ids, BEGIN)
        h, w = ids[keys // width], self.ids[keys % width]
        whole = np.append(self.counts, np.iinfo(np.int64).max)[keys // width]
        spread = np.where(whole > hot, w.view(np.uint64) + np.uint64(1), np.uint64(0))
        bucket = mixed(h.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + spread) % np.uint64(buckets)
        order = np.lexsort((w, h, bucket))
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        at = np.full(len(self.tokens), -1)
        at[may] = rank[place]
        once = int(self.train[~may].sum())  # each of these is a bigram of count one
        return {"h": h[order], "w": w[order], "n": trained[order], "whole": whole[order], "c": self.counts[keys % width][order], "cuts": np.searchsorted(bucket[order], np.arange(buckets + 1)), "at": at, "context": context, "once": once}


def _answers(replies: DataFrame, name: str) -> DataFrame:
    return replies.groupBy("block").agg(F.collect_list(F.struct("bucket", "a", "b")).alias(name))


def _dicts(batch: pa.RecordBatch) -> Iterator[dict]:
    for i in range(batch.num_rows):
        yield {n: batch.column(j)[i].as_py() for j, n in enumerate(batch.schema.names)}


_REPLY = "kind int, block long, bucket int, a binary, b binary, x long, y long, z long"


def _reply(kind: int, rows: list[tuple]) -> pa.RecordBatch:
    """Rows of (block, bucket, a, b) of kind 0, or of (bucket, x, y, z) of another."""
    n = len(rows)
    if kind:
        bucket, x, y, z = zip(*rows, strict=True) if rows else ((), (), (), ())
        block, a, b = [None] * n, [None] * n, [None] * n
    else:
        block, bucket, a, b = zip(*rows, strict=True) if rows else ((), (), (), ())
        x = y = z = [None] * n
    kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(([kind] * n, block, bucket, a, b, x, y, z), kinds, strict=True)], ["kind", "block", "bucket", "a", "b", "x", "y", "z"])


def _table_rows(bucket: int, x: np.ndarray, y: np.ndarray, z: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 1, packed: x as differences in a, y and then z in b, their number in x; as columns they would be most of an executor's memory."""
    for low in range(0, len(x), TABLE_ROWS):
        part = slice(low, low + TABLE_ROWS)
        packed = [_squeeze(np.diff(x[part], prepend=0)), _squeeze(np.concatenate([y[part], z[part]]))]
        one = [pa.array([1], pa.int32()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), *(pa.array([v], pa.binary()) for v in packed), pa.array([len(x[part])], pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64())]
        yield pa.RecordBatch.from_arrays(one, ["kind", "block", "bucket", "a", "b", "x", "y", "z"])


def table_rows(packed: DataFrame) -> DataFrame:
    """x, y, z: the rows of a stored table (kind 1), unpacked."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                y, z = _numbers(row["b"], np.int64).reshape(2, -1)
                yield pa.RecordBatch.from_arrays([pa.array(np.cumsum(_numbers(row["a"], np.int64))), pa.array(y), pa.array(z)], ["x", "y", "z"])

    return packed.select("a", "b").mapInArrow(unpack, "x long, y long, z long")


def ask_words(packs: DataFrame, buckets: int) -> DataFrame:
    """Kind 0: each block's answers (a: place of a word in its bucket, b: its training count). Kind 1: the table, packed (x: id, y: count). Kind 2: how many words (y) have the count x, z tokens in all."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                block = _Block(row, buckets)
                counts = np.bincount(block.tokens, block.train, len(block.words)).astype(np.int64)
                out = []
                for k, (a, b) in enumerate(zip(block.cuts, block.cuts[1:], strict=False)):
                    at = block.order[a:b]
                    out.append({"bucket": k, "block": row["block"], "a": _squeeze(b"\n".join([block.words[i] for i in at])), "b": _squeeze(counts[at])})
                yield pa.RecordBatch.from_pylist([o for o, a, b in zip(out, block.cuts, block.cuts[1:], strict=False) if b > a], pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("a", pa.binary()), ("b", pa.binary())]))

    def add(key: tuple, asked: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        ids: defaultdict[bytes, int] = defaultdict()
        ids.default_factory = ids.__len__
        questions = []
        for batch in asked:
            for row in _dicts(batch):
                words = zstandard.ZstdDecompressor().decompress(row["a"]).split(b"\n")
                questions.append((row["block"], np.fromiter(map(ids.__getitem__, words), np.int64, len(words)), _numbers(row["b"], np.int64)))
        total = np.zeros(len(ids), np.int64)
        for _, at, counts in questions:
            np.add.at(total, at, counts)
        for block, at, _ in questions:
            yield _reply(0, [(block, bucket, _squeeze(at), _squeeze(total[at]))])
        many = np.flatnonzero(total >= CUTOFF)
        yield from _table_rows(bucket, many * buckets + bucket, total[many], np.zeros(len(many), np.int64))
        values, n = np.unique(total[total > 0], return_counts=True)
        small = values <= K + 1
        tail = n[~small].sum()
        yield _reply(2, [(bucket, int(v), int(c), int(v * c)) for v, c in zip(values[small], n[small], strict=True)] + [(bucket, K + 2, int(tail), int((values[~small] * n[~small]).sum()))])

    return packs.select("block", "ids", "train", "lengths", "vocab", "tokens").mapInArrow(ask, "bucket int, block long, a binary, b binary").groupBy("bucket").applyInArrow(add, _REPLY)


def ask_bigrams(packs: DataFrame, buckets: int, uni: Unigrams, hot: int) -> DataFrame:
    """As ask_words for bigrams. Kind 0: b is the count, 0 below the cutoff. Kind 1: the table of seen ones, packed (x: context, y: token, z: count).
    Kind 2: how many (y) have the count x. Kind 3: contexts (a), packed, and by context (b) its count, how many of its pairs have the
    counts 1 to K, the sum of the others and the sum of the unigram probabilities of its seen tokens."""

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("bucket", pa.int32()), ("block", pa.int64()), ("h", pa.binary()), ("w", pa.binary()), ("n", pa.binary()), ("c", pa.binary()), ("whole", pa.binary()), ("once", pa.int64())])
        for batch in batches:
            for row in _dicts(batch):
                block = _Block(row, buckets)
                block.learn(row["words"], buckets)
                q = block.bigrams(buckets, hot)
                out = [{"bucket": 0, "block": row["block"], "h": None, "w": None, "n": None, "c": None, "whole": None, "once": q["once"]}]
                for k, (a, b) in enumerate(zip(q["cuts"], q["cuts"][1:], strict=False)):
                    if b > a:
                        h = q["h"][a:b]
                        out.append({"bucket": k, "block": row["block"], "h": _squeeze(np.diff(h, prepend=0)), "w": _squeeze(q["w"][a:b]), "n": _squeeze(q["n"][a:b]), "c": _squeeze(q["c"][a:b]), "whole": _squeeze(q["whole"][a:b]), "once": None})
                yield pa.RecordBatch.from_pylist(out, kinds)

    def add(key: tuple, asked: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket = key[0].as_py()
        blocks, hs, ws, ns, cs, gs, once = [], [], [], [], [], [], 0
        for batch in asked:
            for row in _dicts(batch):
                if row["h"] is None:
                    once += row["once"]
                    continue
                blocks.append(row["block"])
                hs.append(np.cumsum(_numbers(row["h"], np.int64)))
                ws.append(_numbers(row["w"], np.int64))
                ns.append(_numbers(row["n"], np.int64))
                cs.append(_numbers(row["c"], np.int64))
                gs.append(_numbers(row["whole"], np.int64))
        small: dict[int, int] = defaultdict(int)
        if once:
            small[1] += once
        if blocks:
            cuts = np.cumsum([0] + [len(x) for x in hs])
            h, w, n = np.concatenate(hs), np.concatenate(ws), np.concatenate(ns)
            c, whole = np.concatenate(cs), np.concatenate(gs)
            hs, ws, ns, cs, gs = [], [], [], [], []
            order = np.lexsort((w, h))
            h, w = h[order], w[order]
            new = np.ones(len(order), bool)
            new[1:] = (h[1:] != h[:-1]) | (w[1:] != w[:-1])
            group = np.cumsum(new) - 1
            total = np.bincount(group, n[order]).astype(np.int64)
            each = np.empty(len(order), np.int32)
            each[order] = np.where(total < CUTOFF, 0, total)[group]
            del group, n
            for i, block in enumerate(blocks):
                yield _reply(0, [(block, bucket, b"", _squeeze(each[cuts[i] : cuts[i + 1]]))])
            del each
            seen = total >= CUTOFF
            first = order[new][seen]
            h, w, c, whole, counts = h[new][seen], w[new][seen], c[first], whole[first], total[seen]
            del order, new, first
            yield from _table_rows(bucket, h, w, counts)
            del w
            yield from _context_sums(bucket, h, whole, counts, uni.probability(c))
            values, many = np.unique(total[total > 0], return_counts=True)
            for v, c in zip(values, many, strict=True):
                if v <= K + 1:
                    small[int(v)] += int(c)
        if small:
            yield _reply(2, [(bucket, v, c, v * c) for v, c in small.items()])

    return packs.select("block", "ids", "train", "lengths", "vocab", "tokens", "words").mapInArrow(ask, "bucket int, block long, h binary, w binary, n binary, c binary, whole binary, once long").groupBy("bucket").applyInArrow(add, _REPLY)


def _context_sums(bucket: int, h: np.ndarray, whole: np.ndarray, total: np.ndarray, p: np.ndarray) -> Iterator[pa.RecordBatch]:
    """Rows of kind 3 from seen pairs sorted by context."""
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]]) if len(h) else np.zeros(0, np.int64)
    if not len(at):
        return
    parts = [whole[at].astype(np.float64)] + [np.add.reduceat((total == r).astype(np.float64), at) for r in range(1, K + 1)] + [np.add.reduceat(np.where(total > K, total, 0).astype(np.float64), at), np.add.reduceat(p, at)]
    for low in range(0, len(at), 500_000):
        part = slice(low, low + 500_000)
        one = [pa.array([3], pa.int32()), pa.nulls(1, pa.int64()), pa.array([bucket], pa.int32()), pa.array([_squeeze(np.ascontiguousarray(h[at][part]))], pa.binary()), pa.array([_squeeze(np.concatenate([x[part] for x in parts]))], pa.binary()), *(pa.nulls(1, pa.int64()) for _ in range(3))]
        yield pa.RecordBatch.from_arrays(one, ["kind", "block", "bucket", "a", "b", "x", "y", "z"])


def _store(df: DataFrame, where: str) -> dict[int, DataFrame]:
    """Written once in the shared folder, a folder for each kind of row and bucket; read back by kind."""
    df.write.partitionBy("kind").parquet(where)
    back = df.sparkSession.read.schema(df.schema).parquet(where)
    return {k: back.filter(F.col("kind") == k) for k in (0, 1, 2, 3)}


def backoff_weights(sums: DataFrame, discount: np.ndarray, begins: int) -> DataFrame:
    """h, alpha, scale for contexts with seen bigrams: P(w | h) is scale * d * c / c(h) if seen, else alpha * P(w)."""

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                h = _numbers(row["a"], np.int64)
                parts = _numbers(row["b"], np.float64).reshape(K + 3, -1)
                mass = parts[K + 1] + sum(r * discount[r] * parts[r] for r in range(1, K + 1))
                whole = np.where(h == BEGIN, float(begins), parts[0])
                yield pa.RecordBatch.from_arrays([pa.array(h), pa.array(whole), pa.array(mass), pa.array(parts[K + 2])], ["h", "c", "m", "p"])

    # A frequent context has sums in several buckets.
    whole = sums.select("a", "b").mapInArrow(unpack, "h long, c double, m double, p double").groupBy("h").agg(F.max("c").alias("c"), F.sum("m").alias("m"), F.sum("p").alias("p"))
    share = F.col("m") / F.col("c")
    rest = F.greatest(1 - share, 0.5 / (F.col("c") + 1))
    # Where discounting frees enough, the scale is 1 to the last digit, and answers that repeat it take no space.
    scale = F.when(1 - share >= 0.5 / (F.col("c") + 1), F.lit(1.0)).otherwise((1 - rest) / share)
    return whole.select("h", (rest / (1 - F.col("p"))).alias("alpha"), scale.alias("scale"))


def score_documents(docs: DataFrame, train) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score (log10 of the text's probability, end included).

    train: a boolean column over doc_id. Null and empty texts are the end token alone. Repeated rows are learnt and scored as
    often as they come; without training rows every token has probability 1 in the model. Words of any length are words.
    """
    spark = docs.sparkSession
    where = f"{shared_dir(spark)}/katz-{uuid.uuid4().hex}"
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", train.alias("train"))
    chars = slim.agg(F.sum(F.length("text")).alias("n"), F.sum(F.col("train").cast("long")).alias("begins")).first()
    buckets = parts_for(spark, (chars["n"] or 0) / 1e6, 8)
    packs = cut(pack_documents(slim))

    stored = _store(ask_words(packs, buckets), f"{where}/words")
    word_answers = stored[0]
    stats = stored[2].groupBy("x").agg(F.sum("y").alias("y"), F.sum("z").alias("z")).collect()  # a row a small count
    uni = Unigrams(sum(r["z"] for r in stats), sum(r["y"] for r in stats), {r["x"]: r["y"] for r in stats if r["x"] <= K + 1})

    told = packs.join(_answers(word_answers, "words"), "block")
    hot = max(1000, uni.tokens // (20 * buckets))
    stored = _store(ask_bigrams(told, buckets, uni, hot), f"{where}/bigrams")
    pair_answers = stored[0]
    counts = {r["x"]: r["n"] for r in stored[2].groupBy("x").agg(F.sum("y").alias("n")).collect()}
    discount = good_turing(counts)
    begins = int(chars["begins"] or 0)
    weights = backoff_weights(stored[3], discount, begins)

    def gather(key: tuple, rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = pa.Table.from_batches(list(rows))
        order = np.argsort(np.asarray(t["h"]))
        yield pa.RecordBatch.from_arrays([pa.array([key[0].as_py()], pa.int32()), *(pa.array([np.asarray(t[c])[order].tobytes()]) for c in ("h", "alpha", "scale"))], ["bucket", "h", "alpha", "scale"])

    kept = cut(weights)
    by_bucket = kept.filter(F.col("h") != BEGIN).withColumn("bucket", (F.col("h") % buckets).cast("int")).select("bucket", "h", "alpha", "scale").groupBy("bucket").applyInArrow(gather, "bucket int, h binary, alpha binary, scale binary")
    first = kept.filter(F.col("h") == BEGIN).select("alpha", "scale").collect()
    begin = (first[0]["alpha"], first[0]["scale"]) if first else (1.0, 1.0)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in _dicts(batch):
                ids = _numbers(r["a"], np.int64) * buckets + r["bucket"]
                alpha, scale = np.ones(len(ids)), np.ones(len(ids))
                if r["h"] is not None:
                    h = np.frombuffer(r["h"], np.int64)
                    at = np.minimum(np.searchsorted(h, ids), len(h) - 1)
                    hit = h[at] == ids
                    alpha[hit], scale[hit] = np.frombuffer(r["alpha"], np.float64)[at[hit]], np.frombuffer(r["scale"], np.float64)[at[hit]]
                out.append({"block": r["block"], "bucket": r["bucket"], "a": _squeeze(alpha), "b": _squeeze(scale)})
            yield pa.RecordBatch.from_pylist(out, pa.schema([("block", pa.int64()), ("bucket", pa.int32()), ("a", pa.binary()), ("b", pa.binary())]))

    weight_answers = word_answers.select("block", "bucket", "a").join(by_bucket, "bucket", "left").mapInArrow(weigh, "block long, bucket int, a binary, b binary")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in _dicts(batch):
                block = _Block(row, buckets)
                block.learn(row["words"], buckets)
                q = block.bigrams(buckets, hot)
                pair = np.zeros(len(q["h"]) + 1, np.int64)
                for a in row["pairs"] or []:
                    pair[q["cuts"][a["bucket"]] : q["cuts"][a["bucket"] + 1]] = _numbers(a["b"], np.int32)
                alpha, scale = np.append(np.ones(len(block.words)), begin[0]), np.append(np.ones(len(block.words)), begin[1])
                for a in row["weights"]:
                    at = block.order[block.cuts[a["bucket"]] : block.cuts[a["bucket"] + 1]]
                    alpha[at], scale[at] = _numbers(a["a"], np.float64), _numbers(a["b"], np.float64)
                c = block.counts[block.tokens]
                b, h = pair[q["at"]], q["context"]
                whole = np.append(block.counts, begins)
                high = scale[h] * b * np.where(b <= K, discount[np.minimum(b, K)], 1.0) / np.maximum(whole[h], 1)
                p = np.log10(np.where(b > 0, high, alpha[h] * uni.probability(c)))
                base = np.log10((c + 0.1) / (uni.tokens + 0.1 * (uni.kinds + 1)))
                sums = [np.add.reduceat(x, block.starts) for x in (p, base, (c > 0).astype(np.int64))]
                yield pa.RecordBatch.from_arrays([pa.array(row["ids"], pa.int64()), pa.array(block.lengths), pa.array(sums[2]), pa.array(np.full(len(block.lengths), uni.tokens, np.int64)), pa.array(sums[1]), pa.array(sums[0])], ["doc_id", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    full = packs.join(_answers(word_answers, "words"), "block").join(_answers(pair_answers, "pairs"), "block", "left").join(_answers(weight_answers, "weights"), "block")
    return full.select("block", "ids", "train", "lengths", "vocab", "tokens", "words", "pairs", "weights").mapInArrow(score, "doc_id long, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op3_katz_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    rest = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10
    out = score_documents(table(spark, sf_dir, "documents"), F.coalesce(rest != 0, F.lit(False)))
    return out.select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


ORACLES: dict[str, str] = {}
QUERIES = {"op3_katz_lm": op3_katz_lm}
