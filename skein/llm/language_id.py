"""Language ID by a byte convolutional network.

Bytes go through filters of several widths (one weight a byte value, place and filter), each filter's largest response over a
window of fixed length goes through a softmax layer. The network is trained in numpy on the driver from a bounded sample of
labelled rows: `per_language` documents of each language with `windows_each` windows, drawn by a hash of the id. It is applied
to all windows of every whole text, in batches; a document's prediction adds the windows' log probabilities, weighted by their
share of real bytes.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

WINDOW, WIDTHS, FILTERS = 256, (2, 3, 4), 16
PER_LANGUAGE, WINDOWS_EACH, EPOCHS, BATCH = 1000, 2, 6, 64
UNDETERMINED = "und"
_LETTER = re.compile(r"[^\W\d_]")


def windows_of(text: str) -> tuple[np.ndarray, np.ndarray]:
    """All windows of a text as rows of bytes, padded with spaces, and the share of real bytes of each."""
    raw = text.encode("utf-8", "replace")
    n = max(1, -(-len(raw) // WINDOW))
    out = np.full(n * WINDOW, 32, np.uint8)
    out[: len(raw)] = np.frombuffer(raw, np.uint8)
    share = np.ones(n)
    share[-1] = (len(raw) - (n - 1) * WINDOW) / WINDOW or 1.0
    return out.reshape(n, WINDOW), share


class ByteNet:
    """taps[width][k] is a table (256, FILTERS): the weights of the k-th byte under each filter of that width."""

    def __init__(self, languages: list[str], seed: int = 7):
        rng = np.random.default_rng(seed)
        self.languages = languages
        self.taps = {w: [rng.normal(0, 0.3 / w, (256, FILTERS)).astype(np.float32) for _ in range(w)] for w in WIDTHS}
        self.bias = np.zeros(len(WIDTHS) * FILTERS, np.float32)
        self.out = rng.normal(0, 0.3, (len(WIDTHS) * FILTERS, len(languages))).astype(np.float32)
        self.out_bias = np.zeros(len(languages), np.float32)

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = 11) -> None:
        """Adam on the cross entropy; only the place of each filter's largest response gets a gradient."""
        rng = np.random.default_rng(seed)
        params = [t for w in WIDTHS for t in self.taps[w]] + [self.bias, self.out, self.out_bias]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        columns = np.arange(FILTERS)
        step = 0
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for at in range(0, len(order), BATCH):
                rows = order[at : at + BATCH]
                b = x[rows]
                n = len(rows)
                pooled, places = [], []
                for w in WIDTHS:
                    span = WINDOW - w + 1
                    response = self.taps[w][0][b[:, :span]]
                    for k in range(1, w):
                        response += self.taps[w][k][b[:, k : k + span]]
                    where = response.argmax(1)
                    places.append(where)
                    pooled.append(np.take_along_axis(response, where[:, None, :], 1)[:, 0])
                h = np.concatenate(pooled, 1) + self.bias
                live = np.maximum(h, 0)
                p = _softmax(live @ self.out + self.out_bias)
                p[np.arange(n), y[rows]] -= 1
                p /= n
                back = (p @ self.out.T) * (h > 0)
                grads = []
                for i, w in enumerate(WIDTHS):
                    g = back[:, i * FILTERS : (i + 1) * FILTERS]
                    for k in range(w):
                        seen = np.take_along_axis(b, places[i] + k, 1).astype(np.int64)
                        grads.append(np.bincount((seen * FILTERS + columns).ravel(), g.ravel(), 256 * FILTERS).reshape(256, FILTERS))
                grads += [back.sum(0), live.T @ p, p.sum(0)]
                step += 1
                for q, g, m, v in zip(params, grads, first, second, strict=True):
                    m += 0.1 * (g - m)
                    v += 0.001 * (g * g - v)
                    q -= (rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
        self.__dict__.pop("pairs", None)

    def log_probabilities(self, x: np.ndarray) -> np.ndarray:
        """For rows of windows; responses of neighbouring bytes are looked up in pairs."""
        if "pairs" not in self.__dict__:
            self.pairs = {w: [(t[k][:, None, :] + t[k + 1][None, :, :]).reshape(65536, FILTERS) for k in range(0, w - 1, 2)] for w, t in self.taps.items()}
        out = np.empty((len(x), len(self.languages)))
        for at in range(0, len(x), 32):
            b = x[at : at + 32]
            two = (b[:, :-1].astype(np.uint16) << 8) | b[:, 1:]
            pooled = []
            for w in WIDTHS:
                span = WINDOW - w + 1
                response = self.pairs[w][0].take(two[:, :span], 0)
                for i, t in enumerate(self.pairs[w][1:], 1):
                    response += t.take(two[:, 2 * i : 2 * i + span], 0)
                if w % 2:
                    response += self.taps[w][-1].take(b[:, w - 1 :], 0)
                pooled.append(response.max(1))
            p = _softmax(np.maximum(np.concatenate(pooled, 1) + self.bias, 0) @ self.out + self.out_bias)
            out[at : at + 32] = np.log(np.maximum(p, 1e-12))
        return out


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def train_network(labelled: DataFrame, per_language: int = PER_LANGUAGE, windows_each: int = WINDOWS_EACH) -> ByteNet | None:
    """From rows (id, text, lang), lang not null. About per_language documents of each language reach the driver, a few windows each; None without any."""
    usable = labelled.filter(F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("id", "lang", F.lit(3)).alias("h"))
    counts = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row a language
    if not counts:
        return None
    scale = 1 << 40
    limit = F.create_map(*[F.lit(v) for k, n in counts.items() for v in (k, int(scale * min(1.0, per_language / n)))])
    starts = F.transform(F.sequence(F.lit(1), F.lit(windows_each)), lambda i: F.substr("text", (F.pmod(F.xxhash64("h", i), F.greatest(F.length("text") - WINDOW, F.lit(1))) + 1).cast("int"), F.lit(WINDOW)))
    sample = usable.filter(F.pmod("h", F.lit(scale)) < limit[F.col("lang")]).select("lang", "h", F.explode(starts).alias("part"))
    rows = sorted((r["lang"], r["h"], r["part"]) for r in sample.collect())
    languages = sorted(counts)
    net = ByteNet(languages)
    x = np.concatenate([windows_of(r[2])[0][:1] for r in rows])
    y = np.array([languages.index(r[0]) for r in rows])
    net.fit(x, y)
    return net


def predict_languages(docs: DataFrame, net: ByteNet | None, text_col: str = "text") -> DataFrame:
    """The rows of docs with lang_pred and score (columns of these names are replaced).

    Null texts and texts without a letter are `und` with score 0, as all are without a network. A long text is read whole, window
    by window, and its score comes from their mean log probabilities by size. Of languages that tie the first in code point order is taken. Rows that
    repeat are predicted alike, each for itself; an empty table gives an empty one.
    """
    docs = docs.drop("lang_pred", "score")
    at_text = docs.columns.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)  # a few tables of fixed size

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for at in range(0, batch.num_rows, 128):
                part = batch.slice(at, 128)
                texts = part.column(at_text).to_pylist()
                names, scores = [UNDETERMINED] * len(texts), [0.0] * len(texts)
                if model:
                    rows = [i for i, t in enumerate(texts) if t and _LETTER.search(t)]
                    for i in rows:
                        x, share = windows_of(texts[i])
                        total = share @ model.log_probabilities(x) / share.sum()
                        p = _softmax(total[None])[0]
                        names[i], scores[i] = model.languages[int(p.argmax())], float(p.max())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], [*part.schema.names, "lang_pred", "score"])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def held_out_rows(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    net = train_network(docs.filter(~held_out_rows() & F.col("lang").isNotNull()).select(F.col("doc_id").alias("id"), "text", "lang"))
    out = predict_languages(docs.select("doc_id", "text"), net)
    return out.select("doc_id", held_out_rows().alias("held_out"), "lang_pred", "score")


QUERIES = {"op2_language_id": op2_language_id}
ORACLES: dict[str, str] = {}
