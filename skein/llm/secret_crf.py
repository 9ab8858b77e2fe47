"""Secret scans by a linear-chain conditional random field.

Tokens of a text are tagged as begin, inside or outside of a secret. A token's features are its shape, the shapes of its
neighbours (two before, one after) and features of the file; they depend on the token only through its class, so a token costs
one lookup and four rows of weights. The field is trained on the driver by gradient ascent on the log likelihood (forward and
backward sums) over a bounded sample of lines, labelled by the base patterns; decoding is Viterbi over the whole text.

Decoding splits exactly: where outside beats another tag by more than any two transitions can make up, outside is on every best
path, and the runs of open tokens between are decoded together, all runs one place at a time.
"""

from __future__ import annotations

import heapq
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("assign", "access", "hex", "model")
#: The base patterns and the least length of what they must hold, fixed values.
ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
LEAST = {"assign": 8, "access": 16, "hex": 32}
_KEYS = ("passw", "secret", "token", "api")

TOKEN = re.compile(r"[\w+/.\-]+|[^\w\s+/.\-]")
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "key", "auth", "bearer", "credential", "private", "access")
B, I, O = 0, 1, 2
N_SELF, N_FILE = 24, 6
TRAIN_DOCS, TRAIN_LINES, LINE_TOKENS, STEPS = 1500, 2000, 48, 100
#: Windows with and without a label that a document gives at most to the training sample.
DOC_WINDOWS = 60


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns, leftmost and non-overlapping for each kind, in order."""
    out = []
    low = text.lower()
    if any(k in low for k in _KEYS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def token_shape(t: str) -> tuple:
    """What the field knows of a token."""
    n = len(t)
    if n == 1 and not t.isalnum():
        return ("mark", t if t in "\"'=:;,{}()[]" else "")
    size = min(n.bit_length(), 7)
    low = t.lower()
    key = low in KEYWORDS or (n > 3 and any(k in low for k in ("passw", "secret", "token", "apikey", "api_key")))
    if t.isalpha():
        return ("word", size, key, t.islower() or t.istitle())
    digits = sum(map(str.isdigit, t))
    upper = sum(map(str.isupper, t))
    lower = sum(map(str.islower, t))
    hexa = n >= 16 and not low.strip("0123456789abcdef")
    return ("mix", size, key, digits * 4 // n, upper > 0, lower > 0, hexa, t.startswith("AKIA"), any(c in "+/_" for c in t), len(set(t)) * 4 // min(n, 40))


def shape_features(shape: tuple) -> np.ndarray:
    f = np.zeros(N_SELF)
    f[0] = 1
    if shape[0] == "mark":
        f[1] = 1
        if shape[1] in ("=", ":"):
            f[2] = 1
        elif shape[1] in ('"', "'"):
            f[3] = 1
        return f
    f[3 + shape[1]] = 1  # 4..10
    f[11] = shape[2]
    if shape[0] == "word":
        f[12], f[13] = 1, shape[3]
        return f
    f[14] = 1
    f[15 + min(shape[3], 3)] = 1  # 15..18
    f[19], f[20], f[21] = shape[4] and shape[5], shape[6], shape[7]
    f[22], f[23] = shape[8], shape[9] >= 2
    return f


def file_features(text: str) -> np.ndarray:
    n = max(len(text), 1)
    return np.array([1.0, text.count("=") / n > 0.005, text.count("{") + text.count("}") > 1, text.count("\n") / n > 0.01, n > 2000, text.count('"') / n > 0.01])


class SecretField:
    """Weights: of a token's class (own, one before, two before, one after), of the file, and of transitions."""

    def __init__(self):
        self.place = np.zeros((4, N_SELF, 3))
        self.file = np.zeros((N_FILE, 3))
        self.trans = np.zeros((3, 3))

    def emissions(self, shapes: np.ndarray, files: np.ndarray) -> np.ndarray:
        """shapes: features of tokens at offsets 0, -1, -2, +1, (4, ..., N_SELF)."""
        return sum(shapes[i] @ self.place[i] for i in range(4)) + files @ self.file

    def fit(self, lines: list[tuple[list[str], list[int], np.ndarray]], steps: int = STEPS, rate: float = 0.15, decay: float = 2e-4, seed: int = 5) -> None:
        """Adam on the mean log likelihood of whole lines; the neighbours' features are dropped at random, so that none of them is needed."""
        n, width = len(lines), max((len(t) for t, _, _ in lines), default=0)
        if not width:
            self.file[0, O] = 20.0
            return
        x = np.zeros((4, n, width, N_SELF), np.float32)
        y = np.full((n, width), O)
        files = np.stack([f for _, _, f in lines])[:, None, :]
        sizes = np.array([len(t) for t, _, _ in lines])
        mask = np.arange(width) < sizes[:, None]
        for i, (tokens, tags, _) in enumerate(lines):
            own = np.stack([shape_features(token_shape(t)) for t in tokens])
            x[0, i, : len(own)], x[1, i, 1 : len(own)], x[2, i, 2 : len(own)], x[3, i, : len(own) - 1] = own, own[:-1], own[:-2], own[1:]
            y[i, : len(own)] = tags
        gold = np.eye(3)[y] * mask[..., None]
        moves = np.einsum("nta,ntb->ab", gold[:, :-1], gold[:, 1:])
        rng = np.random.default_rng(seed)
        params = [self.place, self.file, self.trans]
        first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for step in range(1, steps + 1):
            keep = np.ones((4, n, 1, 1), np.float32)
            keep[1:] = rng.random((3, n, 1, 1)) > 0.25
            z = x * keep
            e = self.emissions(z, files)
            fore, back = np.zeros_like(e), np.zeros_like(e)
            fore[:, 0] = e[:, 0]
            for t in range(1, width):
                new = _logsum(fore[:, t - 1, :, None] + self.trans, 1) + e[:, t]
                fore[:, t] = np.where(mask[:, t, None], new, fore[:, t - 1])
            for t in range(width - 2, -1, -1):
                new = _logsum(self.trans + (e[:, t + 1] + back[:, t + 1])[:, None, :], 2)
                back[:, t] = np.where(mask[:, t + 1, None], new, 0)
            total = _logsum(fore[:, -1], 1)[:, None, None]
            own = np.exp(fore + back - total) * mask[..., None]
            pair = fore[:, :-1, :, None] + self.trans + (e[:, 1:] + back[:, 1:])[:, :, None, :] - total[..., None]
            pairs = (np.exp(pair) * mask[:, 1:, None, None]).sum((0, 1))
            gap = (gold - own) / n
            grads = [np.stack([np.tensordot(z[i], gap, ([0, 1], [0, 1])) for i in range(4)]), np.tensordot(files[:, 0], gap.sum(1), ([0], [0])), (moves - pairs) / n]
            for p, g, m, v in zip(params, grads, first, second, strict=True):
                g = g - decay * p
                m += 0.1 * (g - m)
                v += 0.01 * (g * g - v)
                p += rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
            np.clip(self.trans, -3, 3, out=self.trans)

    def viterbi(self, e: np.ndarray) -> np.ndarray:
        """The best tags of one chain that starts and ends outside (a virtual token on either side)."""
        t = self.trans
        edge = np.array([max(t[a, x] + t[x, b] - t[a, O] - t[O, b] for a in range(3) for b in range(3)) for x in (B, I)])
        tags = np.full(len(e), O, np.int8)
        is_open = ((e[:, O, None] - e[:, :2]) <= edge + 1e-9).any(1)
        at = np.flatnonzero(is_open)
        if not len(at):
            return tags
        starts = at[np.r_[True, np.diff(at) > 1]]
        ends = at[np.r_[np.diff(at) > 1, True]] + 1
        order = np.argsort(starts - ends, kind="stable")  # longest first
        size = (ends - starts)[order]
        starts = starts[order]
        best = np.full((len(starts), 3), -np.inf)
        best[:, O] = 0.0
        back = []
        for k in range(int(size[0])):
            live = int((size > k).sum())
            reach = best[:live, :, None] + t
            back.append(reach.argmax(1).astype(np.int8))
            best[:live] = reach.max(1) + e[starts[:live] + k]
        now = (best + t[:, O]).argmax(1).astype(np.int8)
        for k in range(int(size[0]) - 1, -1, -1):
            live = int((size > k).sum())
            tags[starts[:live] + k] = now[:live]
            now[:live] = back[k][np.arange(live), now[:live]]
        return tags


def _logsum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis, keepdims=True)
    return np.log(np.exp(a - top).sum(axis)) + top.squeeze(axis)


class Scanner:
    """A trained field with the weights of each class of tokens, remembered."""

    def __init__(self, field: SecretField, remember: int = 400_000):
        self.field, self.remember = field, remember
        self.classes: dict[tuple, int] = {}
        self.tokens: dict[str, int] = {}
        self.rows: list[np.ndarray] = []
        self.table = np.zeros((4, 0, 3))

    def _class(self, token: str) -> int:
        shape = token_shape(token)
        k = self.classes.get(shape)
        if k is None:
            k = self.classes[shape] = len(self.rows)
            f = shape_features(shape)
            self.rows.append(np.stack([f @ self.field.place[i] for i in range(4)]))
        if len(token) <= 40:
            if len(self.tokens) >= self.remember:
                self.tokens.clear()
            self.tokens[token] = k
        return k

    def spans(self, text: str) -> list[tuple[int, int]]:
        """Start and end of the secrets that the field finds: begin and inside tokens with nothing between."""
        tokens = TOKEN.findall(text)
        if not tokens:
            return []
        known, learn = self.tokens.get, self._class
        ids = np.array([k if (k := known(t)) is not None else learn(t) for t in tokens])
        if self.table.shape[1] < len(self.rows):
            self.table = np.stack(self.rows, 1)
        t = self.table
        e = t[0][ids] + file_features(text) @ self.field.file
        e[1:] += t[1][ids[:-1]]
        e[2:] += t[2][ids[:-2]]
        e[:-1] += t[3][ids[1:]]
        tags = self.field.viterbi(e)
        if not (tags != O).any():
            return []
        out: list[tuple[int, int]] = []
        inside = False
        for m, tag in zip(TOKEN.finditer(text), tags.tolist(), strict=True):
            if tag == O:
                inside = False
            elif tag == I and inside and out[-1][1] == m.start():
                out[-1] = (out[-1][0], m.end())
            else:
                out.append((m.start(), m.end()))
                inside = True
        return out

    def scan(self, text: str | None) -> list[tuple[int, int, int]]:
        """(start, kind, end): the base spans and those of the field that touch none of them."""
        if not text:
            return []
        base = base_spans(text)
        if not (found := self.spans(text)):
            return base
        free = [(a, 3, b) for a, b in found if not any(a < e and s < b for s, _, e in base)] if len(base) < 50 else _apart(found, base)
        return sorted(base + free)


def _apart(found: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The same for many base spans: two pointers over the merged base."""
    merged: list[list[int]] = []
    for s, _, e in base:
        if merged and s <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], e)
        else:
            merged.append([s, e])
    out, i = [], 0
    for a, b in found:
        while i < len(merged) and merged[i][1] <= a:
            i += 1
        if i == len(merged) or merged[i][0] >= b:
            out.append((a, 3, b))
    return out


def labelled_lines(text: str) -> Iterator[tuple[list[str], list[int], np.ndarray, bool]]:
    """Tokens, tags and file features of the lines of a text, long ones in windows of LINE_TOKENS tokens, and whether the base patterns label any token."""
    values = []
    for m in ASSIGN.finditer(text):
        if len(m[2]) >= LEAST["assign"]:
            values.append(m.span(2))
    values += [m.span() for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]] + [m.span() for m in HEX.finditer(text)]
    values.sort()
    features = file_features(text)
    at = v = 0
    for line in text.split("\n"):
        tokens, tags, last = [], [], None
        for m in TOKEN.finditer(line):
            while v < len(values) and values[v][1] <= at + m.start():
                v += 1
            hit = values[v] if v < len(values) and values[v][0] < at + m.end() else None
            tokens.append(m[0])
            tags.append(O if hit is None else I if hit == last else B)
            last = hit
        begins = [i for i, g in enumerate(tags) if g == B]
        low = k = 0
        while low < len(tokens):
            while k < len(begins) and begins[k] < low:
                k += 1
            if k < len(begins) and begins[k] - LINE_TOKENS // 2 < low + LINE_TOKENS:
                low = max(low, begins[k] - LINE_TOKENS // 2)
            part = tags[low : low + LINE_TOKENS]
            yield tokens[low : low + LINE_TOKENS], part, features, any(g != O for g in part)
            low += LINE_TOKENS
        at += len(line) + 1


def training_windows(docs: DataFrame) -> DataFrame:
    """From (h, text): h, no, tokens, tags, features, hit - up to DOC_WINDOWS windows of a text with a label and as many without, drawn by a hash over the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = pa.schema([("h", pa.int64()), ("no", pa.int32()), ("tokens", pa.list_(pa.string())), ("tags", pa.list_(pa.int32())), ("features", pa.list_(pa.float64())), ("hit", pa.bool_())])
        for batch in batches:
            for h, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                held: dict[bool, list] = {True: [], False: []}
                for no, (tokens, tags, features, hit) in enumerate(labelled_lines(text)):
                    # The DOC_WINDOWS with the least hashes, in a heap.
                    entry = (-zlib.crc32(f"{h} {no}".encode()), no, {"h": h, "no": no, "tokens": tokens, "tags": tags, "features": features.tolist(), "hit": hit})
                    (heapq.heappush if len(held[hit]) < DOC_WINDOWS else heapq.heappushpop)(held[hit], entry)
                rows = sorted((e for part in held.values() for e in part), key=lambda e: e[1])
                if rows:
                    yield pa.RecordBatch.from_pylist([e[2] for e in rows], kinds)

    return docs.select("h", "text").mapInArrow(run, "h long, no int, tokens array<string>, tags array<int>, features array<double>, hit boolean")


_SIGNS = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"


def _random_token(rng: np.random.Generator) -> str:
    kind, n = int(rng.integers(4)), int(rng.integers(10, 44))
    signs = ("0123456789abcdef", _SIGNS, _SIGNS + "+/", _SIGNS[26:])[kind]
    token = "".join(signs[i] for i in rng.integers(0, len(signs), n))
    return token[:3] + "_" + token[3:] if rng.random() < 0.3 else token


def _other_secret(line: tuple, rng: np.random.Generator) -> tuple:
    """The line with another secret in the place of each, another keyword before it, another sign between, and often without quotes."""
    tokens, tags, files = list(line[0]), list(line[1]), line[2]
    for i, tag in enumerate(tags):
        if tag == B:
            tokens[i] = _random_token(rng)
            for j in range(max(0, i - 3), i):
                if any(k in tokens[j].lower() for k in KEYWORDS):
                    tokens[j] = KEYWORDS[int(rng.integers(len(KEYWORDS)))]
                elif tokens[j] in ("=", ":"):
                    tokens[j] = ("=", ":", "is", "=")[int(rng.integers(4))]
    if rng.random() < 0.6:
        kept = [i for i, t in enumerate(tokens) if t not in ("'", '"')]
        tokens, tags = [tokens[i] for i in kept], [tags[i] for i in kept]
    return tokens, tags, files


def _no_secret(line: tuple, rng: np.random.Generator) -> tuple:
    """A line without a secret in which a word is a number, a version or another mixed token without a keyword near it."""
    tokens = list(line[0])
    i = int(rng.integers(len(tokens)))
    digits = "".join(map(str, rng.integers(0, 10, int(rng.integers(4, 20)))))
    tokens[i] = (digits, f"v{digits[:2]}.{digits[2:4]}", f"{digits[:4]}-{digits[2:4]}", _random_token(rng)[:9])[int(rng.integers(4))]
    return tokens, line[1], line[2]


def train_field(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_lines: int = TRAIN_LINES) -> SecretField:
    """Fits a field on a bounded sample of (id, text): about train_docs documents with and a third as many without a base pattern, drawn by a hash of the id, train_lines lines."""
    marked = docs.filter(F.col("text").isNotNull()).select("id", F.xxhash64("id", F.lit(9)).alias("h"), "text", F.col("text").rlike(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]{8}|AKIA[A-Z0-9]{12}|[0-9a-f]{32}""").alias("hit"))
    counts = {r["hit"]: r["n"] for r in marked.groupBy("hit").agg(F.count("*").alias("n")).collect()}
    scale = 1 << 40
    share = {hit: int(scale * min(1.0, (train_docs if hit else train_docs // 3) / max(n, 1))) for hit, n in counts.items()}
    sample = marked.filter(F.pmod("h", F.lit(scale)) < F.when(F.col("hit"), F.lit(share.get(True, 0))).otherwise(F.lit(share.get(False, 0)))).select("h", "text")
    hits, rest = [], []
    for r in sorted(training_windows(sample).collect(), key=lambda r: (r["h"], r["no"], r["tokens"])):
        (hits if r["hit"] else rest).append((r["tokens"], r["tags"], np.array(r["features"])))
    rng = np.random.default_rng(3)
    take = lambda a, n: [a[i] for i in sorted(rng.permutation(len(a))[:n])]
    hits, rest = take(hits, train_lines // 4), take(rest, train_lines // 4)
    # As many lines again, with other secrets in the place of the labelled ones, and with harmless mixed tokens.
    more = [_other_secret(hits[i], rng) for i in rng.integers(0, len(hits), train_lines // 4)] if hits else []
    field = SecretField()
    field.fit(hits + more + rest + [_no_secret(x, rng) for x in rest])
    return field


def scan_secrets(docs: DataFrame, field: SecretField, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and secrets, an array of (kind, start, end) in code points by start, then kind; null and empty texts have none.

    Long texts are scanned whole, as one chain of tokens. Rows that repeat are scanned each for itself; spans of
    several kinds that begin together stay, by kind; an empty table gives an empty one. Columns other than the two named, whatever
    their names, are not read.
    """
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = slim.schema["id"].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(field)  # a few hundred numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(shared.value)
        span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                found = [[{"kind": KINDS[k], "start": a, "end": b} for a, k, b in scanner.scan(t)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(found, pa.list_(span))], ["id", "secrets"])

    return slim.mapInArrow(run, f"id {kind}, secrets array<struct<kind:string,start:bigint,end:bigint>>").withColumnRenamed("id", id_col)


def op9_secret_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    found = scan_secrets(docs, train_field(docs.select(F.col("doc_id").alias("id"), "text")))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")

    def number(kind: str):
        return F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", number("assign"), number("access"), number("hex"), F.sha2(joined(F.filter("secrets", lambda x: x["kind"] != "model")).cast("binary"), 256).alias("base_sha256"), joined(F.col("secrets")).alias("spans"))


QUERIES = {"op9_secret_crf": op9_secret_crf}
ORACLES: dict[str, str] = {}
