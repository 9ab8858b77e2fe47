"""SentencePiece encoding and decoding: exact merge-type encoding by backtracking.

A BPE segmentation is the one in which every two neighbours stay apart when their joined text is merged again. The encoder
walks a text left to right with the longest vocabulary match (Aho-Corasick) and takes a token if re-merging it with its left
neighbour gives the two back; otherwise it tries shorter matches, and where none fits it marks the position in a bitfield of
failed positions and takes the last token back. No position is failed twice, so the walk is linear in the text.

Texts are cut where no piece of the vocabulary can cross (before a space, around characters outside the vocabulary);
the pieces between are kept in a bounded memory of recent ones.
"""

from __future__ import annotations

import re
import struct
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

SPACE = "▁"
#: Types of pieces in a model file.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, object]]:
    """Number and value of each protocol-buffer field."""
    at, end = 0, len(data)

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < end:
        key = varint()
        kind = key & 7
        if kind == 0:
            value: object = varint()
        elif kind == 2:
            size = varint()
            value = data[at : at + size]
            at += size
        elif kind == 5:
            value = struct.unpack("<f", data[at : at + 4])[0]
            at += 4
        else:
            value = data[at : at + 8]
            at += 8
        yield key >> 3, value


class Codec:
    """Encoder and decoder of one BPE model, made from the bytes of its file."""

    def __init__(self, model: bytes, remember: int = 250_000):
        self.pieces: list[str] = []
        self.scores: list[float] = []
        self.types: list[int] = []
        trainer: dict[int, object] = {}
        normalizer: dict[int, object] = {}
        for number, value in _fields(model):
            if number == 1:
                piece = {1: b"", 2: 0.0, 3: NORMAL} | dict(_fields(value))
                self.pieces.append(piece[1].decode())
                self.scores.append(piece[2])
                self.types.append(piece[3])
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3, 1) != 2 or not trainer.get(35, 0) or trainer.get(24, 0):
            raise ValueError("only merge-type (BPE) models with byte fallback and white space as a prefix are known")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(3, 1) or not normalizer.get(5, 1):
            raise ValueError("only models that leave texts as they are and add a space in front are known")
        if {USER_DEFINED, UNUSED} & {*self.types}:
            raise ValueError("user-defined and unused pieces are not known")
        self.ids = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == NORMAL}
        self.bytes = [0] * 256
        for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)):
            if t == BYTE:
                self.bytes[int(p[3:5], 16)] = i
        self.chars = {c for p in self.ids for c in p}
        if any(c not in self.ids for c in self.chars):
            raise ValueError("a character of a piece is no piece")
        controls = {p: i for i, (p, t) in enumerate(zip(self.pieces, self.types, strict=True)) if t == CONTROL}
        self.begin, self.end = controls.get("<s>", 1), controls.get("</s>", 2)
        self.automaton = ahocorasick.Automaton()
        whole = [p for p in self.ids if len(p) == 1 or self.merge(p) == [p]]  # the others are never the result of merging
        for p in whole:
            self.automaton.add_word(p, (len(p) - 1, p))
        self.automaton.make_automaton()
        known = {*whole}
        self.shorter = {p: next((p[:k] for k in range(len(p) - 1, 0, -1) if p[:k] in known), None) for p in whole}
        inner = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        line = "" if "\n" in self.chars else "\n"
        self.chunks = (lambda s: [s]) if inner else re.compile(f"{SPACE}+[^{SPACE}{line}]*|[^{SPACE}{line}]+" + (r"|\n" if line else "")).findall
        self.known = re.compile("([" + "".join(map(re.escape, sorted(self.chars))) + "]+)")
        self.apart: dict[tuple[str, str], bool] = {}
        self.memory: dict[str, tuple[bytes, str]] = {}
        self.remember = remember

    def merge(self, text: str) -> list[str]:
        """The merge rule itself, for short texts: the best-scored neighbours first, the leftmost of equals."""
        parts, ids, scores = list(text), self.ids, self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                k = ids.get(parts[i] + parts[i + 1])
                if k is not None and (best is None or scores[k] > best):
                    best, at = scores[k], i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _stay_apart(self, left: str, right: str) -> bool:
        if len(self.apart) > 400_000:
            self.apart.clear()
        found = self.apart[left, right] = self.merge(left + right) == [left, right]
        return found

    def segment(self, text: str) -> list[str]:
        """The pieces of a text made of known characters."""
        n = len(text)
        longest = [""] * n
        for last, (back, piece) in self.automaton.iter(text):
            longest[last - back] = piece  # ends rise, so the longest comes last
        if len(longest[0]) == n:
            return [text]
        apart, shorter = self.apart, self.shorter
        failed = 0
        out: list[str] = []
        at, piece = 0, longest[0]
        while True:
            while piece:
                if not failed >> (at + len(piece)) & 1:
                    if not out:
                        break
                    fits = apart.get((out[-1], piece))
                    if fits or fits is None and self._stay_apart(out[-1], piece):
                        break
                piece = shorter[piece]
            if piece:
                out.append(piece)
                at += len(piece)
                if at == n:
                    return out
                piece = longest[at]
            else:
                failed |= 1 << at
                last = out.pop()
                at -= len(last)
                piece = shorter[last]

    def _chunk_ids(self, chunk: str) -> list[int]:
        out: list[int] = []
        for i, run in enumerate(self.known.split(chunk)):
            if i % 2:
                out += [self.ids[p] for run_part in self._cut(run) for p in self.segment(run_part)]
            else:
                out += [self.bytes[b] for b in run.encode("utf-8", "surrogatepass")]
        return out

    def _cut(self, run: str) -> list[str]:
        """The whole run: the bitfield is a Python integer, so a very long run is cut where no piece crosses."""
        if len(run) < 2000:
            return [run]
        reach, cuts = 0, [0]
        furthest = [0] * (len(run) + 1)
        for last, (back, _) in self.automaton.iter(run):
            first = last - back
            furthest[first] = max(furthest[first], last + 1)
        for i in range(len(run)):
            if i and reach <= i:
                cuts.append(i)
            reach = max(reach, furthest[i])
        return [run[a:b] for a, b in zip(cuts, [*cuts[1:], len(run)], strict=True)]

    def _remembered(self, chunk: str) -> tuple[bytes, str]:
        if len(chunk) < 2000 and self.known.fullmatch(chunk):
            pieces = self.segment(chunk)
            found = array("I", [self.ids[p] for p in pieces]).tobytes(), "".join(pieces).replace(SPACE, " ")
        else:
            ids = self._chunk_ids(chunk)
            found = array("I", ids).tobytes(), self._pieces_text(ids)
        if len(chunk) <= 48:
            if len(self.memory) >= self.remember:
                self.memory.clear()
            self.memory[chunk] = found
        return found

    def encode_decode(self, text: str | None) -> tuple[bytes, str]:
        """The ids with begin and end as little-endian unsigned 32-bit integers, and the text that they decode to."""
        head, tail = struct.pack("<I", self.begin), struct.pack("<I", self.end)
        if not text:
            return head + tail, ""
        memory, miss = self.memory.get, self._remembered
        found = [memory(c) or miss(c) for c in self.chunks(SPACE + text.replace(" ", SPACE))]
        decoded = "".join([x[1] for x in found])
        return head + b"".join([x[0] for x in found]) + tail, decoded.removeprefix(" ")

    def encode(self, text: str | None) -> list[int]:
        return array("I", self.encode_decode(text)[0]).tolist()

    def _pieces_text(self, ids: list[int]) -> str:
        out: list[str] = []
        raw = bytearray()
        for i in ids:
            kind = self.types[i]
            if kind == BYTE:
                raw.append(int(self.pieces[i][3:5], 16))
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw.clear()
            if kind != CONTROL:
                out.append(" ⁇ " if kind == UNKNOWN else self.pieces[i].replace(SPACE, " "))
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        return self._pieces_text(ids).removeprefix(" ")


@lru_cache(maxsize=2)
def _codec(model: bytes) -> Codec:
    return Codec(model)


def encode_texts(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Encodes and decodes every text: `id_col`, ids (binary, little-endian unsigned 32-bit), decoded (string).

    The model file is read once, on the driver, and goes to the executors inside the task: its size does not depend on the
    data. Null and empty texts have just the begin and end ids and decode to ''. Very long texts, repeated rows and further
    columns (dropped here) need no care; an empty table gives an empty one.
    """
    with open(model_path, "rb") as f:
        model = f.read()
    _codec(model)  # refuses unknown kinds of models before any task starts
    shared = docs.sparkSession.sparkContext.broadcast(model)
    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = {f.name: f.dataType.simpleString() for f in slim.schema}["id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = _codec(shared.value)
        for batch in batches:
            step = 256
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                pairs = [codec.encode_decode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([p[0] for p in pairs], pa.binary()), pa.array([p[1] for p in pairs], pa.string())], ["id", "ids", "decoded"])

    return slim.mapInArrow(run, f"id {kind}, ids binary, decoded string").withColumnRenamed("id", id_col)


def model_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents"), model_path())
    return out.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2(F.col("ids"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op1_sentencepiece": op1_sentencepiece}
ORACLES: dict[str, str] = {}
