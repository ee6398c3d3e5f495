"""Encoding and decoding with sentence pieces, as a weighted transducer.

Normaliser, pieces and byte fallback (for symbols that no piece covers) are compiled from the model's file.  A
normalised text composed with pieces and fallback is a lattice, and its shortest path in the tropical semiring is the
encoding.  Pieces of a unigram model weigh their negative score.  Merged pieces (BPE) are not a sum of weights: there
the acceptor has a state for each piece, an arc weighs zero where its two pieces are compatible and infinity else, and
exactly one path is finite (see bpe.py).  No piece has a mark after another symbol, so the lattice falls apart at
word starts, and the paths of words are kept per worker in a bounded table.

Defined cases: null and empty texts have no pieces and decode to the empty string.  A mark in the text itself decodes
to a space, as in the library.  Rows are independent.
"""

from __future__ import annotations

import math
import re
import struct
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import Merger, PrefixProgram
from .memory import slices

MARK = "▁"
KEPT_WORDS, KEPT_SEGMENTS = 500_000, 300_000
SCHEMA = "doc_id long, n_pieces long, ids array<int>, round_trip boolean"


def _fields(body: bytes):
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = body[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(body):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, body[at : at + size]
            at += size


def _replacements(table: bytes) -> dict[str, str]:
    """The rules of a model's table of replacements: a double-array trie of sources, then the targets, each ended by a zero byte."""
    if len(table) < 4:
        return {}
    size = int.from_bytes(table[:4], "little")
    units, targets = np.frombuffer(table, "<u4", size // 4, 4).tolist(), table[4 + size :]
    out, work = {}, [(0, b"")]
    while work:
        node, source = work.pop()
        unit = units[node]
        base = node ^ ((unit >> 10) << ((unit & 1 << 9) >> 6))
        if unit >> 8 & 1:
            begin = units[base] & 0x7FFFFFFF
            out[source.decode("utf-8", "replace")] = targets[begin : targets.index(b"\0", begin)].decode()
        for c in range(1, 256):
            if (base ^ c) < len(units) and units[base ^ c] & 0x800000FF == c:
                work.append((base ^ c, source + bytes([c])))
    return out


class Normaliser:
    """The normaliser of a model as its file states it: replacements, longest first, white space, a mark in front."""

    def __init__(self, spec: bytes):
        own = dict(_fields(spec))
        self.prefix, self.squeeze, self.escape = (bool(own.get(k, 1)) for k in (3, 4, 5))
        self.rules = _replacements(own.get(2, b""))
        self.source = re.compile("|".join(re.escape(k) for k in sorted(self.rules, key=len, reverse=True))) if self.rules else None

    def __call__(self, text: str) -> str:
        if self.source:
            text = self.source.sub(lambda m: self.rules[m[0]], text)
        if self.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
        if self.prefix and text:
            text = " " + text
        return text.replace(" ", MARK) if self.escape else text


class Transducer(dict):
    """Segments to the bytes of their ids (32-bit).

    kind: the model's own unless given; "unigram" weighs each piece by its negative score, "bpe" each pair of pieces.
    """

    def __init__(self, path: str, kind: str | None = None):
        with open(path, "rb") as f:
            model = list(_fields(f.read()))
        pieces = [dict(_fields(body)) for number, body in model if number == 1]
        trainer = dict(_fields(next(body for number, body in model if number == 2)))
        self.normalise = Normaliser(next((body for number, body in model if number == 3), b""))
        self.kind = kind or ("bpe" if trainer.get(3, 1) == 2 else "unigram")
        name = [p[1].decode() for p in pieces]
        type_ = [p.get(3, 1) for p in pieces]  # fixed values: 1 normal, 2 unknown, 3 control, 4 given by the user, 5 unused, 6 byte
        plain = [i for i, t in enumerate(type_) if t in (1, 4)]
        byte = {int(name[i][3:5], 16): i for i, t in enumerate(type_) if t == 6}
        self.unknown = type_.index(2)
        self.inner = {name[i]: i for i in plain}
        self.weight = {i: -struct.unpack("<f", pieces[i].get(2, bytes(4)))[0] for i in plain}
        self.bytes_of = [byte.get(b, self.unknown) for b in range(256)]
        self.fallback = len(byte) == 256
        self.worst = max(self.weight.values(), default=0.0) + 10
        self.output = [b""] * len(name)
        for i in plain:
            self.output[i] = name[i].replace(MARK, " ").encode()
        for b, i in byte.items():
            self.output[i] = bytes([b])
        rank = {p: self.weight[i] for p, i in self.inner.items()}
        self.program = PrefixProgram(self.inner, Merger(lambda a, b: rank.get(a + b)))
        self.single = {p for p in self.inner if len(p) == 1}
        #: Neighbouring symbols inside pieces: between any others no path crosses.
        self.bonds = {p[i : i + 2] for p in self.inner for i in range(len(p) - 1)}
        self.apart = not any(b[1] == MARK != b[0] for b in self.bonds)
        self.lines = self.apart and not any("\n" in p for p in self.inner) and self.normalise.prefix and not self.normalise.squeeze and not self.normalise.rules
        self.cut = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+", re.S) if self.apart else re.compile(".+", re.S)
        self.segments: dict[str, bytes] = {}

    def compose(self, segment: str) -> list[list[tuple[int, int]]]:
        """The arcs of a segment composed with pieces and fallback, by the place where they end: (length, piece), piece -1 for a symbol that none covers."""
        arcs: list[list[tuple[int, int]]] = [[] for _ in range(len(segment) + 1)]
        for at, (token, size, _) in self.program.auto.iter(segment):
            arcs[at + 1].append((size, token))
        for i, symbol in enumerate(segment, 1):
            if symbol not in self.single:
                arcs[i].append((1, -1))
        return arcs

    def weigh(self, before: int, token: int) -> float:
        """The weight of an arc after the piece ``before`` (-1: the start, or a symbol without a piece)."""
        if self.kind == "unigram":
            return self.weight[token] if token >= 0 else self.worst
        if token < 0:
            return 0.0
        pairs = self.program.pairs
        ok = pairs.get((before, token))
        if ok is None:
            if len(pairs) > 2_000_000:
                pairs.clear()
            ok = pairs[before, token] = self.program.compatible(before, self.program.text[token], False)
        return 0.0 if ok else math.inf

    def shortest_path(self, segment: str) -> tuple[float, list[tuple[int, str]]]:
        """The tropical shortest path of the composition: its weight, and its pieces with the symbols they stand for.

        States are places, and for merged pieces the last piece too; there only one state of a place has a finite
        distance, as a prefix has one encoding, so a place holds one distance in either case.
        """
        n = len(segment)
        distance, last, back = [0.0] + [math.inf] * n, [-1] * (n + 1), [0] * (n + 1)
        for i, arcs in enumerate(self.compose(segment)):
            for size, token in arcs:
                d = distance[i - size]
                if d < distance[i]:
                    d += self.weigh(last[i - size], token)
                    if d < distance[i]:
                        distance[i], last[i], back[i] = d, token, size
        steps, i = [], n
        while i:
            steps.append((last[i], segment[i - back[i] : i]))
            i -= back[i]
        return distance[n], steps[::-1]

    def lattice_path(self, segment: str) -> list[int]:
        """The ids of a segment."""
        out: list[int] = []
        for token, symbol in self.shortest_path(segment)[1]:
            if token >= 0:
                out.append(token)
            elif self.fallback:
                out += [self.bytes_of[b] for b in symbol.encode()]
            else:
                out.append(self.unknown)
        return out

    def segment_ids(self, segment: str) -> bytes:
        """The ids of a segment, put together from stretches that no piece crosses."""
        bonds, kept, out, a = self.bonds, self.segments, [], 0
        if len(kept) > KEPT_SEGMENTS:
            kept.clear()
        for i in range(1, len(segment) + 1):
            if i == len(segment) or segment[i - 1 : i + 1] not in bonds:
                part = segment[a:i]
                got = kept.get(part)
                if got is None:
                    got = np.array(self.lattice_path(part), np.int32).tobytes()
                    if len(part) < 64:
                        kept[part] = got
                out.append(got)
                a = i
        return b"".join(out)

    def __missing__(self, word: str) -> bytes:
        """The ids of a word with a mark in front, or of a line break and the word after it."""
        got = self.segment_ids(word if word[:1] == "\n" else MARK + word)
        if len(self) > KEPT_WORDS:
            self.clear()
        if len(word) < 64:
            self[word] = got
        return got

    def encode(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.int32)
        if self.lines and "  " not in text and MARK not in text and text[0] != " ":
            parts = map(self.__getitem__, text.replace("\n", " \n").split(" "))
        else:
            parts = map(self.segment_ids, self.cut.findall(self.normalise(text)))
        return np.frombuffer(b"".join(parts), np.int32)

    def decode(self, ids) -> str:
        out = b"".join(map(self.output.__getitem__, ids.tolist() if isinstance(ids, np.ndarray) else ids)).decode("utf-8", "replace")
        return out[1:] if self.normalise.prefix and out.startswith(" ") else out


@lru_cache(maxsize=4)
def transducer(path: str, kind: str | None = None) -> Transducer:
    return Transducer(path, kind)


class Held:
    """A transducer that a worker makes for itself.  Broadcast, so that its tables of words go with the first task that is not of its query, instead of staying in the worker."""

    def __init__(self, path: str, kind: str | None = None):
        self.path, self.kind = path, kind

    @cached_property
    def transducer(self) -> Transducer:
        return Transducer(self.path, self.kind)

    def __reduce__(self):
        return Held, (self.path, self.kind)


def encode(docs: DataFrame, path: str, kind: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_pieces, ids, round_trip): round_trip says that the ids decode to the text, but for marks in it."""

    held = docs.sparkSession.sparkContext.broadcast(Held(path, kind))

    def run(batches):
        own = held.value.transducer
        for batch in slices(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            ids = [own.encode(t) for t in texts]
            n = [len(x) for x in ids]
            same = [own.decode(x) == t.replace(MARK, " ") for x, t in zip(ids, texts)]
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(n))), pa.int32()), pa.array(np.concatenate(ids) if ids else [], pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), lists, pa.array(same, pa.bool_())], ["doc_id", "n_pieces", "ids", "round_trip"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def decode(encoded: DataFrame, path: str, kind: str | None = None) -> DataFrame:
    """(doc_id, text) from ids; null ids decode to the empty string."""

    held = encoded.sparkSession.sparkContext.broadcast(Held(path, kind))

    def run(batches):
        own = held.value.transducer
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")
