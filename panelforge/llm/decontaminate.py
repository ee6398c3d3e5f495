"""Benchmark decontamination by the q-gram lemma over diagonal bands and banded alignment.

Texts are normalised (lower case; runs of signs and spaces to one space).  An item of m characters occurs in a document
where some stretch of it is within an edit budget of ``rate * m``.  By the q-gram lemma such a stretch shares at least
``m - q + 1 - k q`` q-grams with the item, on diagonals that k insertions and deletions cannot leave; so shared q-grams
are counted in overlapping diagonal bands, bands that reach the bound are retained, and a banded alignment decides.
``rate`` and ``q`` keep the bound above zero for every item of at least ``q (1 + rate) / (1 - rate q)`` characters;
shorter items (but not empty ones) are searched for exactly, as whole words.

Items are read into tasks in blocks of at most ``BLOCK_BYTES`` of text, one pass over the documents a block, so what is
broadcast has a bound whatever the size of the benchmark.

Defined cases: null and empty texts match nothing, on either side.  Repeated items and repeated rows each count.  Ids
may be null.  Extra columns are ignored.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import U64, gram_hashes, mix
from .memory import slices

RATE, GRAM = 0.08, 8
BLOCK_BYTES = 16 << 20
SCHEMA = "doc_id long, item_id long, begin int, end int, edits int, budget int"
#: Characters of documents searched at once.
RUN = 1 << 20
_SIGN, _SPACES = re.compile(r"[^\w ]|_"), re.compile(" {2,}")
#: The same for ASCII alone, byte by byte.
_ASCII = bytes(ord(chr(i).lower()) if chr(i).isalnum() and i < 128 else 32 for i in range(256))


def normalise(text: str | None) -> str:
    if text and text.isascii():
        return b" ".join(text.encode().translate(_ASCII).split()).decode()
    return _SPACES.sub(" ", _SIGN.sub(" ", (text or "").lower())).strip()


def _codes(text: str) -> np.ndarray:
    if text.isascii():
        return np.frombuffer(text.encode(), np.uint8)
    try:
        return np.frombuffer(text.encode("latin-1"), np.uint8)
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(codes: np.ndarray, q: int) -> np.ndarray:
    """A hash of each q-gram of code points."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    if codes.dtype == np.uint8:
        return gram_hashes(codes, q)
    with np.errstate(over="ignore"):
        low = gram_hashes((codes & 255).astype(np.uint8), q)
        high = gram_hashes((codes >> 8 & 255).astype(np.uint8), q)
        top = gram_hashes((codes >> 16).astype(np.uint8), q)
        zero_h, zero_t = gram_hashes(np.zeros(q, np.uint8), q)[0], gram_hashes(np.zeros(q, np.uint8), q)[0]
        return low ^ mix(high ^ zero_h) ^ mix((top ^ zero_t) * U64(3))


def banded(item: np.ndarray, text: np.ndarray, centre: int, half: int, budget: int) -> tuple[int, int, int] | None:
    """Fewest edits of the whole item against a stretch of the text on diagonals within ``half`` of ``centre``: (edits, begin, end), or None above the budget."""
    m, width = len(item), 2 * half + 1
    far = m + width + 1
    cols = np.arange(width)
    start = centre - half + cols  # column of the text for row 0
    # what the band meets of the text, row by row one place further: letters (outside of it one that equals none), and columns inside it
    first, last = centre - half, centre + half + m
    letters = np.full(last - first, 0xFFFFFFFF, np.uint32)
    lo, hi = max(first, 0), min(last, len(text))
    if lo < hi:
        letters[lo - first : hi - first] = text[lo:hi]
    place = np.arange(first, last + 1)
    outside = (place < 0) | (place > len(text))
    bounded = bool(outside.any())
    cost = np.where(outside[:width], far, 0)
    origin = start.copy()
    for i in range(1, m + 1):
        best = cost + (letters[i - 1 : i - 1 + width] != item[i - 1])
        up = cost[1:] + 1  # the item's letter left out
        take = up < best[:-1]
        frm = origin.copy()
        np.copyto(best[:-1], up, where=take)
        np.copyto(frm[:-1], origin[1:], where=take)
        if bounded:
            best[outside[i : i + width]] = far
        # letters of the text left out: a running minimum along the row
        best -= cols
        least = np.minimum.accumulate(best)
        at = np.maximum.accumulate(np.where(best == least, cols, 0))
        least += cols
        cost, origin = least, frm[at]
        if cost.min() > budget:
            return None
    end = int(np.argmin(cost))
    return int(cost[end]), int(origin[end]), int(start[end] + m)


def verbatim(item: np.ndarray, text: np.ndarray, centre: int, half: int) -> tuple[int, int, int] | None:
    """What ``banded`` finds where the whole item stands in the text on a diagonal of the band, without an alignment."""
    first = max(centre - half, 0)
    part, width = text[first : max(centre + half + len(item), 0)], text.dtype.itemsize
    if item.dtype.itemsize > width:  # letters that the text has none of
        return None
    body, own, at = part.tobytes(), item.astype(text.dtype).tobytes(), -1
    while (at := body.find(own, at + 1)) >= 0:
        if at % width == 0:
            return 0, first + at // width, first + at // width + len(item)
    return None


class Items:
    """A block of benchmark items: their q-grams in a sorted table."""

    def __init__(self, rows: list[tuple[int | None, str]], rate: float = RATE, q: int = GRAM):
        self.q, self.rate = q, rate
        texts = [(i, normalise(t)) for i, t in rows]
        self.short = [(i, f" {t} ") for i, t in texts if t and self.bound(len(t)) < 1]  # as whole words
        texts = [(i, t) for i, t in texts if t and self.bound(len(t)) >= 1]
        self.ids = [i for i, _ in texts]
        self.codes = [_codes(t) for _, t in texts]
        self.size = np.array([len(c) for c in self.codes], np.int64)
        self.budget = (self.size * rate).astype(np.int64)
        grams = [_grams(c, q) for c in self.codes]
        value = np.concatenate(grams) if grams else np.zeros(0, U64)
        order = np.argsort(value, kind="stable")
        self.value = value[order]
        self.item = np.repeat(np.arange(len(grams)), [len(g) for g in grams])[order]
        self.place = np.concatenate([np.arange(len(g)) for g in grams])[order] if grams else np.zeros(0, np.int64)
        self.known, self.first, self.many = np.unique(self.value, return_index=True, return_counts=True)
        self.filter = np.zeros(1 << 22, bool)
        self.filter[(self.known >> U64(42)).astype(np.int64)] = True

    def bound(self, m: int) -> int:
        return m - self.q + 1 - int(m * self.rate) * self.q

    def find(self, texts: list[str | None]) -> list[tuple]:
        """(row, item id, begin, end, edits, budget) of the best place of each item found in each text; places are of the normalised text."""
        out, lines, size, first = [], [], 0, 0
        for i, t in enumerate(texts):
            line = normalise(t)
            lines.append(line)
            size += len(line) + 1
            if size >= RUN or i + 1 == len(texts):
                out += self._find(lines, first)
                lines, size, first = [], 0, i + 1
        return out

    def _find(self, lines: list[str], first: int) -> list[tuple]:
        out = []
        if self.short:
            for r, line in enumerate(lines):
                inside = f" {line} "
                out += [(first + r, i, inside.index(t), inside.index(t) + len(t) - 2, 0, 0) for i, t in self.short if t in inside]
        codes = _codes("\0".join(lines))
        grams = _grams(codes, self.q)
        if not len(grams) or not len(self.known):
            return out
        at = np.flatnonzero(self.filter[(grams >> U64(42)).astype(np.int64)])
        slot = np.searchsorted(self.known, grams[at])
        slot[slot == len(self.known)] = 0
        hit = self.known[slot] == grams[at]
        at, slot = at[hit], slot[hit]
        begin = np.cumsum([0, *(len(x) + 1 for x in lines)])
        row = np.searchsorted(begin, at, "right") - 1
        enough = np.bincount(row, minlength=len(lines)) >= np.maximum(self.size - self.q + 1 - self.budget * self.q, 1).min()
        edge = np.searchsorted(row, np.arange(len(lines) + 1))
        for r in np.flatnonzero(enough).tolist():
            a, z = edge[r], edge[r + 1]
            out += [(first + r, *x) for x in self._bands(codes[begin[r] : begin[r + 1] - 1], at[a:z] - begin[r], slot[a:z])]
        return out

    def _bands(self, codes: np.ndarray, at: np.ndarray, slot: np.ndarray) -> list[tuple]:
        """Count shared q-grams of one text in bands and verify those that reach the bound."""
        many = self.many[slot]
        rank = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(self.first[slot], many) + rank
        item, diagonal = self.item[entry], np.repeat(at, many) - self.place[entry] + int(self.size.max())
        least = np.maximum(self.size - self.q + 1 - self.budget * self.q, 1)
        enough = np.bincount(item, minlength=len(self.size)) >= least
        keep = enough[item]
        if not keep.any():
            return []
        item, diagonal = item[keep], diagonal[keep]
        found: dict[int, tuple] = {}
        width = 2 * self.budget + 1
        for half in (0, 1):
            w = width[item]
            band = (diagonal + half * w // 2) // w
            key = item * (1 << 40) + band
            keys, count = np.unique(key, return_counts=True)
            for k in keys[count >= least[keys >> 40]].tolist():
                i, b = k >> 40, k & ((1 << 40) - 1)
                wi = int(width[i])
                centre = b * wi - half * wi // 2 + wi // 2 - int(self.size.max())
                got = verbatim(self.codes[i], codes, centre, wi) or banded(self.codes[i], codes, centre, wi, int(self.budget[i]))
                if got and got[0] <= self.budget[i] and (i not in found or got < found[i]):
                    found[i] = got
        return [(self.ids[i], b, e, d, int(self.budget[i])) for i, (d, b, e) in sorted(found.items())]


def find_leaks(docs: DataFrame, benchmark: DataFrame, rate: float = RATE, q: int = GRAM, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """(doc_id, item_id, begin, end, edits, budget): each item that occurs in each document, at its best place."""
    items = benchmark.select(F.col(item_col).cast("long").alias("item_id"), F.col(item_text).alias("text")).where("text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // BLOCK_BYTES))
    spark, source = docs.sparkSession, docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    out = None
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block).collect()
        held = spark.sparkContext.broadcast(Items([(r[0], r[1]) for r in rows], rate, q))

        def run(batches, held=held):
            for batch in slices(batches):
                ids, rows = batch.column(0).to_pylist(), []
                for at in range(0, len(ids), 256):
                    rows += [(ids[at + hit[0]], *hit[1:]) for hit in held.value.find(batch.column(1)[at : at + 256].to_pylist())]
                cols = list(zip(*rows)) if rows else [[]] * 6
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, [pa.int64(), pa.int64(), *[pa.int32()] * 4])], ["doc_id", "item_id", "begin", "end", "edits", "budget"])

        part = source.mapInArrow(run, SCHEMA)
        out = part if out is None else out.union(part)
    return out
