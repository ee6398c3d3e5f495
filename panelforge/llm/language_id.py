"""Language identification by bit-sliced Bloom filters of character n-grams.

Each language has a set of its most frequent n-grams (3 and 4 bytes of letters, word edges included), the same number
for all.  The sets share one table of cells whose bits are languages (a row of cells for every 64 of them): the cells of
an n-gram's hashes, and-ed, return all languages that contain it in one look-up.  Per language the hits are counted over the text, corrected for the
filter's false positives, and the highest rate decides.

Learned from at most ``sample`` documents with a language whose crc32(doc_id) mod 3 is not 1.  Defined cases: null
texts and texts without letters (Unicode category L) are ``und`` with score 0; with no training rows all are ``und``.  A null doc_id is
held out by nothing and trains nothing.  Equal rates go to the language first in the alphabet.
"""

from __future__ import annotations

import re
import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .flat import U64, mix
from .sampling import bounded, bucket_of

SAMPLE, GRAMS, CELLS = 8_192, 6_000, 1 << 18
SCHEMA = "doc_id long, held_out boolean, lang_pred string, score double"


#: Runs of anything but letters, digits of other numeral kinds left in.
_OTHER = re.compile(r"[\W\d_]+")


@lru_cache(maxsize=1)
def numerals() -> frozenset[str]:
    """Signs that ``\\w`` takes in and that are neither letters nor digits, such as fractions and circled numbers."""
    return frozenset(c for c in map(chr, range(128, sys.maxunicode + 1)) if c.isalnum() and not c.isalpha() and not c.isdecimal())


def letters(text: str | None) -> bytes:
    """Lower-case letters with single spaces between and around words."""
    text = (text or "").lower()
    if not text.isascii():
        for sign in numerals().intersection(text):
            text = text.replace(sign, " ")
    return (" " + _OTHER.sub(" ", text).strip() + " ").encode("utf-8", "replace")


def grams(line: bytes) -> np.ndarray:
    """Numbers of the 3- and 4-grams of bytes."""
    b = np.frombuffer(line, np.uint8).astype(np.uint32)
    if len(b) < 3:
        return np.zeros(0, np.uint32)
    three = b[:-2] | b[1:-1] << 8 | b[2:] << 16
    return np.concatenate((three, three[:-1] | b[3:] << 24))


def cells(g: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    with np.errstate(over="ignore"):
        h = mix(g.astype(U64) + U64(0x9E3779B97F4A7C15))
    m = U64(n - 1)
    return (h & m).astype(np.int32), (h >> U64(20) & m).astype(np.int32), (h >> U64(40) & m).astype(np.int32)


class Filters:
    """``table`` has a row of ``n`` cells for every 64 languages."""

    def __init__(self, sets: dict[str, np.ndarray], n: int = CELLS):
        self.names = sorted(sets)
        self.n = n
        self.table = np.zeros((-(-len(self.names) // 64), n), np.uint64)
        for i, name in enumerate(self.names):
            for c in cells(sets[name], n):
                self.table[i // 64, c] |= U64(1 << i % 64)
        full = [float((self.table[i // 64] >> U64(i % 64) & U64(1)).mean()) for i in range(len(self.names))]
        self.false = np.array(full) ** 3

    def rates(self, line: bytes) -> np.ndarray | None:
        g = grams(line)
        if not len(g) or not self.names:
            return None
        hits = np.zeros(len(self.names))
        for s in range(0, len(g), 1 << 20):
            a, b, c = cells(g[s : s + (1 << 20)], self.n)
            for w, row in enumerate(self.table):
                found = row[a] & row[b] & row[c]
                hits[64 * w : 64 * w + 64] += [np.count_nonzero(found & U64(1 << i)) for i in range(min(64, len(self.names) - 64 * w))]
        return np.clip((hits / len(g) - self.false) / (1 - self.false), 0, 1)

    def predict(self, text: str | None) -> tuple[str, float]:
        line = letters(text)
        rates = self.rates(line) if line.strip() else None
        if rates is None:
            return "und", 0.0
        best = int(rates.argmax())
        return self.names[best], float(rates[best])


def train(docs: DataFrame, sample: int = SAMPLE, top: int = GRAMS, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Filters:
    rows = bounded(docs.where((bucket_of(id_col, 3) != 1) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()), id_col, sample)

    def count(batches):
        for batch in batches:
            held: dict[str, list] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(lang, []).append(np.unique(grams(letters(text))))
            for lang, parts in held.items():
                g, n = np.unique(np.concatenate(parts), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.astype(np.int64)), pa.array(n.astype(np.int64))], ["lang", "g", "n"])

    counted = rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).mapInArrow(count, "lang string, g long, n long").groupBy("lang", "g").agg(F.sum("n").alias("n"))
    best = counted.withColumn("r", F.row_number().over(W.partitionBy("lang").orderBy(F.desc("n"), "g"))).where(F.col("r") <= top)
    sets: dict[str, list] = {}
    for r in best.select("lang", "g").collect():  # bounded: ``top`` for each language
        sets.setdefault(r[0], []).append(r[1])
    return Filters({k: np.array(v, np.uint32) for k, v in sets.items()})


def predict(docs: DataFrame, filters: Filters, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    held = docs.sparkSession.sparkContext.broadcast(filters)

    def run(batches):
        for batch in batches:
            got = [held.value.predict(t.as_py()) for t in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([g[0] for g in got], pa.string()), pa.array([g[1] for g in got], pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(bucket_of(id_col, 3) == 1, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
