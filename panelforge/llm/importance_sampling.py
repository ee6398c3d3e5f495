"""Importance resampling of documents towards a target's distribution of hashed word n-grams.

A batch's texts are joined with separators, lower-cased (A-Z) and searched by one regex pass; searchsorted places each word in
its document by the documents' offsets, runs of words that cross into another document are masked, and bincount adds up the
buckets (crc32 of the words, joined by one space, modulo ``buckets``).  One pass over the documents and one over the target
give the two histograms, ``buckets`` numbers each; a second pass weighs each document by the floored mean of its features'
gains, 1000 ln of the smoothed ratio of both, in whole numbers.  A Gumbel number drawn from sha256 of seed and id makes the
highest scores a weighted draw without replacement.  The drawn are ranked by a range partition of (score, id, row) whose
partitions count themselves, so no task sees them all.

Defined cases: null texts have no words; a document without features weighs 0.  Rows without a doc_id draw the number of the
seed alone and come last among ties.  Repeated ids draw the same number; equal rows are ranked in any order.  An empty target
counts as no features.  Tables may be empty; extra columns make no difference.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .components import written

BUCKETS, ORDER, SEED, LEAST_WORDS, PERCENT = 10_000, 1, 2024, 20, 10
#: All bytes but 0x00-0x2F, 0x3A-0x60 and 0x7B-0x7F, after A-Z became a-z.
WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
#: Words taken from the regex pass at a time.
BLOCK = 1 << 17
SCHEMA = "row long, doc_id long, n_words long, n_features long, weight long, score long"


def features(texts: pa.Array, order: int = ORDER, buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (document of each word, document of each feature, its bucket) of a batch of texts."""
    size = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    offset = np.concatenate(([0], np.cumsum(size + 1)))[:-1]
    found = WORD.finditer("\n".join(t or "" for t in texts.to_pylist()).encode().lower())
    words: list[bytes] = []  # the last order - 1 words of the block before go first
    doc = np.zeros(0, np.int64)
    while block := list(islice(found, BLOCK)):
        old = len(words)
        words += [m.group() for m in block]
        here = np.searchsorted(offset, np.fromiter((m.start() for m in block), np.int64, len(block)), "right") - 1
        doc = np.concatenate((doc, here))
        docs, codes = [], []
        for n in range(1, order + 1):
            code = list(map(zlib.crc32, words)) if n == 1 else [zlib.crc32(w, zlib.crc32(b" ", c)) for c, w in zip(code, words[n - 1 :])]
            ends = np.arange(n - 1, len(words))
            keep = (doc[ends - (n - 1)] == doc[ends]) & (ends >= old)
            docs.append(doc[ends][keep])
            codes.append(np.array(code, np.int64)[keep] % buckets)
        yield here, np.concatenate(docs), np.concatenate(codes)
        words, doc = (words[1 - order :], doc[1 - order :]) if order > 1 else ([], doc[:0])


def histogram(rows: DataFrame, text_col: str = "text", order: int = ORDER, buckets: int = BUCKETS) -> np.ndarray:
    """Features in each bucket, over all rows."""

    def count(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, code in features(batch.column(0), order, buckets):
                total += np.bincount(code, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["bucket", "n"])

    out = np.zeros(buckets, np.int64)
    for r in rows.select(F.col(text_col).alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most ``buckets`` rows
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln((t + 1)(S + buckets) / ((s + 1)(T + buckets)))) of each bucket, in doubles."""
    s, t, k = raw.astype(float), target.astype(float), len(raw)
    return np.array([math.floor(1000 * math.log(a / b)) for a, b in zip((t + 1) * (s.sum() + k), (s + 1) * (t.sum() + k))], np.int64)


def gumbel(doc_id: int | None, seed: int = SEED) -> int:
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weigh(docs: DataFrame, gain: np.ndarray, order: int = ORDER, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, doc_id, n_words, n_features, weight, score) for each document."""
    held = docs.sparkSession.sparkContext.broadcast(gain)  # a number a bucket

    def run(batches):
        for batch in batches:
            n = batch.num_rows
            words, count, total = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
            for here, doc, code in features(batch.column(2), order, len(held.value)):
                words += np.bincount(here, minlength=n)
                count += np.bincount(doc, minlength=n)
                total += np.bincount(doc, held.value[code], n).astype(np.int64)  # whole numbers below 2^53
            weight = total // np.maximum(count, 1)
            drawn = np.array([gumbel(i, seed) for i in batch.column(1).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *(pa.array(x, pa.int64()) for x in (words, count, weight, weight + drawn))], ["row", "doc_id", "n_words", "n_features", "weight", "score"])

    return docs.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def ranked(rows: DataFrame, order: list) -> DataFrame:
    """Adds ``rank``, the place of each row in an order that breaks all ties, from 1."""
    laid = written(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()))
    sizes = laid.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count("*").alias("n"))
    before = sizes.select("part", (F.sum("n").over(W.orderBy("part")) - F.col("n")).alias("before"))  # a row for each partition
    own = laid.withColumn("part", F.shiftright("at", 33)).withColumn("place", F.col("at").bitwiseAND(F.lit((1 << 33) - 1)))
    return own.join(F.broadcast(before), "part").withColumn("rank", F.col("before") + F.col("place") + 1).drop("at", "part", "place", "before")


def resample(docs: DataFrame, target: DataFrame, order: int = ORDER, buckets: int = BUCKETS, percent: int = PERCENT, least_words: int = LEAST_WORDS, seed: int = SEED, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_features, weight, score, rank, n_words) for each document; rank is null where it is not drawn."""
    gain = gains(histogram(docs, text_col, order, buckets), histogram(target, text_col, order, buckets))
    told = written(weigh(docs, gain, order, seed, id_col, text_col))
    fit = F.col("n_words") >= least_words
    most = percent * told.where(fit).count() // 100
    placed = ranked(told.where(fit), [F.desc("score"), F.asc_nulls_last("doc_id"), F.asc("row")])
    every = placed.withColumn("rank", F.when(F.col("rank") <= most, F.col("rank"))).unionByName(told.where(~fit).withColumn("rank", F.lit(None).cast("long")))
    return every.select("doc_id", "n_features", "weight", "score", "rank", "n_words")
