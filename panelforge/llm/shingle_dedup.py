"""Near copies by exact Jaccard similarity of word-shingle sets.

Candidates share a band of a MinHash signature: 32 bands of 4 rows miss a pair of similarity 0.8 with a probability of
5e-8, and pairs above it less often.  Rows with equal shingle sets are one row here.  Candidates are brought together by
components over links to each band's smallest member, so no band is expanded into pairs; then each candidate component
is searched with the shingle sets themselves, and only pairs whose sets reach the similarity are links.  A search takes
a row and compares it with all rows not reached yet, so near copies of one row cost one comparison each.

Defined cases: null and empty texts and texts without words have the empty set and are copies of each other; texts
shorter than a shingle have one shingle of all their words.  Repeated rows keep their number; extra columns are
ignored; an empty table gives an empty result.  A component of more than ``BLOCK`` rows is dealt by pairs of blocks, so a
task holds a bounded number of sets; links of all pairs are joined by components again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components, written
from .memory import begin_task, slices

U64 = np.uint64
SHINGLE, SIMILARITY = 5, 0.8
SEED, BANDS, ROWS = 42, 32, 4
#: Slots of the map of candidate ids that is broadcast (8 MB); a row that only shares a slot is read and left out.
SLOTS = 1 << 26
#: Rows of a candidate component in one block; a larger component is searched by pairs of blocks.
BLOCK = 4_096
_RNG = np.random.default_rng(SEED)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=U64)
_ODD = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=U64) * U64(2) + U64(1)
_MIX = _RNG.integers(0, 1 << 63, ROWS + 1, dtype=U64) * U64(2) + U64(1)


def shingles(text: str | None, k: int = SHINGLE) -> np.ndarray:
    """The distinct XXH64 of a text's word shingles in order."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, U64)
    k = min(k, len(words))
    line = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words])
    start = np.concatenate(([0], end[:-1]))[: len(words) - k + 1].tolist()
    return np.unique(np.array([xxh64_intdigest(line[a:b], SEED) for a, b in zip(start, (end[k - 1 :] - 1).tolist())], U64))


def set_key(own: np.ndarray) -> int:
    return xxh64_intdigest(own.tobytes(), SEED) - (1 << 63)


def bands(own: np.ndarray) -> np.ndarray:
    """A number for each band; equal in a band where its least values are."""
    least = np.full(BANDS * ROWS, np.iinfo(U64).max, U64)
    for i in range(0, len(own), 512):
        x = (own[i : i + 512, None] ^ _XOR) * _ODD
        np.minimum(least, x.min(axis=0), out=least)
    out = np.arange(1, BANDS + 1, dtype=U64) * _MIX[ROWS]
    for i in range(ROWS):
        out = (out ^ (out >> U64(29)) ^ least[i::ROWS]) * _MIX[i]
    return (out ^ (out >> U64(32))).view(np.int64)


def linked(sets: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """The component of each set, as the position of one of its members, by links of at least the similarity."""
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    _, code = np.unique(np.concatenate([sets[i] for i in order.tolist()]), return_inverse=True)
    code = code.astype(np.int32)
    size = size[order]
    end = np.cumsum(size)
    begin, label, left = end - size, np.full(len(sets), -1), np.arange(len(sets))
    held, marks = code, np.zeros(int(code.max(initial=-1)) + 1, np.int32)
    at = begin  # where the rows of ``left`` begin in ``held``
    while len(left):
        root, work, left, at = left[0], [left[0]], left[1:], at[1:]
        label[root] = root
        while work and len(left):
            x = work.pop()
            own = code[begin[x] : end[x]]
            lo = np.searchsorted(size[left], np.ceil(size[x] * similarity - 1e-6))
            hi = np.searchsorted(size[left], np.floor(size[x] / similarity + 1e-6), "right")
            if lo == hi:
                continue
            marks[own] = 1
            last = at[hi - 1] + size[left[hi - 1]]
            common = np.add.reduceat(marks[held[at[lo] : last]], at[lo:hi] - at[lo]) if size[x] else np.zeros(hi - lo, np.int64)
            marks[own] = 0
            both = size[x] + size[left[lo:hi]] - common
            near = np.zeros(len(left), bool)
            near[lo:hi] = common >= similarity * both - 1e-9
            if near.any():
                found = left[near]
                label[found] = root
                work += found.tolist()
                left = left[~near]
                held = np.concatenate([code[begin[i] : end[i]] for i in left.tolist()]) if len(left) else held[:0]
                at = np.cumsum(size[left]) - size[left]
    out = np.empty(len(sets), np.int64)
    out[order] = order[label]
    return out


def _signed(docs: DataFrame, k: int) -> DataFrame:
    def run(batches):
        for batch in slices(batches):
            sets = [shingles(t.as_py(), k) for t in batch.column(1)]
            keys = pa.array([set_key(s) for s in sets], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), keys, pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["doc_id", "key", "bands"])

    return docs.mapInArrow(run, "doc_id long, key long, bands array<long>")


def _slot(ids: np.ndarray) -> np.ndarray:
    return (ids.view(U64) * U64(0x9E3779B97F4A7C15) >> U64(38)).astype(np.int64)


def _slots(members: DataFrame) -> np.ndarray:
    """Bits of the slots of the members' doc_id, at most 8 MB."""

    def run(batches):
        for batch in batches:
            s = _slot(batch.column(0).to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(s >> 6), pa.array((U64(1) << (s & 63).astype(U64)).view(np.int64))], ["at", "bits"])

    got = members.select("doc_id").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = np.zeros(SLOTS // 64, U64)
    out[got["at"].to_numpy()] = got["bits"].to_numpy().view(U64)
    return out


def near_duplicates(docs: DataFrame, k: int = SHINGLE, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, component_id) for each row: component_id is the smallest doc_id reachable by links."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    signed = written(_signed(docs, k))
    distinct = written(signed.groupBy("key").agg(F.min("doc_id").alias("rep"), F.any_value("bands").alias("bands")))
    dealt = distinct.select("key", F.explode("bands").alias("band"))
    least = dealt.groupBy("band").agg(F.min("key").alias("hub"), F.count("*").alias("n")).where("n > 1").select("band", "hub")
    near = written(components(dealt.join(least, "band").select(F.col("key").alias("u"), F.col("hub").alias("v")))).withColumnRenamed("vertex", "key")
    blocks = near.groupBy("component").agg(F.ceil(F.count("*") / block).cast("int").alias("nb"))
    split = near.join(blocks, "component").withColumn("own", F.pmod(F.xxhash64("key"), F.col("nb")).cast("int")).select("key", "component", "nb", "own")
    members = distinct.select("key", "rep").where("rep is not null").join(split, "key").select(F.col("rep").alias("doc_id"), "key", "component", "nb", "own")
    held = docs.sparkSession.sparkContext.broadcast(_slots(members))

    def sets(batches):
        for batch in slices(batches):
            batch = batch.filter(batch.column(0).is_valid())
            s = _slot(batch.column(0).to_numpy())
            go = (held.value[s >> 6] >> (s & 63).astype(U64) & U64(1)).astype(bool)
            batch = batch.filter(pa.array(go))
            own = [shingles(t.as_py(), k) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([set_key(x) for x in own], pa.int64()), pa.array([x.tobytes() for x in own], pa.binary())], ["doc_id", "key", "body"])

    def search(t: pa.Table) -> pa.Table:
        begin_task()
        key = t["key"].to_numpy()
        key, first = np.unique(key, return_index=True)
        label = linked([np.frombuffer(t["body"][i].as_buffer(), U64) for i in first.tolist()], similarity)
        return pa.table({"key": pa.array(key), "link": pa.array(key[label])})

    found = docs.mapInArrow(sets, "doc_id long, key long, body binary").join(members, ["doc_id", "key"])
    dealt = found.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("nb") - 1)))
    grouped = dealt.groupBy("component", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    links = components(grouped.applyInArrow(search, "key long, link long").where("key <> link"), "key", "link")
    named = written(distinct.select("key", "rep").join(links.withColumnRenamed("vertex", "key"), "key", "left").select("key", "rep", F.coalesce("component", "key").alias("link")))
    first = named.groupBy("link").agg(F.min("rep").alias("component_id"))
    return signed.select("doc_id", "key").join(named.join(first, "link").select("key", "component_id"), "key").select("doc_id", "component_id")
