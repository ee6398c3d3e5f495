"""SimHash fingerprints of word shingles, linked by tiled exact comparison.

All distinct fingerprints are compared exactly: numpy exclusive-or and bit counts over pairs of tiles.  A tile holds
fingerprints with equal population counts in each quarter of 16 bits; two fingerprints within radius r differ by at
most r in the sum of those counts, so tile pairs beyond it are skipped and no link is lost.  Work is dealt as a grid:
tiles in the order of their counts are packed into blocks of a bounded number of fingerprints (a larger tile is split),
a fingerprint goes only to the pairs of its block with blocks that come within the radius, and a pair of blocks is one
group, so no group grows with the input.  Equal fingerprints are one row here, so copies are never paired with each
other; a group emits a spanning forest of its links, so near copies are not expanded into all pairs either.

Defined cases: null and empty texts and texts without words have fingerprint zero and link like any other.  Rows with
a null doc_id link like any other; component_id is the smallest doc_id that is not null, and null where a component has
none.  Repeated rows keep their number; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .components import components, local_labels, written
from .memory import begin_task, slices

U64 = np.uint64
SEED, SHINGLE, RADIUS = 42, 3, 3
#: Fingerprints in a block of the comparison grid, and edges held before they are reduced to a forest.
BLOCK, EDGES = 1 << 15, 1 << 21
_STEP = 1 << 16
_PLACE = np.array([17**3, 17**2, 17, 1])


def fingerprint(text: str | None, k: int = SHINGLE, seed: int = SEED) -> int:
    """The 64-bit SimHash of a text: a bit is set where over half of the shingles' XXH64 have it."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return 0
    k = min(k, len(words))
    line = b" ".join(words)
    end = np.cumsum([len(w) + 1 for w in words])
    start = np.concatenate(([0], end[:-1]))[: len(words) - k + 1].tolist()
    end = (end[k - 1 :] - 1).tolist()
    n, count = len(start), np.zeros(64, np.int64)
    for i in range(0, n, _STEP):
        h = np.array([xxh64_intdigest(line[a:b], seed) for a, b in zip(start[i : i + _STEP], end[i : i + _STEP])], U64)
        count += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int32)
    return int(np.packbits(count * 2 > n, bitorder="little").view(U64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(doc_id, fp) with the fingerprint's bits as a long."""

    def run(batches):
        for batch in slices(batches):
            fp = np.array([fingerprint(t.as_py(), k) for t in batch.column(1)], U64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fp, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, "doc_id long, fp long")


def _quarters(fp: np.ndarray) -> np.ndarray:
    return np.stack([np.bitwise_count(fp >> U64(16 * i) & U64(0xFFFF)) for i in range(4)], axis=1).astype(np.int8)


def _tiles(fp: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """An order by quarter counts, the edges of its tiles, and the tiles' counts."""
    q = _quarters(fp)
    code = q.astype(np.int64) @ np.array([1 << 15, 1 << 10, 1 << 5, 1])
    order = np.argsort(code, kind="stable")
    new = np.flatnonzero(np.diff(code[order], prepend=-1))
    return order, np.append(new, len(fp)), q[order[new]].astype(np.int16)


def links(left: np.ndarray, right: np.ndarray, radius: int = RADIUS):
    """Yield index arrays (i, j) of all pairs within the radius."""
    lo, le, lq = _tiles(left)
    ro, re_, rq = _tiles(right)
    for t in range(len(lq)):
        near = np.flatnonzero(np.abs(rq - lq[t]).sum(axis=1) <= radius)
        if not len(near):
            continue
        rows = ro[np.concatenate([np.arange(re_[x], re_[x + 1]) for x in near.tolist()])]
        tile = lo[le[t] : le[t + 1]]
        step = max(1, (1 << 20) // max(1, len(rows)))
        for a in range(0, len(tile), step):
            part = tile[a : a + step]
            i, j = np.nonzero(np.bitwise_count(left[part][:, None] ^ right[rows][None, :]) <= radius)
            if len(i):
                yield part[i], rows[j]


def _forest(table: pa.Table, radius: int) -> pa.Table:
    """A spanning forest of the links between the two sides of a pair of blocks."""
    begin_task()
    fp = table.column("fp").to_numpy().view(U64)
    side = table.column("side").to_numpy()
    left, right = np.flatnonzero(side != 1), np.flatnonzero(side != 0)
    label, a, b, held = np.arange(len(fp)), [], [], 0
    for i, j in links(fp[left], fp[right], radius):
        a.append(left[i])
        b.append(right[j])
        held += len(i)
        if held > EDGES:
            label = local_labels(len(fp), np.concatenate((np.arange(len(fp)), *a)), np.concatenate((label, *b)))
            a, b, held = [], [], 0
    label = local_labels(len(fp), np.concatenate((np.arange(len(fp)), *a)), np.concatenate((label, *b)))
    child = np.flatnonzero(label != np.arange(len(fp)))
    return pa.table({"u": pa.array(fp[child].view(np.int64)), "v": pa.array(fp[label[child]].view(np.int64))})


class Grid:
    """Blocks of at most about ``block`` fingerprints, each a run of tiles in the order of (population count, quarter counts) or a part of one tile."""

    def __init__(self, tiles: np.ndarray, counts: np.ndarray, radius: int, block: int):
        self.radius = radius
        pop = tiles.sum(axis=1)
        order = np.lexsort((*tiles.T[::-1], pop))
        self.code = np.full(17**4, -1, np.int32)  # first block of a tile
        self.parts = np.ones(17**4, np.int32)  # blocks of a tile
        low, high, pops, held = [], [], [], block
        for t in order.tolist():
            q, n = tiles[t], int(counts[t])
            at = int(q @ _PLACE)
            self.parts[at] = k = -(-n // block)
            if k > 1 or held + n > block or pops[-1] != pop[t]:
                self.code[at] = len(low)
                pops += [int(pop[t])] * k
                low += [q.copy() for _ in range(k)]
                high += [q.copy() for _ in range(k)]
                held = block if k > 1 else n
            else:
                self.code[at] = len(low) - 1
                low[-1], high[-1], held = np.minimum(low[-1], q), np.maximum(high[-1], q), held + n
        self.low, self.high = np.array(low, np.int16).reshape(-1, 4), np.array(high, np.int16).reshape(-1, 4)
        self.pop = np.array(pops, np.int16)

    def near(self, i: int) -> np.ndarray:
        """Blocks with a fingerprint that may lie within the radius of one of block ``i``: population counts differ by no more, in all and over the quarters."""
        gap = np.maximum(0, np.maximum(self.low[i] - self.high, self.low - self.high[i])).sum(axis=1)
        return np.flatnonzero((gap <= self.radius) & (abs(self.pop - self.pop[i]) <= self.radius))

    def own(self, fp: np.ndarray) -> np.ndarray:
        at = _quarters(fp).astype(np.int64) @ _PLACE
        with np.errstate(over="ignore"):
            part = ((fp * U64(0x9E3779B97F4A7C15)) >> U64(40)).astype(np.int64) % self.parts[at]
        return self.code[at] + part


def link_edges(distinct: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """Edges (u, v) between fingerprints whose components are those of all links.  distinct: (fp), each once.

    The counts of tiles reach the driver, at most 17**4 rows, and the grid of blocks the tasks: ten bytes for each
    ``block`` fingerprints.
    """
    quarter = [F.bit_count(F.shiftrightunsigned("fp", 16 * i).bitwiseAND(F.lit(0xFFFF))).alias(f"q{i}") for i in range(4)]
    got = distinct.groupBy(*quarter).agg(F.count("*").alias("n")).toArrow()
    tiles = np.stack([got[f"q{i}"].to_numpy() for i in range(4)], axis=1).astype(np.int64).reshape(-1, 4)
    grid = distinct.sparkSession.sparkContext.broadcast(Grid(tiles, got["n"].to_numpy(), radius, block))

    def deal(batches):
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            fp = batch.column(0).to_numpy().view(U64)
            own = grid.value.own(fp)
            for i in np.unique(own).tolist():
                if i not in held:
                    if len(held) > 4096:
                        held.clear()
                    held[i] = grid.value.near(i)
                near, mine = held[i], fp[own == i].view(np.int64)
                j = np.repeat(near, len(mine))
                side = np.where(j == i, 2, (j < i).astype(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(i, j).astype(np.int32)), pa.array(np.maximum(i, j).astype(np.int32)), pa.array(side.astype(np.int32)), pa.array(np.tile(mine, len(near)))], ["i", "j", "side", "fp"])

    dealt = distinct.select("fp").mapInArrow(deal, "i int, j int, side int, fp long")
    return dealt.groupBy("i", "j").applyInArrow(lambda t: _forest(t, radius), "u long, v long")


def near_duplicates(docs: DataFrame, k: int = SHINGLE, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """(doc_id, fingerprint, component_id) for each row: component_id is the smallest doc_id reachable by links."""
    fps = written(fingerprints(docs, id_col, text_col, k))
    distinct = written(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")))
    comp = components(link_edges(distinct.select("fp"), radius, block))
    rooted = distinct.join(comp, distinct["fp"] == comp["vertex"], "left").select("fp", "rep", F.coalesce("component", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return fps.join(named, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
