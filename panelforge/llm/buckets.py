"""Documents dealt to buckets by a hash of their id and text, and questions that buckets put to shards of a hash space.

A shard sees a key once from each bucket, however many rows of the bucket hold it, and its replies go up a tree: a
group hears at most ``1 << FAN`` buckets, and passes on one entry for each key, so a key that a third of all rows share
costs no group more than that.  Buckets and shards are groups, not partitions: their number follows the size of the
input, so that each fits in a worker's memory at any scale, while ``spark.sql.shuffle.partitions`` says how many tasks
share them out.  The bucketed documents are shuffled once: the plans below share that exchange (ReusedExchange), and
nothing is kept on an executor that cannot be made again.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import U64, mix
from .memory import begin_task

MESSAGE = "s int, b int, kind int, body binary"
_TYPE = pa.schema([("s", pa.int32()), ("b", pa.int32()), ("kind", pa.int32()), ("body", pa.binary())])
#: Bytes of text that make a bucket.
BUCKET_BYTES = 4_200_000
#: Buckets that a group of a tree hears, as a power of two.
FAN = 8


def bucket_count(docs: DataFrame, per: int = BUCKET_BYTES, text_col: str = "text") -> int:
    """Buckets for the texts, by their measured size."""
    size = docs.agg(F.sum(F.octet_length(F.col(text_col)).cast("long"))).first()[0] or 0
    return int(min(max(64, -(-size // per)), 2**30))


def bucketed(docs: DataFrame, n: int, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """(b, doc_id, text) and a column that names the row, if asked for: null texts as empty ones.  Rows that share an id, or have none, are dealt by their texts too."""
    key, text = F.col(id_col).cast("long"), F.coalesce(F.col(text_col), F.lit(""))
    own = [F.col(row_col).alias("row")] if row_col else []
    return docs.select(F.pmod(F.xxhash64(key, text), F.lit(n)).cast("int").alias("b"), key.alias("doc_id"), text.alias("text"), *own)


class Bucket:
    """The documents of a bucket in the order of (doc_id, text), nulls last, with their bytes end to end."""

    def __init__(self, table: pa.Table):
        begin_task()
        table = table.select([c for c in ("doc_id", "text", "row") if c in table.column_names])
        order = pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("text", "ascending")], null_placement="at_end")
        table = table.take(order)
        self.ids = table.column("doc_id")
        self.rows = table.column("row") if "row" in table.column_names else None
        self.n = table.num_rows
        text = table.column("text").combine_chunks() if self.n else pa.array([], pa.string())
        if isinstance(text, pa.ChunkedArray):
            text = text.combine_chunks()
        wide = pa.types.is_large_string(text.type)
        offsets = np.frombuffer(text.buffers()[1], np.int64 if wide else np.int32)[text.offset : text.offset + self.n + 1].astype(np.int64) if self.n else np.zeros(1, np.int64)
        body = text.buffers()[2] if self.n else None
        whole = np.frombuffer(body, np.uint8) if body is not None and body.size else np.zeros(0, np.uint8)
        self.data = whole[offsets[0] : offsets[-1]]
        self.offset = offsets - offsets[0]
        self.key = np.asarray(self.ids.fill_null(np.iinfo(np.int64).max).to_numpy(), np.int64) if self.n else np.zeros(0, np.int64)

    def runs(self, most: int = 1 << 20):
        """Documents in runs of about ``most`` bytes: first and last document, first byte, bytes."""
        lengths = np.diff(self.offset)
        a, size = 0, 0
        for i, n in enumerate(lengths.tolist()):
            if size and size + n > most:
                yield a, i, int(self.offset[a]), self.data[self.offset[a] : self.offset[i]]
                a, size = i, 0
            size += n
        if a < self.n:
            yield a, self.n, int(self.offset[a]), self.data[self.offset[a] : self.offset[self.n]]


def messages(rows: list[tuple[int, int, int, bytes]]) -> pa.Table:
    s, b, kind, body = zip(*rows) if rows else ((), (), (), ())
    return pa.table([pa.array(s, pa.int32()), pa.array(b, pa.int32()), pa.array(kind, pa.int32()), pa.array(body, pa.binary())], schema=_TYPE)


def rows_of(table: pa.Table) -> list[tuple[int, int, int, bytes]]:
    begin_task()
    return sorted(zip(table.column("s").to_pylist(), table.column("b").to_pylist(), table.column("kind").to_pylist(), table.column("body").to_pylist()), key=lambda r: r[:3])


def ask(docs: DataFrame, question: Callable[[int, Bucket], list], told: DataFrame | None = None) -> DataFrame:
    """One message table from each bucket; ``told`` are the messages to it."""
    if told is None:
        return docs.groupBy("b").applyInArrow(lambda key, t: messages(question(key[0].as_py(), Bucket(t))), MESSAGE)
    return docs.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(lambda key, t, m: messages(question(key[0].as_py(), Bucket(t), rows_of(m)) if t.num_rows else []), MESSAGE)


def answer(asked: DataFrame, reply: Callable[[int, list], list]) -> DataFrame:
    """Each shard's messages to the buckets."""
    return asked.groupBy("s").applyInArrow(lambda key, t: messages(reply(key[0].as_py(), rows_of(t))), MESSAGE)


def climb(asked: DataFrame, n: int, reply: Callable[[int, list, bool], list], fan: int = FAN) -> DataFrame:
    """The messages of ``n`` buckets to the shards, up a tree of groups; the reply's last argument says whether a group is the root."""

    def step(root: bool):
        return lambda key, t: messages(reply(key[0].as_py(), rows_of(t), root))

    level = 1
    while (n - 1) >> fan * level:
        asked = asked.groupBy("s", F.shiftright("b", fan * level).alias("g")).applyInArrow(step(False), MESSAGE)
        level += 1
    return asked.groupBy("s").applyInArrow(step(True), MESSAGE)


def finish(docs: DataFrame, told: DataFrame, last: Callable[[Bucket, list], pa.Table], schema: str) -> DataFrame:
    def one(key, t: pa.Table, m: pa.Table) -> pa.Table:
        return last(Bucket(t), rows_of(m))

    return docs.groupBy("b").cogroup(told.groupBy("b")).applyInArrow(one, schema)


# ---- a count-min sketch, sharded, of cells that count none, one, or more ------------------------------------

#: Cells of a row of a shard's sketch, as a power of two, and rows.
CELL_BITS, ROWS = 24, 2


def cell_keys(hashes: np.ndarray, shards: int, row: int) -> np.ndarray:
    """Shard and cell of each hash in a row of the sketch, in one number: shard above ``CELL_BITS`` bits of cell."""
    with np.errstate(over="ignore"):
        own = mix(hashes + U64(0x9E3779B97F4A7C15) * U64(row)) if row else hashes
    return ((hashes >> U64(34)) % U64(shards) << U64(CELL_BITS)) | (own & U64((1 << CELL_BITS) - 1))


def pack_cells(cells: np.ndarray, twice: np.ndarray) -> bytes:
    """Ascending cells: their low bytes as they are, the rest as a bit vector of steps; and a bit for each that counts two or more."""
    low = next(k for k in (1, 2, 3) if k == 3 or (1 << CELL_BITS) >> 8 * k <= 8 * len(cells))
    steps = np.zeros(len(cells) + (int(cells[-1]) >> 8 * low if len(cells) else 0), bool)
    steps[(cells >> 8 * low) + np.arange(len(cells))] = True
    head = np.array([len(cells), len(steps), low], np.uint32).tobytes()
    return b"".join((head, *((cells >> 8 * k).astype(np.uint8).tobytes() for k in range(low)), np.packbits(steps).tobytes(), np.packbits(twice).tobytes()))


def unpack_cells(body: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, size, low = np.frombuffer(body, np.uint32, 3).tolist()
    cells = np.zeros(n, np.int64)
    for k in range(low):
        cells |= np.frombuffer(body, np.uint8, n, 12 + k * n).astype(np.int64) << 8 * k
    at = 12 + low * n
    steps = np.unpackbits(np.frombuffer(body, np.uint8, -(-size // 8), at), count=size)
    cells |= (np.flatnonzero(steps) - np.arange(n)) << 8 * low
    return cells, np.unpackbits(np.frombuffer(body, np.uint8, offset=at + -(-size // 8)), count=n).astype(bool)


def _distinct(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ascending distinct keys and where each begins among the sorted."""
    keys = np.sort(keys)
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1]))) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.append(first, len(keys))


def _by_shard(keys: np.ndarray) -> tuple[np.ndarray, list[int]]:
    shard = (keys >> U64(CELL_BITS)).astype(np.int64)
    return shard, np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(keys)]


def sketch_messages(b: int, hashes: np.ndarray, shards: int) -> list:
    """A bucket's sketch, each row's cells to their shard; the row is the kind of the message."""
    out = []
    for row in range(ROWS):
        keys, edge = _distinct(cell_keys(hashes, shards, row))
        twice, cells = np.diff(edge) > 1, (keys & U64((1 << CELL_BITS) - 1)).astype(np.int64)
        shard, cut = _by_shard(keys)
        out += [(int(shard[x]), b, row, pack_cells(cells[x:y], twice[x:y])) for x, y in zip(cut, cut[1:])]
    return out


def merge_sketches(s: int, rows: list) -> list:
    """Add up the bucket sketches of a shard; tell each bucket which of its cells count two or more."""
    out = []
    for row in range(ROWS):
        lists = [(b, *unpack_cells(body)) for _, b, kind, body in rows if kind == row]
        if lists:
            every = np.sort(np.concatenate([np.concatenate((c, c[t])) for _, c, t in lists]))
            again = every[1:][every[1:] == every[:-1]]
            often = np.zeros(1 << CELL_BITS >> 3, np.uint8)  # a bit a cell
            np.bitwise_or.at(often, again >> 3, (1 << (again & 7)).astype(np.uint8))
            out += [(s, b, row, np.packbits(often[c >> 3] >> (c & 7).astype(np.uint8) & 1).tobytes()) for b, c, _ in lists]
    return out


def suspects(hashes: np.ndarray, shards: int, told: list) -> np.ndarray:
    """Of each of a bucket's hashes, whether every row of the sketch counts it two or more; told: the shards' replies."""
    out = np.ones(len(hashes), bool)
    for row in range(ROWS):
        own = cell_keys(hashes, shards, row)
        keys, _ = _distinct(own)
        often, shard = np.zeros(len(keys), bool), (keys >> U64(CELL_BITS)).astype(np.int64)
        for s, _, kind, body in told:
            if kind == row:
                a, b = np.searchsorted(shard, [s, s + 1])
                often[a:b] = np.unpackbits(np.frombuffer(body, np.uint8), count=b - a).astype(bool)
        live = np.flatnonzero(out)
        out[live] = often[np.searchsorted(keys, own[live])]
    return out
