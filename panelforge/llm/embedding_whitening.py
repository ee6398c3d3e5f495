"""Whitening of embeddings by spectral divide-and-conquer of their exact covariance.

Entries become whole numbers x = floor(1024 c) + 100000.  One pass sums the Gram matrix of (1, x - 100000) of every row
in exact integers: a batch splits its numbers into limbs of 20 bits whose products numpy adds without rounding, and the
partial sums climb a tree of groups of ``FAN`` partitions.  The driver gets one matrix for each length of vector, whose size
depends on that length alone.  n^2 times the covariance, n G - S S', equals the sum of products of the centred numbers
n x - S in exact integers, so nothing cancels, and each entry of the covariance is rounded once.

The covariance is taken apart by QDWH (Nakatsukasa and Higham, 2013): the orthogonal polar factor U of A - shift I, by
dynamically weighted Halley steps, gives the spectral projector (U + I) / 2 on the eigenvalues above the shift; bases of its
range and of the rest span invariant subspaces, and each is split again until one dimension is left.  Upper halves come first
and the work ends with the components asked for.  Components and means are broadcast (``components`` vectors a length) and a
second pass projects every row.

Defined cases: rows whose vector is null or holds null or non-finite entries are dropped.  Vectors of different length are
fitted apart, each length with its own n, sums and components; a vector without entries has no component and so no rows.
Entries beyond +-2^62 after scaling count as that bound.  A component whose eigenvalue is zero to double precision (constant
or repeated dimensions, a single row) has whitened null and takes no part in identity_error; explained is null where the trace
is zero.  deviation is null where it exceeds a long; ``deviation_wide`` (38 digits) holds it then.  Null ids, repeated rows and
extra columns make no difference.  Equal eigenvalues share a subspace, of which any orthonormal basis is right.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import written

SCALE, SHIFT, COMPONENTS = 1024.0, 100_000, 8
#: Bits of a limb, rows whose limb products a double holds exactly, bytes of a stored sum, partitions a group adds up.
LIMB, ROWS, WIDE, FAN = 20, 8_192, 24, 64
#: Rows of the Gram matrix in a message.
TILE = 64
EPS = np.finfo(float).eps


# ---- exact sums ------------------------------------------------------------------------------------------------


def scaled(x: np.ndarray) -> np.ndarray:
    """floor(1024 c) of doubles, without the shift, which no centred number feels."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x * SCALE), -(2.0**62), 2.0**62).astype(np.int64)


def exact_gram(y: np.ndarray) -> np.ndarray:
    """The matrix of sums of products of columns, in Python's integers."""
    total = np.zeros((y.shape[1], y.shape[1]), object)
    for a in range(0, len(y), ROWS):
        part = y[a : a + ROWS]
        limbs = []
        while np.abs(part).max(initial=0) >= 1 << LIMB:
            limbs.append((part & ((1 << LIMB) - 1)).astype(float))
            part = part >> LIMB
        limbs.append(part.astype(float))
        for i, p in enumerate(limbs):
            for j, q in enumerate(limbs):
                total += (p.T @ q).astype(np.int64).astype(object) * (1 << LIMB * (i + j))
    return total


def _packed(rows: np.ndarray) -> bytes:
    return b"".join([int(v).to_bytes(WIDE, "little", signed=True) for v in rows.ravel()])


def _unpacked(body: bytes) -> np.ndarray:
    return np.array([int.from_bytes(body[i : i + WIDE], "little", signed=True) for i in range(0, len(body), WIDE)], object)


_MESSAGE = "dim int, tile int, part int, body binary"


def _summed(key, t: pa.Table) -> pa.Table:
    total = sum(_unpacked(b) for b in t.column("body").to_pylist())
    return pa.table({"dim": pa.array([key[0].as_py()], pa.int32()), "tile": pa.array([key[1].as_py()], pa.int32()), "part": pa.array([key[2].as_py()], pa.int32()), "body": pa.array([_packed(total)], pa.binary())})


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1)


def _by_length(batch: pa.RecordBatch):
    """The rows of a batch for each length of vector: length, rows, scaled numbers."""
    dims = pc.list_value_length(batch.column("emb")).to_numpy(zero_copy_only=False)
    for dim in np.unique(dims[dims > 0]).tolist():
        part = batch.filter(pa.array(dims == dim)) if (dims != dim).any() else batch
        yield dim, part, scaled(_matrix(part.column("emb")))


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """For each length of vector: n, sums, Gram matrix, exact; of rows(emb array<double>)."""

    def gather(batches):
        from pyspark import TaskContext

        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for dim, _, y in _by_length(batch):
                for a in range(0, len(y), ROWS):
                    one = np.column_stack((np.ones(len(y[a : a + ROWS]), np.int64), y[a : a + ROWS]))
                    held[dim] = held.get(dim, 0) + exact_gram(one)
        part = TaskContext.get().partitionId()
        for dim, g in held.items():
            tiles = range(0, dim + 1, TILE)
            yield pa.RecordBatch.from_arrays([pa.array([dim] * len(tiles), pa.int32()), pa.array(range(len(tiles)), pa.int32()), pa.array([part] * len(tiles), pa.int32()), pa.array([_packed(g[i : i + TILE]) for i in tiles], pa.binary())], ["dim", "tile", "part", "body"])

    sums, parts = rows.select("emb").mapInArrow(gather, _MESSAGE), rows.rdd.getNumPartitions()
    while parts > 1:
        sums = sums.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy("dim", "tile", "part").applyInArrow(lambda key, t: _summed(key, t), _MESSAGE)
        parts = -(-parts // FAN)
    tiles: dict[int, dict[int, bytes]] = {}
    for r in sums.collect():  # one matrix for each length of vector
        tiles.setdefault(r["dim"], {})[r["tile"]] = bytes(r["body"])
    out = {}
    for dim, of in tiles.items():
        g = np.concatenate([_unpacked(of[t]) for t in sorted(of)]).reshape(dim + 1, dim + 1)
        out[dim] = int(g[0, 0]), g[0, 1:], g[1:, 1:]
    return out


# ---- QDWH ------------------------------------------------------------------------------------------------------


def polar(a: np.ndarray) -> np.ndarray:
    """The orthogonal polar factor of a symmetric matrix."""
    eye = np.eye(len(a))
    x = a / max(np.linalg.norm(a), np.finfo(float).tiny)
    low = EPS  # below the least singular value that can be told from zero
    for _ in range(20):
        if 1 - low < EPS * 4:
            break
        s = low * low
        d = (4 * (1 - s) / (s * s)) ** (1 / 3)
        root = np.sqrt(1 + d)
        wa = root + np.sqrt(8 - 4 * d + 8 * (2 - s) / (s * root)) / 2
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        if wc > 100:  # far from orthogonal: by QR, which is stable
            q, _ = np.linalg.qr(np.concatenate((np.sqrt(wc) * x, eye)))
            step = q[: len(a)] @ q[len(a) :].T * ((wa - wb / wc) / np.sqrt(wc))
        else:
            step = np.linalg.solve(eye + wc * (x.T @ x), x.T).T * (wa - wb / wc)
        x = wb / wc * x + step
        x = (x + x.T) / 2
        low = min(1.0, low * (wa + wb * s) / (1 + wc * s))
    return 1.5 * x - 0.5 * x @ (x.T @ x)


def split(a: np.ndarray, scale: float) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first k columns span the invariant subspace of the greater eigenvalues, and k; None where all eigenvalues are equal to double precision.  The mean of the eigenvalues lies strictly between the greatest and the least."""
    n = len(a)
    mean = np.trace(a) / n
    spread = np.linalg.norm(a - mean * np.eye(n))
    if spread <= 8 * EPS * scale:
        return None
    rng = np.random.default_rng(n)
    for shift in (float(np.median(np.diag(a))), mean, *(mean + spread / np.sqrt(n) * rng.uniform(-0.5, 0.5, 30))):
        p = (polar(a - shift * np.eye(n)) + np.eye(n)) / 2
        k = int(round(np.trace(p)))
        if not 0 < k < n:
            continue
        bases = []
        for project, size in ((p, k), (np.eye(n) - p, n - k)):
            q, _ = np.linalg.qr(project @ rng.standard_normal((n, size)))
            bases.append(np.linalg.qr(project @ q)[0])
        q, _ = np.linalg.qr(np.concatenate(bases, axis=1))
        if np.abs(q[:, :k].T @ a @ q[:, k:]).max() <= 64 * EPS * scale:
            return q, k
    return None  # a cluster that no shift can part: equal to double precision


def leading(a: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``most`` greatest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns."""
    scale = float(np.linalg.norm(a))
    todo, found = [np.eye(len(a))], []  # bases of invariant subspaces, the least eigenvalues first
    while todo and sum(v.shape[1] for v in found) < most:
        basis = todo.pop()
        part = basis.T @ a @ basis
        got = split((part + part.T) / 2, scale) if basis.shape[1] > 1 else None
        if got is None:
            found.append(basis)
        else:
            q, k = got
            todo += [basis @ q[:, k:], basis @ q[:, :k]]
    vectors = np.concatenate(found, axis=1)
    vectors, r = np.linalg.qr(vectors)
    vectors = vectors * np.where(np.diag(r) < 0, -1, 1)
    values = np.einsum("ij,ij->j", vectors, a @ vectors)
    order = np.argsort(-values, kind="stable")[:most]
    return values[order], vectors[:, order]


class Whitener:
    """Mean and scaled components of the vectors of one length."""

    def __init__(self, n: int, sums: np.ndarray, gram: np.ndarray, components: int):
        cov = ((n * gram - np.outer(sums, sums)) / (n * n)).astype(float)
        self.n, self.sums, self.trace = n, sums, float(np.trace(cov))
        self.values, self.vectors = leading(cov, min(components, len(cov)))
        self.live = self.values > len(cov) * EPS * max(float(np.abs(self.values).max(initial=0)), np.finfo(float).tiny)

    def centred(self, y: np.ndarray) -> np.ndarray:
        """n x - S, exact."""
        far = int(np.abs(y).max(initial=0)) * self.n + max((abs(int(s)) for s in self.sums), default=0)
        if far < 1 << 62:
            return y * self.n - self.sums.astype(np.int64)
        return y.astype(object) * self.n - self.sums

    def deviations(self, z: np.ndarray) -> list[int] | np.ndarray:
        """Sums of squares of each row, exact."""
        if z.dtype != object and int(np.abs(z).max(initial=0)) ** 2 * z.shape[1] < 1 << 63:
            return (z * z).sum(axis=1)
        return [sum(int(v) ** 2 for v in row) for row in z]

    def whitened(self, z: np.ndarray) -> np.ndarray:
        out = (z / self.n).astype(float) @ self.vectors
        return out / np.sqrt(np.where(self.live, self.values, 1))


def whiten(vectors: DataFrame, components: int = COMPONENTS, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(vec_id, dim, n, deviation, deviation_wide, whitened array<double>, explained array<double>, identity_error): a row for each remaining vector, with nulls in ``whitened`` for components of no variance."""
    emb = F.transform(F.col(vec_col), lambda v: v.cast("double"))
    fine = F.col("emb").isNotNull() & F.forall("emb", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), emb.alias("emb")).where(F.coalesce(fine, F.lit(False)))
    fitted = {dim: Whitener(n, s, g, components) for dim, (n, s, g) in moments(rows).items()}
    held = vectors.sparkSession.sparkContext.broadcast(fitted)  # ``components`` vectors for each length of vector

    def project(batches):
        for batch in batches:
            for dim, part, y in _by_length(batch):
                own = held.value[dim]
                z = own.centred(y)
                dev = own.deviations(z)
                if isinstance(dev, list):
                    short = pa.array([v if v < 1 << 63 else None for v in dev], pa.int64())
                    wide = pa.array([Decimal(v) if v < 10**38 else None for v in dev], pa.decimal128(38, 0))
                else:
                    short = pa.array(dev, pa.int64())
                    wide = short.cast(pa.decimal128(38, 0))
                w = own.whitened(z)
                flat = pa.array(w.ravel(), mask=np.broadcast_to(~own.live, w.shape).ravel())
                lists = pa.ListArray.from_arrays(np.arange(len(w) + 1, dtype=np.int32) * w.shape[1], flat)
                yield pa.RecordBatch.from_arrays([part.column("vec_id"), pa.array([dim] * len(w), pa.int32()), short, wide, lists], ["vec_id", "dim", "deviation", "deviation_wide", "whitened"])

    told = written(rows.mapInArrow(project, "vec_id long, dim int, deviation long, deviation_wide decimal(38,0), whitened array<double>"))
    w = lambda i: F.get("whitened", F.lit(i))
    means = told.groupBy("dim").agg(F.array(*(F.avg(w(i)) for i in range(components))).alias("m"))
    pairs = [(i, j) for i in range(components) for j in range(i, components)]
    off = told.join(F.broadcast(means), "dim").groupBy("dim").agg(*(F.abs(F.avg((w(i) - F.col("m")[i]) * (w(j) - F.col("m")[j])) - float(i == j)).alias(f"e{i}_{j}") for i, j in pairs))  # broadcasts of a row a length
    errors = off.select("dim", F.greatest(*(f"e{i}_{j}" for i, j in pairs), F.lit(None).cast("double")).alias("identity_error"))
    facts = [(dim, x.n, [float(v / x.trace) if x.trace else None for v in x.values]) for dim, x in fitted.items()]
    known = vectors.sparkSession.createDataFrame(facts, "dim int, n long, explained array<double>")
    return told.join(F.broadcast(known.join(errors, "dim")), "dim").select("vec_id", "dim", "n", "deviation", "deviation_wide", "whitened", "explained", "identity_error")


def by_component(whitened: DataFrame) -> DataFrame:
    """A row for each vector and component, numbered from 1."""
    each = whitened.select("*", F.posexplode(F.arrays_zip(F.col("whitened").alias("w"), F.col("explained").alias("x"))).alias("i", "own"))
    return each.select("vec_id", (F.col("i") + 1).cast("int").alias("component"), "n", "deviation", F.col("own.w").alias("whitened"), F.col("own.x").alias("explained"), "identity_error", "deviation_wide")
