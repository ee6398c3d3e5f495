"""Near-duplicate embeddings by product quantisation with an exact cosine rerank.

The index: coarse lists (k-means over unit vectors) and residual codes of subspaces, fitted on a bounded sample
(``sample`` distinct vectors, those of the least hash), filled with every vector.  Lists are the root of the number of
vectors, as far as the sample has ``PER_CENTRE`` vectors for each; beyond that lists grow, in blocks.  A query visits each list whose
cell comes close enough to hold a link.  A linked vector lies within distance t; the part of its step along the line to
another centre is t in the worst case, but in d dimensions it has a standard deviation of t / sqrt(d) for steps of no
preferred direction, so lists count within ``SIGMAS`` of these (all of t up to 16 dimensions, where no link can be
missed).  A list's queries are dealt by list as well as by label, so a member meets only those that probe its list.
Inside a list, table-lookup distances less the code's own error are a lower bound of the true distance, so the shortlist
loses no link; exact cosines in double precision decide.  Recall against brute force is measured in the tests.

Equal vectors are one entry with a multiplicity.  Lists are cut into blocks of members and of queries, so that a
group holds a bounded number of both, and a group emits a spanning forest of its links.

Defined cases: a vector that is null, zero, or has null or non-finite components, or a null label, links with
nothing and is its own component.  Vectors of different length never link.  Repeated rows link with each other.  A
null vec_id takes part but names no component; its row gets the component of what it links with.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, local_labels, written

COSINE = 0.93
SAMPLE, BLOCK, PER_CENTRE = 65_536, 8_192, 8
#: Standard deviations of a linked vector's step towards another centre that a probe allows for.
SIGMAS = 4.0


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 0) -> np.ndarray:
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), min(k, len(x)), replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(-2 * x[i : i + 4096] @ c.T + (c * c).sum(1)).argmin(1) for i in range(0, len(x), 4096)])
        n = np.bincount(near, minlength=len(c))
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        c = np.where(n[:, None] > 0, total / np.maximum(n, 1)[:, None], c)
    return c


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Index:
    """Coarse centres and a codebook for each subspace, for vectors of one length."""

    def __init__(self, sample: np.ndarray, lists: int, seed: int = 0):
        x = unit(sample.astype(np.float64))
        self.centres = _kmeans(x, lists, seed=seed)
        own = self.assign(x)[0]
        rest = x - self.centres[own]
        d = x.shape[1]
        self.parts = np.array_split(np.arange(d), min(16, d))
        self.books = [_kmeans(rest[:, p], 256, seed=seed + 1 + i) for i, p in enumerate(self.parts)]

    def assign(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        far = np.maximum((x * x).sum(1)[:, None] - 2 * x @ self.centres.T + (self.centres**2).sum(1), 0)
        return far.argmin(1), far

    def encode(self, x: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rest = x - self.centres[own]
        codes = np.empty((len(x), len(self.parts)), np.uint8)
        error = np.zeros(len(x))
        for i, (p, book) in enumerate(zip(self.parts, self.books)):
            far = -2 * rest[:, p] @ book.T + (book * book).sum(1)
            codes[:, i] = far.argmin(1)
            error += ((rest[:, p] - book[codes[:, i]]) ** 2).sum(1)
        return codes, np.sqrt(error)

    def probes(self, own: np.ndarray, far: np.ndarray, reach: float) -> list[np.ndarray]:
        """Lists whose cell comes within ``reach`` of each query: a bisecting plane lies (far - nearest) / (2 * distance of the centres) away."""
        norm = (self.centres**2).sum(1)
        out = []
        step = max(1, (1 << 22) // len(self.centres))
        for i in range(0, len(own), step):
            mine = own[i : i + step]
            apart = np.sqrt(np.maximum(norm[mine][:, None] - 2 * self.centres[mine] @ self.centres.T + norm, 0))
            lead = far[i : i + step] - far[np.arange(i, i + len(mine)), mine][:, None]
            row, which = np.nonzero(lead <= 2 * apart * reach + 1e-6)
            out += np.split(which.astype(np.int32), np.searchsorted(row, np.arange(1, len(mine))))
        return out

    def distances(self, x: np.ndarray, which: int, codes: np.ndarray) -> np.ndarray:
        """Asymmetric distances of queries to the coded members of one list."""
        rest = x - self.centres[which]
        out = np.zeros((len(x), len(codes)), np.float32)
        for i, (p, book) in enumerate(zip(self.parts, self.books)):
            q = rest[:, p]
            lut = ((q * q).sum(1)[:, None] - 2 * q @ book.T + (book * book).sum(1)).astype(np.float32)
            out += np.take(lut, codes[:, i], axis=1)
        return np.sqrt(np.maximum(out, 0))


def _vectors(column) -> np.ndarray:
    col = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def _search(table: pa.Table, index: Index, which: int, cosine: float) -> pa.Table:
    """Links between the queries and the members of one block: partial link counts and a forest."""
    side = table.column("side").to_numpy()
    q, m = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
    vid, copies = table.column("vid").to_numpy(), table.column("copies").to_numpy()
    raw = _vectors(table.column("emb")).astype(np.float64)
    x = unit(raw)
    codes = np.frombuffer(b"".join(table.column("codes").to_pylist()), np.uint8).reshape(len(side), -1)
    error = table.column("error").to_numpy()
    reach = np.sqrt(2 - 2 * cosine) + 1e-4
    names, at = np.unique(vid, return_inverse=True)
    weight = np.zeros(len(names), np.int64)
    weight[at] = copies
    count = np.zeros(len(names), np.int64)
    label, a, b, held = np.arange(len(names)), [], [], 0
    step = max(1, (1 << 21) // max(1, len(m)))
    for s in range(0, len(q), step):
        part = q[s : s + step]
        i, j = np.nonzero(index.distances(x[part], which, codes[m]) - error[m][None, :] <= reach)
        i, j = part[i], m[j]
        exact = np.concatenate([(x[i[k : k + 65536]] * x[j[k : k + 65536]]).sum(1) for k in range(0, len(i), 65536)]) if len(i) else np.zeros(0)
        keep = (exact >= cosine) & (vid[i] != vid[j])
        i, j = at[i[keep]], at[j[keep]]
        np.add.at(count, i, weight[j])
        a.append(i)
        b.append(j)
        held += len(i)
        if held > 1 << 21:
            label = local_labels(len(names), np.concatenate((np.arange(len(names)), *a)), np.concatenate((label, *b)))
            a, b, held = [], [], 0
    label = local_labels(len(names), np.concatenate((np.arange(len(names)), *a)), np.concatenate((label, *b)))
    hit = np.flatnonzero((count > 0) | (label != np.arange(len(names))))
    return pa.table({"u": pa.array(names[hit], pa.int64()), "v": pa.array(names[label[hit]], pa.int64()), "links": pa.array(count[hit], pa.int64())})


def near_duplicates(vectors: DataFrame, cosine: float = COSINE, sample: int = SAMPLE, lists: int | None = None, block: int = BLOCK, id_col: str = "vec_id", vec_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row.  lists: coarse lists, the root of the number of distinct vectors unless given."""
    emb = F.transform(F.col(vec_col), lambda v: v.cast("double") + F.lit(0.0))
    fine = F.col("label").isNotNull() & F.col("emb").isNotNull() & F.forall("emb", lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))) & F.exists("emb", lambda v: v != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(label_col).alias("label"), emb.alias("emb")).withColumn("fine", F.coalesce(fine, F.lit(False)))
    for name, seed in (("h1", 1), ("h2", 2)):  # 128 bits stand for a vector and its label
        rows = rows.withColumn(name, F.when(F.col("fine"), F.xxhash64(F.lit(seed), "label", "emb")))
    merged = rows.where("fine").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("copies"), F.first("label").alias("label"), F.first("emb").alias("emb"))
    distinct = written(merged.withColumn("dim", F.size("emb")).withColumn("vid", F.monotonically_increasing_id()))  # numbered once: the table is read back
    spark = vectors.sparkSession
    total = {r["dim"]: r["n"] for r in distinct.groupBy("dim").agg(F.count("*").alias("n")).orderBy(F.desc("n")).collect()}  # a row for each length of vector
    indexes = {}
    for dim, n in total.items():
        got = distinct.where(F.col("dim") == dim).orderBy("h1", "h2").select("emb").limit(sample).toArrow()
        indexes[dim] = Index(_vectors(got.column("emb")), lists or max(1, min(round(n**0.5), sample // PER_CENTRE)))
    held = spark.sparkContext.broadcast(indexes)  # bounded: at most sample / PER_CENTRE centres and 16 x 256 codes for each length
    reach = float(np.sqrt(2 - 2 * cosine))

    def encode(batches):
        for batch in batches:
            dims = batch.column("dim").to_numpy()
            for dim in np.unique(dims).tolist():
                part = batch.filter(pa.array(dims == dim))
                index = held.value[dim]
                x = unit(_vectors(part.column("emb")).astype(np.float64))
                own, far = index.assign(x)
                codes, error = index.encode(x, own)
                probe = index.probes(own, far, reach * min(1.0, SIGMAS / dim**0.5))
                yield pa.RecordBatch.from_arrays([part.column("vid"), part.column("copies"), part.column("label"), part.column("dim"), part.column("emb"), pa.array(own.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), pa.array(probe, pa.list_(pa.int32()))], ["vid", "copies", "label", "dim", "emb", "list", "codes", "error", "probes"])

    kind = dict(distinct.dtypes)["label"]
    coded = written(distinct.select("vid", "copies", "label", "dim", "emb").mapInArrow(encode, f"vid long, copies long, label {kind}, dim int, emb array<double>, list int, codes binary, error double, probes array<int>"))
    cell = ["label", "dim", "list"]
    blocks = lambda c: F.ceil(F.count("*") / block).cast("int").alias(c)
    salt = lambda n: F.pmod(F.xxhash64("vid"), F.col(n)).cast("int")
    asked = coded.withColumn("list", F.explode("probes"))
    # blocks of members and of queries of each cell; a cell without members is asked by nobody
    cells = written(coded.groupBy(*cell).agg(blocks("nm")).join(asked.groupBy(*cell).agg(blocks("nq")), cell))
    cols = [*cell, "mb", "qb", "side", "vid", "copies", "emb", "codes", "error"]
    members = coded.join(cells, cell).withColumn("mb", salt("nm")).withColumn("qb", F.explode(F.sequence(F.lit(0), F.col("nq") - 1))).withColumn("side", F.lit(1)).select(*cols)
    queries = asked.join(cells, cell).withColumn("qb", salt("nq")).withColumn("mb", F.explode(F.sequence(F.lit(0), F.col("nm") - 1))).withColumn("side", F.lit(0)).select(*cols)
    found = written(members.union(queries).groupBy(*cell, "mb", "qb").applyInArrow(lambda key, t: _search(t, held.value[key[1].as_py()], key[2].as_py(), cosine), "u long, v long, links long"))
    comp = components(found.select("u", "v"))
    links = found.groupBy("u").agg(F.sum("links").alias("links")).withColumnRenamed("u", "vid")
    roots = distinct.select("h1", "h2", "vid", "rep", "copies").join(comp, F.col("vid") == F.col("vertex"), "left").withColumn("root", F.coalesce("component", "vid"))
    named = roots.join(roots.groupBy("root").agg(F.min("rep").alias("least")), "root").join(links, "vid", "left").select("h1", "h2", "least", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n"))
    out = rows.select("vec_id", "h1", "h2").join(named, ["h1", "h2"], "left")
    return out.select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("least", "vec_id").alias("component_id")).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))
