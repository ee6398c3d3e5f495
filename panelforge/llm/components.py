"""Connected components of an edge table, and of one task's edges.

The table form alternates large and small stars (Kiveris et al., 2014) until nothing changes: each round is two
aggregations with partial sums and two joins whose hot keys adaptive execution can split.  Rounds are written to the
shared checkpoint folder, so a lost executor costs no earlier round and the plan stays short.  Stages of a round have as many
tasks as its edges ask for, since every task leaves files for each shuffle, and these stay through all rounds.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_dir

#: Edges that make a task of a round.
TASK_EDGES = 1 << 16


def written(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def local_labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least vertex of each vertex's component among edges (a, b) of vertices 0 .. n-1."""
    label = np.arange(n)
    while len(a):
        la, lb = label[a], label[b]
        go = la != lb
        a, b, la, lb = a[go], b[go], la[go], lb[go]
        if not len(a):
            break
        np.minimum.at(label, np.maximum(la, lb), np.minimum(la, lb))
        while True:
            jump = label[label]
            if np.array_equal(jump, label):
                break
            label = jump
    return label


def _star(edges: DataFrame, large: bool, tasks: int) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))) if large else edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    joined = both.join(least, "u").coalesce(tasks)
    if large:
        out = joined.where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    else:
        out = joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")).coalesce(tasks))
    return out.where("u <> v").distinct().coalesce(tasks)


def components(edges: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """(vertex, component): the smallest vertex reachable, for vertices of at least one edge."""
    now = written(edges.select(F.col(u).alias("u"), F.col(v).alias("v")).where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())

    def state(df: DataFrame):
        return tuple(df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    seen, tasks = state(now), 1
    while seen[0]:
        tasks = -(-seen[0] // TASK_EDGES)
        now = written(_star(_star(now.coalesce(tasks), True, tasks), False, tasks))
        got = state(now)
        if got == seen:
            break
        seen = got
    roots = now.select(F.col("v").alias("vertex"), F.col("v").alias("component"))
    return now.select(F.col("u").alias("vertex"), F.col("v").alias("component")).union(roots.distinct().coalesce(tasks))
