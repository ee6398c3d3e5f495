"""Orthogonal features: principal components of standardised columns."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def standardised(df: DataFrame, names: list[str]) -> tuple[list[str], list[Column]]:
    """Names of the columns that vary, and their standard scores (divisor n) as expressions; nulls count as the mean."""
    at = df.agg(*(f(n).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("m", F.avg), ("s", F.stddev_pop)))).first()
    live = [i for i in range(len(names)) if at[f"s{i}"] and at[f"s{i}"] > 0]
    return [names[i] for i in live], [F.coalesce((F.col(names[i]) - at[f"m{i}"]) / at[f"s{i}"], F.lit(0.0)) for i in live]


def gram(df: DataFrame, names: list[str]) -> DataFrame:
    """(a, b, dot): sums of products of standard scores for each pair of columns that vary, a <= b in their order; partial sums are combined before the shuffle."""
    live, z = standardised(df, names)
    pairs = [(i, j) for i in range(len(live)) for j in range(i, len(live))]
    if not pairs:
        return df.sparkSession.createDataFrame([], "a string, b string, dot double")
    sums = df.agg(*(F.coalesce(F.sum(z[i] * z[j]), F.lit(0.0)).alias(f"g{k}") for k, (i, j) in enumerate(pairs)))
    entries = F.array(*(F.struct(F.lit(live[i]).alias("a"), F.lit(live[j]).alias("b"), F.col(f"g{k}").alias("dot")) for k, (i, j) in enumerate(pairs)))
    return sums.select(F.explode(entries).alias("e")).select("e.*")


def orthogonalize_features(df: DataFrame, names: list[str], keep: list[str], share: float = 0.95) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(keep, PC_1, PC_2, ...), (feature, component, loading) and (component, value): as many components as hold ``share`` of the variance.

    The Gram matrix of the columns (their number squared) is all that the driver sees; the projection is column expressions.  A loading's
    sign is that of its greatest entry in the order of columns.
    """
    live, z = standardised(df, names)
    at = {n: i for i, n in enumerate(live)}
    g = np.zeros((len(live), len(live)))
    for r in gram(df, names).collect():
        g[at[r["a"]], at[r["b"]]] = g[at[r["b"]], at[r["a"]]] = r["dot"]
    value, vector = np.linalg.eigh(g) if live else (np.zeros(0), np.zeros((0, 0)))
    value, vector = value[::-1], vector[:, ::-1]
    n = min(len(value), int(np.searchsorted(np.cumsum(value) / value.sum(), share)) + 1) if len(value) else 0
    vector = vector[:, :n] * np.sign(vector[np.abs(vector[:, :n]).argmax(axis=0), np.arange(n)]) if n else vector[:, :0]
    spark = df.sparkSession
    columns = [sum((z[i] * float(vector[i, k]) for i in range(len(live))), F.lit(0.0)).alias(f"PC_{k + 1}") for k in range(n)]
    loads = [(live[i], f"PC_{k + 1}", float(vector[i, k])) for i in range(len(live)) for k in range(n)]
    return df.select(*keep, *columns), spark.createDataFrame(loads, "feature string, component string, loading double"), spark.createDataFrame([(f"PC_{k + 1}", float(value[k])) for k in range(n)], "component string, value double")
