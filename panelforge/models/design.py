"""Design tables: each labelled sample once, with the splits that train and test on it.

A design has a row for each sample (event_id, x array<double>, y int, weight, train array<int>, test array<int>): splits are
arrays on the row, so a sample is stored and read once however many folds and trials are fitted.  Rows with a null feature, label
or weight take no part.  Designs are written to the shared checkpoint folder, as fits read them in rounds.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.ordering import position
from ..session import written


@dataclass(frozen=True)
class Trial:
    """Columns of x that a model sees, and its parameters."""

    columns: tuple[int, ...]
    params: dict = field(default_factory=dict)


@dataclass
class Design:
    rows: DataFrame
    names: list[str]
    classes: list[int]
    folds: list[int]

    def trial(self, **params) -> Trial:
        return Trial(tuple(range(len(self.names))), params)


def design(samples: DataFrame, names: list[str], splits: DataFrame, label: str = "y", weight: str | None = None, keep: list[str] = ()) -> Design:
    """samples: (event_id, names, label, weight); splits: (fold or split, event_id, part).  ``keep``: further columns of the rows."""
    fold = F.col("fold" if "fold" in splits.columns else "split")
    of = lambda part: F.array_sort(F.collect_set(F.when(F.col("part") == part, fold.cast("int"))))
    member = splits.groupBy("event_id").agg(of("train").alias("train"), of("test").alias("test"))  # at most the number of splits a row
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    base = samples.select("event_id", F.array(*(F.col(n).cast("double") for n in names)).alias("x"), F.col(label).cast("int").alias("y"), w.alias("weight"), *keep)
    fine = F.forall("x", lambda v: v.isNotNull() & ~F.isnan(v)) & F.col("y").isNotNull() & F.col("weight").isNotNull()
    rows = written(base.where(fine).join(member, "event_id"))
    found = rows.agg(F.collect_set("y").alias("y"), F.array_distinct(F.flatten(F.collect_set("test"))).alias("f")).first()  # classes and splits are few
    return Design(rows, list(names), sorted(found["y"]), sorted(found["f"]))


def _ordered(rows: DataFrame, salt: str, name: str) -> DataFrame:
    """Numbers the rows fold by fold in the order of a salted digest of their id."""
    digest = F.md5(F.concat(F.lit(f"{salt}|"), F.col("event_id")).cast("binary"))
    coarse = F.element_at("test", 1) * 4096 + F.conv(F.substring(digest, 1, 3), 16, 10).cast("int")
    return position(rows.withColumn("_digest", digest).withColumn("_coarse", coarse), "_coarse", ["_digest", "event_id"], name).drop("_digest", "_coarse")


def with_partner(rows: DataFrame, seed: int) -> DataFrame:
    """Adds ``other``: the features of another row of the same test fold, by a permutation of the fold.  Nothing is gathered: the row at place i of one order meets the row at place i of another."""
    tested = rows.where(F.size("test") > 0)
    left = _ordered(tested, "rows", "_place")
    right = _ordered(tested.select("event_id", "test", "x"), f"seed {seed}", "_place").select("_place", F.col("x").alias("other"))
    return left.join(right, "_place").drop("_place")


def poisson_bags(rate: float, trees: int, seed: int = 0) -> Column:
    """How often each of ``trees`` bags holds a row: Poisson numbers of a mean of ``rate``, by a hash of id, bag and seed."""
    import math

    steps, p, total = [], math.exp(-rate), 0.0
    for k in range(64):
        total += p
        p *= rate / (k + 1)
        steps.append(total)
        if 1 - total < 1e-12:
            break
    u = lambda t: F.pmod(F.xxhash64(F.col("event_id"), t, F.lit(seed)), F.lit(1 << 40)) / float(1 << 40)
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.aggregate(F.array(*map(F.lit, steps)), F.lit(0), lambda n, edge: n + F.when(u(t) >= edge, 1).otherwise(0)))
