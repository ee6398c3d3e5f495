"""Splits of labelled events (event_id, event_start, t1) in time: purged, combinatorial and walking forward.

Positions come from ``plans.ordering`` (no single task over all rows); spans of groups are k or N rows and are all that is
broadcast.  A split table has one row for each split and event, which is the result itself.
"""

from __future__ import annotations

from itertools import combinations
from math import comb

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.ordering import position


def _placed(labels: DataFrame) -> DataFrame:
    n = labels.agg(F.count(F.lit(1)).alias("n"))
    return position(labels, "event_start", ["event_id"]).join(F.broadcast(n))


def purged_folds(labels: DataFrame, k: int = 5, embargo: float = 0.0) -> DataFrame:
    """(fold, event_id, part): test rows of k equal chunks in time order and the train rows whose spans do not touch them.

    A row is train on the left if it ends before the chunk begins and on the right if it starts after the chunk's last end,
    less the embargo.
    """
    base = _placed(labels)
    small, extra = F.floor(F.col("n") / k), F.col("n") % k
    cut = (small + 1) * extra
    base = base.withColumn("fold", F.when(F.col("i") < cut, F.floor(F.col("i") / (small + 1))).otherwise(extra + F.floor((F.col("i") - cut) / F.greatest(small, F.lit(1)))).cast("int"))
    span = base.groupBy(F.col("fold").alias("f")).agg(F.min("event_start").alias("lo"), F.max("t1").alias("hi"), F.max("n").alias("_n"))
    starts = base.groupBy(F.col("event_start").alias("_s")).agg(F.count(F.lit(1)).alias("_k"))
    first = starts.join(F.broadcast(span), F.col("_s") <= F.col("hi")).groupBy("f", "lo", "hi", "_n").agg(F.sum("_k").alias("right"))
    part = F.when(F.col("fold") == F.col("f"), "test").when((F.col("t1") < F.col("lo")) | (F.col("i") >= F.col("right") + F.floor(F.col("_n") * embargo)), "train")
    return base.join(F.broadcast(first)).select(F.col("f").alias("fold"), "event_id", part.alias("part")).where("part is not null")


def _edge(g: int, groups: int) -> Column:
    return F.col("n") if g == groups else F.floor(F.lit(float(g)) * (F.col("n") / groups))


def combinatorial_folds(labels: DataFrame, groups: int = 6, tested: int = 2, embargo: float = 0.0) -> DataFrame:
    """(split, event_id, grp, part, path): every choice of ``tested`` of ``groups`` time groups is one split.

    Train rows touch no tested group's window (closed at both ends) and do not stand in the embargo behind one.  ``path``
    numbers a test row's splits, so that each path holds every event once.
    """
    if not 1 <= tested <= groups // 2:
        raise ValueError("tested must be from 1 to half the groups")
    base = _placed(labels)
    grp = sum((F.when(F.col("i") >= _edge(g, groups), 1).otherwise(0) for g in range(1, groups)), F.lit(0))
    base = base.withColumn("grp", grp)
    span = base.groupBy("grp").agg(F.min("event_start").alias("lo"), F.max("t1").alias("hi"))
    spans = span.agg(F.map_from_entries(F.collect_list(F.struct("grp", F.struct("lo", "hi")))).alias("spans"))
    width = F.floor(F.col("n") * embargo)
    near = []
    for g in range(groups):
        s = F.try_element_at("spans", F.lit(g))
        touches = (F.col("event_start") <= s["hi"]) & (F.col("t1") >= s["lo"])
        behind = (F.col("i") >= _edge(g + 1, groups)) & (F.col("i") < _edge(g + 1, groups) + width)
        near.append(F.coalesce(touches | behind, F.lit(False)))
    marked = base.join(F.broadcast(spans)).select("event_id", "grp", F.array(*near).alias("near"))
    picks = F.array(*(F.struct(F.lit(s).alias("split"), F.array(*map(F.lit, c)).alias("groups")) for s, c in enumerate(combinations(range(groups), tested))))
    each = marked.select("event_id", "grp", "near", F.explode(picks).alias("p")).select("event_id", "grp", "near", "p.split", "p.groups")
    part = F.when(F.array_contains("groups", F.col("grp")), "test").when(~F.exists("groups", lambda g: F.element_at("near", g + 1)), "train")
    kept = each.select("split", "event_id", "grp", part.alias("part")).where("part is not null")
    path = F.when(F.col("part") == "test", F.row_number().over(W.partitionBy("event_id", "part").orderBy("split")) - 1)
    return kept.withColumn("path", path)


def path_count(groups: int, tested: int) -> int:
    return tested * comb(groups, groups - tested) // groups


def assemble_paths(predictions: DataFrame, groups: int, tested: int) -> DataFrame:
    """Predictions of test rows (event_id, path, ...) where every path has every event; raises where one is not whole."""
    counts = predictions.groupBy("path").agg(F.count_distinct("event_id").alias("n"))
    got = counts.agg(F.count(F.lit(1)).alias("paths"), F.min("n").alias("lo"), F.max("n").alias("hi")).first()
    if got["paths"] != path_count(groups, tested) or got["lo"] != got["hi"]:
        raise ValueError(f"incomplete paths: {got.asDict()}")
    return predictions


def walk_forward(labels: DataFrame, splits: int = 5, embargo: int = 0) -> DataFrame:
    """(split, event_id, part): the i-th of equal blocks is tested by all earlier ones, less the embargo's rows before it."""
    base = _placed(labels)
    which = F.array(*(F.struct(F.lit(s).alias("split"), _edge(s, splits).alias("lo"), _edge(s + 1, splits).alias("hi")) for s in range(1, splits)))
    each = base.select("event_id", "i", F.explode(which).alias("p")).select("event_id", "i", "p.*").where((F.col("lo") - embargo > 0) & (F.col("hi") > F.col("lo")))
    part = F.when(F.col("i") < F.col("lo") - embargo, "train").when((F.col("i") >= F.col("lo")) & (F.col("i") < F.col("hi")), "test")
    return each.select("split", "event_id", part.alias("part")).where("part is not null")
