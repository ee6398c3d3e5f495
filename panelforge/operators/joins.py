"""As-of and interval operators without nested loops."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans import sessions


def as_of(left: DataFrame, right: DataFrame, key: str, left_time: str, right_time: str, values: list[str], skip_null: bool = True) -> DataFrame:
    """For each row of ``left`` the latest values of ``right`` at or before its time.

    A union of both sides and one window per key: a single shuffle on the key, no join and no row multiplication.  With
    ``skip_null`` each value falls through to the last that is not null.
    """
    sides = left.withColumn("_t", F.col(left_time)).withColumn("_side", F.lit(1))
    for v in values:
        sides = sides.withColumn(v, F.lit(None).cast(dict(right.dtypes)[v]))
    facts = right.select(F.col(key), F.col(right_time).alias("_t"), F.lit(0).alias("_side"), *values, *(F.lit(None).cast(t).alias(c) for c, t in left.dtypes if c != key))
    w = W.partitionBy(key).orderBy("_t", "_side").rowsBetween(W.unboundedPreceding, 0)
    both = sides.unionByName(facts)
    if skip_null:
        filled = [F.last(v, ignorenulls=True).over(w).alias(v) for v in values]
    else:
        row = F.last(F.when(F.col("_side") == 0, F.struct(*values)), ignorenulls=True).over(w)
        filled = [row[v].alias(v) for v in values]
    return both.select(*left.columns, "_side", *filled).where("_side = 1").drop("_side")


def latest(facts: DataFrame, keys: list[str], order: list, value: str) -> DataFrame:
    """The first non-null value of each group in a stated order."""
    w = W.partitionBy(*keys).orderBy(*order).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    return facts.select(*keys, F.first(value, ignorenulls=True).over(w).alias(value)).distinct()


def valid_at(intervals: DataFrame, when, start: str, end: str) -> DataFrame:
    """Rows of half-open intervals that hold at a time; an absent end is open."""
    return intervals.where((F.col(start) <= when) & (F.col(end).isNull() | (F.col(end) > when)))


def keep_last(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row a key: the last in a stated order."""
    return df.withColumn("_n", F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where("_n = 1").drop("_n")


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def sessions_after(events: DataFrame, calendar: DataFrame, date: str, n: int, out: str) -> DataFrame:
    """The n-th session after a date; a date that is no session first moves to the next one, which counts as the first step."""
    return sessions.step(events, calendar, date, n, out)
