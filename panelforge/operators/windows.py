"""Guarded window operators on long panels.  Every function maps columns to a column, so that one select computes many in one pass over one sort."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def by_symbol():
    return W.partitionBy("symbol").orderBy("date")


def rows(w: int, ago: int = 0):
    """A frame of ``w`` rows that ends ``ago`` rows before the current one."""
    return by_symbol().rowsBetween(-(w - 1) - ago, -ago)


def full(value: Column, x: Column, w: int, ago: int = 0, least: int | None = None) -> Column:
    """A rolling value where at least ``least`` (all, by default) of the frame's values are there."""
    return F.when(F.count(x).over(rows(w, ago)) >= (least or w), value)


def lag(x: Column, n: int = 1) -> Column:
    return F.lag(x, n).over(by_symbol())


def log_return(x: Column, n: int = 1) -> Column:
    safe = F.when(x > 0, F.ln(x))
    return safe - lag(safe, n)


def mean(x: Column, w: int, ago: int = 0, least: int | None = None) -> Column:
    return full(F.avg(x).over(rows(w, ago)), x, w, ago, least)


def std(x: Column, w: int) -> Column:
    return full(F.stddev_samp(x).over(rows(w)), x, w)


def highest(x: Column, w: int) -> Column:
    return full(F.max(x).over(rows(w)), x, w)


def median(x: Column, w: int, least: int | None = None) -> Column:
    return full(F.percentile(x, 0.5).over(rows(w)), x, w, 0, least)


def forward_fill(x: Column) -> Column:
    return F.last(x, ignorenulls=True).over(by_symbol().rowsBetween(W.unboundedPreceding, 0))


def distance_to_high(close: Column, w: int = 60) -> Column:
    high = highest(close, w)
    return close / F.nullif(high, F.lit(0.0)) - 1



def stage(close: Column, average: Column, back: int = 20) -> Column:
    """2 above a rising average, 3 above one that does not rise, 4 below one that does not rise, 1 below a rising one; null where a part is absent."""
    old = lag(average, back)
    above, rising = close > average, average > old
    value = F.when(above & rising, 2).when(above & ~rising, 3).when(~above & ~rising, 4).otherwise(1)
    return F.when(average.isNotNull() & old.isNotNull() & close.isNotNull(), value)


def with_stage(panel, w: int = 200, back: int = 20):
    """Adds ``stage``: 2 above a rising average, 3 above one that does not rise, 4 below one that does not rise, 1 below a rising one."""
    ma = panel.withColumn("_ma", mean(F.col("close"), w)).withColumn("_old", F.lag("_ma", back).over(by_symbol()))
    above, rising = F.col("close") > F.col("_ma"), F.col("_ma") > F.col("_old")
    value = F.when(above & rising, 2).when(above & ~rising, 3).when(~above & ~rising, 4).otherwise(1)
    return ma.withColumn("stage", F.when(F.col("_ma").isNotNull() & F.col("_old").isNotNull() & F.col("close").isNotNull(), value)).drop("_ma", "_old")


def smooth_momentum(close: Column, seq: Column, w: int = 60) -> Column:
    """Annualised slope of log prices times the share of variance explained; a flat window is 0."""
    y = F.when(close > 0, F.ln(close))
    slope, r2 = F.regr_slope(y, seq).over(rows(w)), F.regr_r2(y, seq).over(rows(w))
    flat = F.max(y).over(rows(w)) == F.min(y).over(rows(w))
    return full(F.when(flat, 0.0).otherwise((F.exp(252 * slope) - 1) * F.greatest(r2, F.lit(0.0))), y, w)


def smooth_fit(close: Column, seq: Column, w: int = 60) -> Column:
    """The share of variance that a line through log prices explains; a flat window is 0."""
    y = F.when(close > 0, F.ln(close))
    flat = F.max(y).over(rows(w)) == F.min(y).over(rows(w))
    return full(F.when(flat, 0.0).otherwise(F.greatest(F.regr_r2(y, seq).over(rows(w)), F.lit(0.0))), y, w)


def rolling_rank(x: Column, w: int = 252) -> Column:
    """The share of the frame's values that are at most the current one; null below max(20, w / 5) values."""
    past = F.collect_list(x).over(rows(w))
    share = F.size(F.filter(past, lambda v: v <= x)) / F.size(past)
    return F.when(x.isNotNull() & (F.size(past) >= max(20, w // 5)), share)


def swing(x: Column, side: int, high: bool) -> Column:
    """The pivot ``side`` rows ago where it is the extreme of its 2 side + 1 rows; known only now."""
    frame = rows(2 * side + 1)
    edge = F.max(x).over(frame) if high else F.min(x).over(frame)
    mid = F.lag(x, side).over(by_symbol())
    return F.when((F.count(F.lit(1)).over(frame) == 2 * side + 1) & (mid == edge), mid)


def strict_pivot(x: Column, side: int, high: bool) -> Column:
    """The value ``side`` rows ago where it is beyond all ``side`` rows on either side of it; known only now."""
    mid, best = lag(x, side), F.max if high else F.min
    before, after = best(x).over(rows(side, side + 1)), best(x).over(rows(side))
    beyond = (mid > before) & (mid > after) if high else (mid < before) & (mid < after)
    return F.when(beyond & (F.count(F.lit(1)).over(rows(2 * side + 1)) == 2 * side + 1), mid)


def true_range(high: Column, low: Column, close: Column) -> Column:
    before = lag(close)
    return F.when(before.isNotNull() & high.isNotNull() & low.isNotNull(), F.greatest(F.abs(high - low), F.abs(high - before), F.abs(low - before)))


def rank_first(score: Column, by, descending: bool = True) -> Column:
    """Rank within a date; ties go to the first symbol, nulls have none."""
    order = score.desc_nulls_last() if descending else score.asc_nulls_last()
    return F.when(score.isNotNull(), F.row_number().over(W.partitionBy(*by).orderBy(order, F.col("symbol"))))


def rank_pct(x: Column, by) -> Column:
    """Percentile rank with ties at their mean."""
    w = W.partitionBy(*by)
    ties = F.count(x).over(W.partitionBy(*by, x))
    return F.when(x.isNotNull(), (F.rank().over(w.orderBy(x.asc_nulls_last())) + (ties - 1) / 2) / F.count(x).over(w))


def run_number(x: Column):
    """The number of the current row within its run of equal signs, through the difference of two row numbers."""
    return F.row_number().over(by_symbol()) - F.row_number().over(W.partitionBy("symbol", x).orderBy("date"))


def fractional_weights(d: float, threshold: float = 1e-5) -> list[float]:
    """Weights of (1 - L)^d until they fall below the threshold."""
    out = [1.0]
    while True:
        w = -out[-1] * (d - len(out) + 1) / len(out)
        if abs(w) < threshold:
            return out
        out.append(w)


def fractional_difference(x: Column, weights: list[float]) -> Column:
    """The weighted sum of the last values; null until all are there."""
    n = len(weights)
    past = F.collect_list(x).over(rows(n))
    dot = F.aggregate(F.zip_with(past, F.lit(weights[::-1]), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(past) == n, dot)
