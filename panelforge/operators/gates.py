"""Boolean gates over (symbol, date).  A gate is a column that is never null; gates of different tables meet by a full join."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import windows as w

KEYS = ["symbol", "date"]


def sure(test: Column) -> Column:
    """The test, with null as false."""
    return F.coalesce(test, F.lit(False))


def combine(masks: list[DataFrame], how: str = "and") -> DataFrame:
    """(symbol, date, ok) over the union of the masks' rows; a mask without a row is false there.

    One union and one aggregation instead of a chain of full joins.
    """
    if how not in ("and", "or"):
        raise ValueError(how)
    rows = reduce(DataFrame.unionByName, (m.select(*KEYS, sure(F.col("ok")).alias("ok"), F.lit(k).alias("_m")) for k, m in enumerate(masks)))
    yes = F.count_distinct(F.when(F.col("ok"), F.col("_m")))
    return rows.groupBy(*KEYS).agg((yes == len(masks) if how == "and" else yes > 0).alias("ok"))


def between(score: Column, lower: float | None = None, upper: float | None = None) -> Column:
    tests = [score.isNotNull()] + ([score >= lower] if lower is not None else []) + ([score <= upper] if upper is not None else [])
    return sure(reduce(lambda a, b: a & b, tests))


def volume_confirms(volume: Column, window: int = 5, ratio: float = 1.5, least: int | None = None) -> Column:
    """Volume against its mean over the rows before."""
    past = w.mean(volume, window, ago=1, least=least or max(1, window // 2))
    return sure(volume / F.nullif(past, F.lit(0.0)) >= ratio)


def no_climax(close: Column, window: int = 5, most: float | None = None, percentile: Column | None = None, cap: float = 0.95) -> Column:
    """Short returns that are not at an extreme, absolute or in their cross-section."""
    r = close / w.lag(close, window) - 1
    tests = [r.isNotNull()] + ([r <= most] if most is not None else []) + ([percentile <= cap] if percentile is not None else [])
    return sure(reduce(lambda a, b: a & b, tests))


def tradable(panel: DataFrame, least_days: int = 30, least_close: float | None = None, least_amount: float | None = None, window: int = 20) -> DataFrame:
    """(symbol, date, ok) from flags is_st, is_suspended, is_limit_up and days_since_listing; a missing column is an error."""
    need = ["is_st", "is_suspended", "is_limit_up", "days_since_listing"] + ["close"] * (least_close is not None) + ["amount"] * (least_amount is not None)
    absent = [c for c in need if c not in panel.columns]
    if absent:
        raise ValueError(f"columns missing: {absent}")
    ok = ~F.coalesce("is_st", F.lit(False)) & ~F.coalesce("is_suspended", F.lit(False)) & ~F.coalesce("is_limit_up", F.lit(False)) & (F.col("days_since_listing") >= least_days)
    if least_close is not None:
        ok = ok & (F.col("close") >= least_close)
    if least_amount is not None:
        ok = ok & (w.mean(F.col("amount"), window) >= least_amount)
    return panel.select(*KEYS, sure(ok).alias("ok"))


def relative_strength(panel: DataFrame, benchmark: DataFrame | None = None, window: int = 20, share: float = 0.2) -> DataFrame:
    """(symbol, date, score, ok): log return less the benchmark's (date, close); the best share of each date passes.

    A benchmark is one row a session, so its window is one small task.
    """
    scored = panel.select(*KEYS, w.log_return(F.col("close"), window).alias("score"))
    if benchmark is not None:
        base = F.ln("close") - F.lag(F.ln("close"), window).over(W.orderBy("date"))
        scored = scored.join(benchmark.select("date", base.alias("_b")), "date", "left").select(*KEYS, (F.col("score") - F.col("_b")).alias("score"))
    n = F.count("score").over(W.partitionBy("date"))
    return scored.withColumn("ok", sure(w.rank_first(F.col("score"), ["date"]) <= F.greatest(F.lit(1.0), n * share)))


def ranked(scored: DataFrame, top: int | None = None, share: float | None = None, ascending: bool = False, eligible: Column | None = None) -> DataFrame:
    """(symbol, date, ok) of (symbol, date, score): the best ``top``, or the best share (one at least), of each date's eligible scores; ties go to the first symbol."""
    if (top is None) == (share is None):
        raise ValueError("give one of top and share")
    rows = scored if eligible is None else scored.withColumn("score", F.when(eligible, F.col("score")))
    most = F.lit(top) if top is not None else F.greatest(F.lit(1.0), F.count("score").over(W.partitionBy("date")) * share)
    return rows.select(*KEYS, sure(w.rank_first(F.col("score"), ["date"], not ascending) <= most).alias("ok"))


def near_high(close: Column, window: int = 60, most: float = 0.25) -> Column:
    """Closes that are at most a share below the rolling high."""
    return sure(w.distance_to_high(close, window) >= -most)


def in_stage(panel: DataFrame, stage: int = 2, window: int = 200, back: int = 20) -> DataFrame:
    return w.with_stage(panel, window, back).select(*KEYS, sure(F.col("stage") == stage).alias("ok"))


def spread(days: DataFrame, panel: DataFrame) -> DataFrame:
    """A flag of dates (date, ok) for every row of a panel; absent is false."""
    return panel.select(*KEYS).join(days.select("date", "ok"), "date", "left").select(*KEYS, sure(F.col("ok")).alias("ok"))


def breadth(panel: DataFrame, least: float = 0.45, index: DataFrame | None = None, above: int | None = None, in_stage_2: bool = False, net_limits: float | None = None) -> DataFrame:
    """(date, ok): enough symbols rise, the index (date, close) is above its mean over ``above`` sessions and in stage 2 if asked for, and limit-ups less limit-downs reach a share of the symbols.

    An index is one row a session, so its windows are one small task.
    """
    moved = panel.withColumn("_d", F.col("close") - w.lag(F.col("close")))
    share = F.count_if(F.col("_d") > 0) / F.nullif(F.count("_d"), F.lit(0))
    aggs = [share.alias("_rise")]
    if net_limits is not None:
        aggs.append(((F.count_if("is_limit_up") - F.count_if("is_limit_down")) / F.count("*")).alias("_net"))
    days = moved.groupBy("date").agg(*aggs)
    ok = sure(F.col("_rise") >= least)
    if net_limits is not None:
        ok = ok & sure(F.col("_net") >= net_limits)
    if index is not None:
        one = index.select(F.lit("index").alias("symbol"), "date", F.col("close").alias("_c"))
        if above:
            one = one.withColumn("_above", sure(F.col("_c") > w.mean(F.col("_c"), above)))
            ok = ok & sure(F.col("_above"))
        if in_stage_2:
            one = one.withColumn("_ma", w.mean(F.col("_c"), 200)).withColumn("_stage", w.stage(F.col("_c"), F.col("_ma"))).drop("_ma")
            ok = ok & sure(F.col("_stage") == 2)
        days = days.join(one.drop("symbol", "_c"), "date", "left")
    return days.select("date", ok.alias("ok"))
