"""The registered features over a daily panel (symbol, date, open, close, volume, amount, and where needed float_shares,
total_shares, profit_ttm, equity, auction_price, auction_volume)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import windows as w
from .registry import Feature, Registry

C = F.col


def _finite(x: Column) -> Column:
    return F.when(F.abs(x) < float("inf"), x)


def turnover(n: int) -> Column:
    share = C("volume") / F.nullif(C("float_shares").cast("double"), F.lit(0.0))
    return w.mean(share, n)


def volume_ratio(n: int) -> Column:
    return C("volume") / F.nullif(w.mean(C("volume"), n, ago=1), F.lit(0.0))


def pe_ttm() -> Column:
    return C("close") * C("total_shares") / F.nullif(C("profit_ttm"), F.lit(0.0))


def pb() -> Column:
    return C("close") * C("total_shares") / F.nullif(C("equity"), F.lit(0.0))


def auction_premium() -> Column:
    return _finite(C("auction_price") / F.nullif(w.lag(C("close")), F.lit(0.0)) - 1)


def auction_volume_ratio() -> Column:
    return C("auction_volume") / F.nullif(w.lag(C("volume")).cast("double"), F.lit(0.0))


LIBRARY = Registry(
    [
        *(Feature(f"mom_{n}d", lambda n=n: w.log_return(C("close"), n), lookback=n + 1) for n in (5, 10, 20)),
        Feature("mom_20d_resid", lambda: C("mom_20d") - F.avg("mom_20d").over(W.partitionBy("date")), lookback=21, needs=("mom_20d",)),
        Feature("log_ret", lambda: w.log_return(C("close")), lookback=2),
        Feature("realized_vol_20d", lambda: w.std(C("log_ret"), 20), lookback=21, needs=("log_ret",)),
        Feature("row", lambda: F.row_number().over(w.by_symbol())),
        *(Feature(f"smooth_mom_{n}d", lambda n=n: w.smooth_momentum(C("close"), C("row"), n), lookback=n, needs=("row",)) for n in (60, 90)),
        *(Feature(f"turnover_{n}d", lambda n=n: turnover(n), lookback=n) for n in (5, 20)),
        Feature("volume_ratio_5d", lambda: volume_ratio(5), lookback=6),
        Feature("log_price", lambda: F.when(C("close") > 0, F.ln("close"))),
        Feature("price_ma_20d", lambda: w.mean(C("close"), 20), lookback=20),
        Feature("ma_200d", lambda: w.mean(C("close"), 200), lookback=200),
        Feature("stage_200d", lambda: w.stage(C("close"), C("ma_200d"), 20), lookback=220, needs=("ma_200d",)),
        Feature("is_stage2_200d", lambda: F.coalesce((C("stage_200d") == 2).cast("double"), F.lit(0.0)), lookback=220, needs=("stage_200d",)),
        *(Feature(f"dist_to_high_{n}d", lambda n=n: w.distance_to_high(C("close"), n), lookback=n) for n in (60, 252)),
        Feature("pe_ttm", pe_ttm),
        Feature("pb", pb),
        Feature("auction_premium", auction_premium, known="today_open", lookback=2),
        Feature("auction_volume_ratio", auction_volume_ratio, known="today_open", lookback=2),
    ]
)


def intraday(bars: DataFrame, grid: DataFrame, keys: list[str], value: Column, name: str) -> DataFrame:
    """A value of each (symbol, date) of ``grid`` (with ``since``) from the intraday bars (symbol, ts, ...) of its sessions up to 15:00; null where there are none.

    Bars go to the days of their windows by an equi-join on (symbol, day), not by a range join.
    """
    days = grid.select("symbol", "date", "since", F.explode(F.sequence("since", "date")).alias("_day")).where("since is not null")
    held = days.join(bars.withColumn("_day", F.to_date("ts")), ["symbol", "_day"]).where(F.col("ts") <= F.col("date").cast("timestamp") + F.expr("INTERVAL 15 HOURS"))
    return grid.select("symbol", "date").join(held.groupBy("symbol", "date").agg(value.alias(name)), ["symbol", "date"], "left")


def volume_slope(bars: DataFrame, grid: DataFrame, window: int = 10) -> DataFrame:
    """(symbol, date, vol_slope): the slope of rolling variances of log returns against their number, over each window of sessions; null below ``window`` returns or two variances."""
    days = grid.select("symbol", "date", F.explode(F.sequence("since", "date")).alias("_day")).where("since is not null")
    held = days.join(bars.withColumn("_day", F.to_date("ts")), ["symbol", "_day"]).where(F.col("ts") <= F.col("date").cast("timestamp") + F.expr("INTERVAL 15 HOURS"))
    order = W.partitionBy("symbol", "date").orderBy("ts")
    back = order.rowsBetween(-(window - 1), 0)
    r = held.withColumn("_r", F.ln("close") - F.lag(F.ln("close")).over(order))
    v = r.withColumn("_v", F.when(F.count("_r").over(back) == window, F.var_samp("_r").over(back))).withColumn("_i", F.row_number().over(order))
    got = v.groupBy("symbol", "date").agg(F.when((F.count("_r") >= window) & (F.count("_v") >= 2), F.regr_slope("_v", "_i")).alias("vol_slope"))
    return grid.select("symbol", "date").join(got, ["symbol", "date"], "left")


def morning_return(bars: DataFrame) -> DataFrame:
    """(symbol, date, morning): last over first close of each morning session, in logs; at least two bars."""
    early = bars.where((F.hour("ts") < 12) & (F.col("close") > 0))
    g = early.groupBy("symbol", F.to_date("ts").alias("date")).agg(F.count("*").alias("n"), (F.ln(F.max_by("close", "ts")) - F.ln(F.min_by("close", "ts"))).alias("morning"))
    return g.where("n >= 2").drop("n")
