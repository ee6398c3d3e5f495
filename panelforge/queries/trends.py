"""Queries of market structure and ranges."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import COL, EV, day, past, query, r6
from ..operators import campaigns, paths
from ..operators import windows as w
from ..plans import panels
from ..session import ship
from ..sources.trade import TradeSource


@query()
def market_structure(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.structure(panels.event_bars(spark, sf_dir), 2).select("symbol", day(), "direction", "breaks", "reversal", r6("swing_high", "swing_high"), r6("swing_low", "swing_low"), "age")


@query()
def structure_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impulse, pullback and their ratio of each nation's weekly legs."""
    return paths.structure_ratios(_market(spark, sf_dir), 3).select("symbol", day(), "direction", *(r6(n, n) for n in ("impulse", "pullback", "extension")))


@query()
def trading_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of the spells in which the structure has no direction."""
    bars = panels.event_bars(spark, sf_dir)
    way = paths.structure(bars, 2).select("symbol", "date", "direction")
    return paths.ranges(bars.join(way, ["symbol", "date"])).select("symbol", day(), "ok", "edge", r6("width", "width"))


_LAG = "lag({}, 2) OVER (PARTITION BY symbol ORDER BY date)"
_AROUND = "({m} {c} {f}({x}) " + past(2, 3) + " AND {m} {c} {f}({x}) " + past(2) + f" AND count(*) {past(5)} = 5)"


@query(f"WITH {EV} SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN {_AROUND.format(m=_LAG.format('high'), c='>', f='max', x='high')} THEN round({_LAG.format('high')}, 6) END AS pivot_high, CASE WHEN {_AROUND.format(m=_LAG.format('low'), c='<', f='min', x='low')} THEN round({_LAG.format('low')}, 6) END AS pivot_low FROM ev")
def strict_pivots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivots beyond two bars on either side, on the bar that confirms them."""
    p = panels.event_bars(spark, sf_dir)
    return p.select("symbol", day(), r6(w.strict_pivot(COL("high"), 2, True), "pivot_high"), r6(w.strict_pivot(COL("low"), 2, False), "pivot_low"))


def _market(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weekly bars of an index for each nation that moves by a tenth of what its prices gain from a week's first trade to its last."""
    d = TradeSource(ship(spark), sf_dir)._days().withColumn("week", F.to_date(F.date_trunc("week", "date")))
    g = d.groupBy("symbol", COL("week").alias("date")).agg((F.ln(F.max_by("close", "date") / F.min_by("open", "date")) / 10).alias("step"), F.sum("quantity").alias("volume"), F.sum("lines").alias("lines"))
    g = g.withColumn("close", 100 * F.exp(F.sum("step").over(w.by_symbol().rowsBetween(W.unboundedPreceding, 0))))
    g = g.withColumn("open", COL("close") / F.exp("step"))
    out = COL("lines") % 5 / 500.0
    return g.select("symbol", "date", "open", (F.greatest("open", "close") * (1 + out)).alias("high"), (F.least("open", "close") * (1 - out)).alias("low"), "close", "volume")


@query()
def trend_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated direction and campaign metrics of each nation."""
    return campaigns.trend_panels(_market(spark, sf_dir)).select("symbol", day(), "direction", "gated", *(r6(n, n) for n in (*campaigns.TREND, "efficiency_rank")))


@query()
def flow_panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The book of positions along each campaign."""
    p = _market(spark, sf_dir)
    way = campaigns.trend_panels(p).select("symbol", "date", COL("gated").alias("direction"))
    return campaigns.flow(p.join(way, ["symbol", "date"])).select("symbol", day(), *(r6(n, n) for n in campaigns.FLOW))


@query()
def bull_trend_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.bull_trend(campaigns.trend_panels(_market(spark, sf_dir)), 0.3).select("symbol", day(), "ok")


@query()
def trend_flips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return campaigns.flip_rate(paths.trend_direction(_market(spark, sf_dir))).select("symbol", r6("flips", "flips"))


@query()
def trend_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each nation's last row up to a date as text."""
    rows = campaigns.trend_panels(_market(spark, sf_dir))
    return campaigns.report(rows, when="1999-03-31").select("symbol", day(), "direction", "summary")
