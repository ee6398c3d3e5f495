"""Long panels ``(symbol, date, ...)`` over the source tables.  The engine keeps panels long and never pivots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import table


def event_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars of events by type: open, high, low, close, vwap, volume, amount."""
    e = table(spark, sf_dir, "events")
    return e.groupBy(F.col("event_type").alias("symbol"), F.to_date("ts").alias("date")).agg(
        F.min_by("value", "ts").alias("open"), F.max("value").alias("high"), F.min("value").alias("low"), F.max_by("value", "ts").alias("close"),
        F.avg("value").alias("vwap"), F.count("*").alias("volume"), F.sum("value").alias("amount"),
    )


def segment_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean order price by market segment and day: long histories with gaps."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    return o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(F.col("c_mktsegment").alias("symbol"), F.to_date("o_orderdate").alias("date")).agg(F.avg("o_totalprice").alias("close"), F.count("*").alias("volume"), F.sum("o_totalprice").alias("amount"))


def nation_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shipped value by supplier nation and day, with the region as industry."""
    l, s, n = table(spark, sf_dir, "lineitem"), table(spark, sf_dir, "supplier"), table(spark, sf_dir, "nation")
    daily = l.join(s, l["l_suppkey"] == s["s_suppkey"]).groupBy("s_nationkey", F.to_date("l_shipdate").alias("date")).agg(F.avg("l_extendedprice").alias("close"), F.sum("l_quantity").alias("volume"), F.sum("l_extendedprice").alias("amount"))
    return daily.join(n, daily["s_nationkey"] == n["n_nationkey"]).select(F.col("n_name").alias("symbol"), "date", "close", "volume", "amount", F.col("n_regionkey").alias("industry"))


def calendar(panel: DataFrame) -> DataFrame:
    """Sessions of a panel with their number.  A calendar is small (days, not rows) and is numbered in one task."""
    from pyspark.sql import Window as W

    return panel.select("date").distinct().select("date", F.row_number().over(W.orderBy("date")).alias("seq"))


def densify(panel: DataFrame) -> DataFrame:
    """Every symbol on every session; absent cells are null.  Symbols and sessions are the two axes of the grid, so their product is the result itself."""
    grid = panel.select("symbol").distinct().join(panel.select("date").distinct())
    return grid.join(panel, ["symbol", "date"], "left")
