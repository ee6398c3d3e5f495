"""A deterministic source of daily bars: every cell is a function of (seed, symbol, session), so any part can be made alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def sessions(spark: SparkSession, start: str, end: str) -> DataFrame:
    """Weekdays from start to end."""
    return spark.sql(f"SELECT explode(sequence(date'{start}', date'{end}', interval 1 day)) AS date").where(F.weekday("date") < 5)


def daily_bars(spark: SparkSession, symbols: int, start: str, end: str, seed: int = 0, volatility: float = 0.02) -> DataFrame:
    """Bars of a geometric walk; steps come from a hash, so that they repeat on every cluster.

    The pair of axes is the table itself; ``spark.range`` deals the symbols out.
    """
    s = spark.range(symbols).select(F.format_string("S%06d", "id").alias("symbol"))
    grid = s.join(F.broadcast(sessions(spark, start, end)))
    unit = lambda salt: (F.pmod(F.xxhash64("symbol", "date", F.lit(seed), F.lit(salt)), F.lit(1 << 30)) + 0.5) / (1 << 30)
    normal = F.sqrt(-2 * F.ln(unit("a"))) * F.cos(2 * F.pi() * unit("b"))
    walk = F.sum(normal * volatility).over(W.partitionBy("symbol").orderBy("date").rowsBetween(W.unboundedPreceding, 0))
    p = grid.withColumn("close", 100 * F.exp(walk)).withColumn("open", F.col("close") * (1 + (unit("o") - 0.5) * volatility))
    p = p.withColumn("high", F.greatest("open", "close") * (1 + unit("h") * volatility / 2)).withColumn("low", F.least("open", "close") * (1 - unit("l") * volatility / 2))
    p = p.withColumn("volume", F.floor(1e6 * (0.5 + unit("v"))).cast("long")).withColumn("amount", F.col("volume") * (F.col("high") + F.col("low")) / 2)
    return p.select("symbol", "date", "open", "high", "low", "close", "volume", "amount")
