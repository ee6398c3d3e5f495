"""Universes: dated memberships (universe, date, symbol, weight) and filters of boards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: Named broad universes, whether they leave out the growth board and special-treatment shares.
BROAD = {"main_a": (True, True), "hs_a": (False, True)}
#: Index universes and their index codes.
INDEXES = {"csi300": "000300", "csi500": "000905", "csi800": "000906", "csi1000": "000852"}


def broad(spec: str) -> tuple[bool, bool] | None:
    """(leave out the growth board, leave out special treatment) of a broad universe, None for others."""
    return BROAD.get(spec.strip().split(":", 1)[0].lower())


def is_northern(symbol: Column) -> Column:
    """Shares of the northern exchange: by suffix, or by the first two digits of the code."""
    s = F.upper(symbol)
    return s.endswith(".BJ") | F.substring(F.substring_index(s, ".", 1), 1, 2).isin("43", "83", "87", "92")


def is_growth(symbol: Column) -> Column:
    """Shares of the growth board: code 688 of the Shanghai exchange, or without a suffix."""
    s = F.upper(symbol)
    return F.substring_index(s, ".", 1).startswith("688") & (~s.contains(".") | F.substring_index(s, ".", -1).isin("SH", "XSHG"))


def filter_boards(symbols: DataFrame, northern: bool = False, growth: bool = True, column: str = "symbol") -> DataFrame:
    """Rows whose boards are wanted."""
    out = symbols if northern else symbols.where(~is_northern(F.col(column)))
    return out if growth else out.where(~is_growth(F.col(column)))


def members(universe: DataFrame, date) -> DataFrame:
    return universe.where(F.col("date") == F.lit(date)).select("symbol").distinct()


def weights(universe: DataFrame, date) -> DataFrame:
    return universe.where((F.col("date") == F.lit(date)) & F.col("weight").isNotNull()).select("symbol", "weight")


def only_members(rows: DataFrame, universe: DataFrame) -> DataFrame:
    """Rows (symbol, date, ...) of members on their date."""
    return rows.join(universe.select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")


def span(universe: DataFrame) -> DataFrame:
    return universe.agg(F.min("date").alias("first"), F.max("date").alias("last"), F.count_distinct("symbol").alias("symbols"))


def intersect(universe: DataFrame, mask: DataFrame) -> DataFrame:
    """Members that pass a mask (symbol, date, ok; absent is false), with weights that sum to one on each date again (null where they sum to zero)."""
    kept = universe.join(mask.where("ok").select("symbol", "date").distinct(), ["symbol", "date"], "left_semi")
    return kept.withColumn("weight", F.col("weight") / F.nullif(F.sum("weight").over(W.partitionBy("date")), F.lit(0.0)))
