"""The contract of market-data sources, and a source over landed Parquet tables.

A source gives DataFrames, so a request is a plan: filters on symbols and dates reach the scan, and nothing is fetched
until it is asked for.  Vendors' tables are landed as Parquet by whatever writes them; the network is no part of it.
"""

from __future__ import annotations

from typing import Protocol

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The tables of a source and the column that orders each in time.
TIME = {
    "daily": "date", "intraday": "ts", "universe": "date", "corporate_actions": "ex_date", "calendar": "date", "status_overrides": "date", "fundamentals": "announce_date", "industry": "date",
    "concepts": "effective_date", "share_capital": "date", "margin_trading": "date", "money_flow": "date", "call_auction": "date", "billboard": "date", "factor_exposure": "date", "index_valuation": "date",
}


class Source(Protocol):
    def table(self, name: str) -> DataFrame: ...


def read(provider: Source, name: str, symbols: list[str] | DataFrame | None = None, start: str | None = None, end: str | None = None, **where: object) -> DataFrame:
    """Rows of a table: symbols (a short list, or a table to join with), both ends of the time closed (a date as end means the whole day), and equal values of other columns."""
    rows, time = provider.table(name), TIME[name]
    if isinstance(symbols, DataFrame):
        rows = rows.join(symbols.select("symbol").distinct(), "symbol", "left_semi")
    elif symbols is not None:
        rows = rows.where(F.col("symbol").isin(symbols))
    if start:
        rows = rows.where(F.col(time) >= F.lit(start).cast(dict(rows.dtypes)[time]))
    if end:
        rows = rows.where(F.col(time) < F.date_add(F.lit(end[:10]).cast("date"), 1).cast(dict(rows.dtypes)[time]) if len(end) == 10 else F.col(time) <= F.lit(end).cast(dict(rows.dtypes)[time]))
    for column, value in where.items():
        rows = rows.where(F.col(column).isin(list(value)) if isinstance(value, (list, tuple)) else F.col(column) == F.lit(value))
    return rows


def last_sessions(source: Source, name: str, end: str, count: int) -> DataFrame:
    """Rows of the last ``count`` sessions up to a date."""
    days = source.table("calendar").where(F.col("date") <= F.lit(end).cast("date")).orderBy(F.desc("date")).limit(count)
    return source.table(name).join(F.broadcast(days.select("date")), "date", "left_semi")


def factors(source: Source, names: list[str], symbols=None, start: str | None = None, end: str | None = None) -> DataFrame:
    """(symbol, date, a column for each factor): the long table pivoted over the names asked for."""
    long = read(source, "factor_exposure", symbols, start, end, factor=names)
    return long.groupBy("symbol", "date").pivot("factor", names).agg(F.first("value"))


class LandedSource:
    """Tables as ``{root}/{name}`` Parquet."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/{name}")

    @staticmethod
    def land(source: Source, root: str, names: list[str] | None = None) -> None:
        """Writes a source's tables, ordered by time so that scans skip row groups."""
        for name in names or list(TIME):
            source.table(name).sortWithinPartitions(TIME[name]).write.mode("overwrite").parquet(f"{root}/{name}")
