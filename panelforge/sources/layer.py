"""The data layer: a source's tables joined, corrected, adjusted and looked up as they were known."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import facts, joins
from ..operators import windows as w
from . import contract

PRICES = ("open", "high", "low", "close")


def adjust(bars: DataFrame, mode: str = "backward", reference: str | None = None) -> DataFrame:
    """Adds ``vwap`` and adjusts prices: "none" as traded, "backward" times the factor, "forward" times the factor over the symbol's last one (vwap as traded then), of those up to the ``reference`` date if one is given."""
    raw = F.col("amount") / F.nullif(F.col("volume").cast("double"), F.lit(0.0))
    if mode == "none":
        return bars.withColumn("vwap", raw)
    if mode == "backward":
        ratio, vwap = F.col("adj_factor"), raw * F.col("adj_factor")
    elif mode == "forward":
        known = F.col("adj_factor") if reference is None else F.when(F.col("date") <= F.lit(reference).cast("date"), F.col("adj_factor"))
        ratio, vwap = F.col("adj_factor") / F.last(known, ignorenulls=True).over(w.by_symbol().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)), raw
    else:
        raise ValueError(mode)
    own = bars.withColumn("_ratio", ratio).withColumn("vwap", vwap)
    return own.withColumns({c: F.col(c) * F.col("_ratio") for c in PRICES if c in bars.columns}).drop("_ratio")


def factor_from_actions(actions: DataFrame, grid: DataFrame) -> DataFrame:
    """(symbol, date, adj_factor): the product of 1 + bonus (and transfer) of all actions up to a date, as a running sum of logarithms."""
    gain = F.lit(1.0) + F.coalesce("bonus", F.lit(0.0)) + (F.coalesce("transfer", F.lit(0.0)) if "transfer" in actions.columns else 0.0)
    steps = actions.groupBy("symbol", F.col("ex_date").alias("date")).agg(F.sum(F.ln(gain)).alias("_g")).withColumn("_row", F.lit(0))
    both = grid.select("symbol", "date", F.lit(0.0).alias("_g"), F.lit(1).alias("_row")).unionByName(steps)
    over = W.partitionBy("symbol").orderBy("date", "_row").rowsBetween(W.unboundedPreceding, 0)
    return both.select("symbol", "date", "_row", F.exp(F.sum("_g").over(over)).alias("adj_factor")).where("_row = 1").drop("_row")


class DataLayer:
    def __init__(self, source: contract.Source):
        self.source = source

    def rows(self, name: str, symbols=None, start: str | None = None, end: str | None = None, **where) -> DataFrame:
        """Any table of the source, filtered."""
        return contract.read(self.source, name, symbols, start, end, **where)

    def daily(self, symbols=None, start: str | None = None, end: str | None = None, mode: str = "backward") -> DataFrame:
        """Bars with share capital, corrected by what overrides say, and adjusted."""
        bars = self.rows("daily", symbols, start, end)
        over = self.rows("status_overrides", symbols, start, end)
        names = [c for c in over.columns if c not in ("symbol", "date")]
        over = over.select("symbol", "date", *(F.col(c).alias(f"_new_{c}") for c in names))
        out = bars.join(over, ["symbol", "date"], "left")
        out = out.withColumns({c: F.coalesce(f"_new_{c}", c) if c in bars.columns else F.col(f"_new_{c}") for c in names}).drop(*(f"_new_{c}" for c in names))
        shares = self.rows("share_capital", symbols, start, end).select("symbol", "date", "float_shares", "total_shares")
        return adjust(out.join(shares, ["symbol", "date"], "left"), mode)

    def fundamental_as_of(self, fields: list[str], when: str, symbols=None, days: int = 600) -> DataFrame:
        """The newest known values, of reports announced in the ``days`` before."""
        at = F.lit(when).cast("date")
        return facts.latest_as_of(self.rows("fundamentals", symbols).where((F.col("announce_date") >= F.date_sub(at, days)) & (F.col("announce_date") <= at)), fields, at)

    def fundamental_ttm(self, field: str, when: str, symbols=None, days: int = 730) -> DataFrame:
        at = F.lit(when).cast("date")
        return facts.trailing_year(self.rows("fundamentals", symbols).where((F.col("announce_date") >= F.date_sub(at, days)) & (F.col("announce_date") <= at)), field, at)

    def industry_at(self, when: str, symbols=None, system: str = "sw", level: int = 1) -> DataFrame:
        known = self.rows("industry", symbols, system=system, level=level).where(F.col("date") <= F.lit(when).cast("date"))
        return known.groupBy("symbol").agg(F.max_by("industry_code", "date").alias("industry_code"))

    def industry_on(self, grid: DataFrame, system: str = "sw", level: int = 1) -> DataFrame:
        """(symbol, date, industry_code) of every cell of a grid, by one as-of pass."""
        return joins.as_of(grid.select("symbol", "date"), self.rows("industry", system=system, level=level), "symbol", "date", "date", ["industry_code"])

    def concepts_at(self, when: str, symbols=None, source: str = "own") -> DataFrame:
        return joins.valid_at(self.rows("concepts", symbols, source=source), F.lit(when).cast("date"), "effective_date", "expired_date").select("symbol", "concept_code").distinct()

    def concept_members(self, code: str, when: str, source: str = "own") -> DataFrame:
        return self.concepts_at(when, None, source).where(F.col("concept_code") == code).select("symbol").distinct().orderBy("symbol")

    def billboard(self, end: str, count: int = 5, symbols: list[str] | None = None) -> DataFrame:
        rows = contract.last_sessions(self.source, "billboard", end, count)
        return rows if symbols is None else rows.where(F.col("symbol").isin(symbols))

    def factors(self, names: list[str], symbols=None, start: str | None = None, end: str | None = None) -> DataFrame:
        return contract.factors(self.source, names, symbols, start, end)
