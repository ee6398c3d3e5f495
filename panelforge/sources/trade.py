"""A market-data source over the order tables: supplier nations are the symbols, shipments their trades, customers' orders their reports.

Every table of the contract is a plan over the source tables, so filters on symbols and dates reach the scans where they can,
and nothing is made up: a price is a line's price, a flow the signed price of its lines, a fact a sum of orders.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import windows
from ..plans import sessions as calendars
from ..session import table
from .layer import factor_from_actions

C = F.col
#: Kinds of reports and the days from a period's end until each is known.
LAGS = {"forecast": 10, "flash": 25, "official": 45}
#: Bounds of the sizes of trades, by quantity.
SIZES = {"xl": (40, None), "l": (25, 40), "m": (10, 25), "s": (None, 10)}


class TradeSource:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()

    def _read(self, name: str) -> DataFrame:
        return table(self.spark, self.sf_dir, name)

    def symbols(self) -> DataFrame:
        """(i, symbol, region)."""
        return self._read("nation").select(C("n_nationkey").alias("i"), C("n_name").alias("symbol"), C("n_regionkey").alias("region"))

    def _days(self) -> DataFrame:
        """What was shipped from each nation on each day; the first and last trade by order and line."""
        lines, makers = self._read("lineitem"), self._read("supplier")
        price, place = C("l_extendedprice"), F.struct("l_orderkey", "l_linenumber", "l_extendedprice")
        signed = F.when(C("l_linestatus") == "O", price).otherwise(-price)
        inside = lambda lo, hi: (F.lit(True) if lo is None else C("l_quantity") >= lo) & (F.lit(True) if hi is None else C("l_quantity") < hi)
        some = lambda test, x: F.sum(F.when(test, x).otherwise(0.0))
        big = C("l_quantity") >= 48
        daily = lines.join(makers, C("l_suppkey") == C("s_suppkey")).groupBy(C("s_nationkey").alias("i"), F.to_date("l_shipdate").alias("date")).agg(
            F.min_by(price, place).alias("open"), F.max(price).alias("high"), F.min(price).alias("low"), F.max_by(price, place).alias("close"), F.sum("l_quantity").cast("long").alias("quantity"), F.sum(price).alias("amount"), F.count("*").alias("lines"),
            F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"), F.max("l_tax").alias("top_tax"), some(C("l_returnflag") == "A", price).alias("kept"), some(C("l_returnflag") == "R", price).alias("back"),
            *(some(inside(*b), signed).alias(k) for k, b in SIZES.items()), some(big & (C("l_linestatus") == "O"), price).alias("bought"), some(big & (C("l_linestatus") == "F"), price).alias("sold"), F.count_if(big).alias("listed"),
        )
        return daily.join(self.symbols(), "i")

    def calendar(self) -> DataFrame:
        """Weekdays on which anything was shipped."""
        return self._read("lineitem").select(F.to_date("l_shipdate").alias("date")).distinct().where(F.weekday("date") < 5)

    def _known_next(self, rows: DataFrame) -> DataFrame:
        """Adds ``available_at``: 9:30 of the next session."""
        return calendars.step(rows, self.calendar(), "date", 1, "_n").withColumn("available_at", self._opening("_n")).drop("_n")

    @staticmethod
    def _opening(day: str) -> Column:
        return C(day).cast("timestamp") + F.expr("INTERVAL 570 MINUTES")

    # ---- prices

    def daily(self) -> DataFrame:
        """Bars; days whose quantity is a multiple of 11 are suspended."""
        d = self._days()
        order = windows.by_symbol()
        halt = C("quantity") % 11 == 0
        price = lambda n: F.when(~halt, C(n)).alias(n)
        change = C("close") / F.lag("close").over(order) - 1
        bars = d.select("i", "symbol", "date", *map(price, ("open", "high", "low", "close")), F.when(halt, 0).otherwise(C("quantity")).cast("long").alias("volume"), F.when(halt, 0.0).otherwise(C("amount")).alias("amount"), halt.alias("is_suspended"), F.coalesce(change >= 0.5, F.lit(False)).alias("is_limit_up"), F.coalesce(change <= -0.5, F.lit(False)).alias("is_limit_down"), (C("i") % 7 == 0).alias("is_st"), F.row_number().over(order).alias("days_since_listing"))
        return bars.join(factor_from_actions(self.corporate_actions(), bars.select("symbol", "date")), ["symbol", "date"]).drop("i")

    def intraday(self) -> DataFrame:
        """Events as minute prices of their type."""
        return self._read("events").select(C("event_type").alias("symbol"), "ts", C("value").alias("close"), F.lit(1).cast("long").alias("volume"), F.lit(1.0).alias("adj_factor"), F.when(F.hour("ts") < 12, "morning").otherwise("afternoon").alias("session"))

    def universe(self) -> DataFrame:
        """The twelve nations of the most trade on a day, without those under special treatment, weighted by it."""
        d = self._days().where("i % 7 <> 0").withColumn("r", F.row_number().over(W.partitionBy("date").orderBy(F.desc("amount"), "symbol"))).where("r <= 12")
        return d.select("date", "symbol", F.lit(True).alias("in_universe"), (C("amount") / F.sum("amount").over(W.partitionBy("date"))).alias("weight"))

    # ---- facts

    def corporate_actions(self) -> DataFrame:
        """One action a nation and quarter, on its last day: a bonus by the number of days, cash by the highest tax."""
        g = self._days().groupBy("symbol", F.trunc("date", "quarter").alias("_q")).agg(F.max("date").alias("ex_date"), F.count("*").alias("_n"), F.max("top_tax").alias("cash"))
        return g.select("symbol", F.lit("dividend").alias("action_type"), F.date_sub("ex_date", 20).alias("announce_date"), "ex_date", "cash", (C("_n") % 5 / 50.0).alias("bonus"))

    def status_overrides(self) -> DataFrame:
        """Special treatment lifted on the first days of months."""
        return self._days().where("i % 7 = 0 and dayofmonth(date) <= 5").select("symbol", "date", F.lit(False).alias("is_st"))

    def share_capital(self) -> DataFrame:
        """A thousand shares for each line so far."""
        far = F.sum("lines").over(windows.by_symbol().rowsBetween(W.unboundedPreceding, 0)) * 1000
        return self._days().select("symbol", "date", far.alias("float_shares"), F.floor(far * 1.5).alias("total_shares"))

    def fundamentals(self) -> DataFrame:
        """Forecast, flash and official sums of the orders of each nation's customers by quarter, known after their lags."""
        key, total = C("o_orderkey"), C("o_totalprice")
        q = self._read("orders").join(self._read("customer"), C("o_custkey") == C("c_custkey")).groupBy(C("c_nationkey").alias("i"), F.last_day(F.add_months(F.trunc("o_orderdate", "quarter"), 2)).alias("report_period")).agg(F.sum(total).alias("official"), F.sum(F.when(key % 2 == 0, total)).alias("flash"), F.when(F.count("*") % 3 != 0, F.sum(F.when(key % 4 == 0, total)) * 2).alias("forecast"))
        kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("report_type"), F.lit(v).alias("lag"), C(k).alias("net_profit")) for k, v in LAGS.items())))
        r = q.join(self.symbols(), "i").select("symbol", "report_period", kinds.alias("k")).select("symbol", "report_period", "k.*")
        known = F.date_add("report_period", C("lag"))
        return r.select("symbol", "report_period", "report_type", known.alias("announce_date"), known.alias("available_at"), F.year("report_period").alias("fiscal_year"), F.quarter("report_period").alias("fiscal_quarter"), "net_profit", (C("net_profit") * 3).alias("total_equity"))

    def industry(self) -> DataFrame:
        """The region from a nation's first day on; every fourth nation moves on at its first day of 1997 or later."""
        first = self._days().groupBy("i", "symbol", "region").agg(F.min("date").alias("a"), F.min(F.when(C("date") >= F.lit("1997-01-01").cast("date"), C("date"))).alias("b"))
        two = F.explode(F.array(F.struct(C("a").alias("date"), F.lit(0).alias("late")), F.struct(C("b").alias("date"), F.lit(1).alias("late"))))
        e = first.select("i", "symbol", "region", two.alias("e")).select("i", "symbol", "region", "e.*").where("late = 0 or (i % 4 = 0 and date is not null)")
        return e.select("symbol", "date", F.lit("sw").alias("system"), F.lit(1).alias("level"), F.format_string("I%02d", (C("region") + C("late")) % 5).alias("industry_code"))

    def concepts(self) -> DataFrame:
        """The segments of a nation's customers, from their first urgent order to their last where those are an even number."""
        o = self._read("orders").where(C("o_orderpriority") == "1-URGENT").join(self._read("customer"), C("o_custkey") == C("c_custkey"))
        g = o.groupBy(C("c_nationkey").alias("i"), C("c_mktsegment").alias("concept_code")).agg(F.to_date(F.min("o_orderdate")).alias("effective_date"), F.when(F.count("*") % 2 == 0, F.to_date(F.max("o_orderdate"))).alias("expired_date"))
        return g.join(self.symbols(), "i").select("symbol", F.lit("own").alias("source"), "concept_code", "effective_date", "expired_date")

    # ---- flows

    def margin_trading(self) -> DataFrame:
        return self._known_next(self._days().select("symbol", "date", C("kept").alias("fin_balance"), C("back").alias("sec_balance")))

    def money_flow(self) -> DataFrame:
        rows = self._days().select("symbol", "date", *(C(k).alias(f"net_{k}") for k in SIZES))
        return self._known_next(rows.withColumn("net_main", C("net_xl") + C("net_l")))

    def call_auction(self) -> DataFrame:
        """The first trade, a twentieth of the day's volume, and five levels on either side, known at 9:30 of the day."""
        d = self.daily().where("not is_suspended")
        levels = [(C("open") + sign * 0.01 * k).alias(f"{side}{k}") for side, sign in (("bid", -1), ("ask", 1)) for k in range(1, 6)]
        volume = F.floor(C("volume") / 20)
        return d.select("symbol", "date", self._opening("date").alias("available_at"), C("open").alias("auction_price"), volume.alias("auction_volume"), (C("open") * volume).alias("auction_amount"), *levels)

    def billboard(self) -> DataFrame:
        """Days with lines of 48 pieces or more: what of them is open and what is filled."""
        return self._days().where("listed > 0").select("symbol", "date", F.when(C("bought") >= C("sold"), "BUY").otherwise("SELL").alias("direction"), C("bought").alias("buy"), C("sold").alias("sell"), (C("bought") - C("sold")).alias("net"))

    def factor_exposure(self) -> DataFrame:
        pairs = F.array(*(F.struct(F.lit(k).alias("factor"), v.alias("value")) for k, v in {"size": F.ln("amount"), "value": C("discount"), "beta": C("tax")}.items()))
        return self._days().select("symbol", "date", F.explode(pairs).alias("p")).select("symbol", "date", "p.*")

    def index_valuation(self) -> DataFrame:
        g = self._days().groupBy("date").agg(F.sum("lines").alias("n"), F.sum("amount").alias("amount"))
        return g.select(F.lit("ALL").alias("symbol"), "date", (C("n") / 1000.0).alias("turnover"), (C("amount") * 10).alias("circulating_mcap"), "amount")
