"""A deterministic market: every cell is a function of (seed, symbol, session), in plain arithmetic, so any part can be made alone and repeats everywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..operators import universe, windows
from ..plans import sessions as calendars
from .synthetic import sessions

C = F.col
PRIME = 1_000_003
INDUSTRIES, CONCEPTS, FACTORS = 12, 9, ("size", "value", "beta")
#: Kinds of reports and the days from a period's end until each is known.
LAGS = {"forecast": 10, "flash": 25, "official": 45}


class MarketSource:
    def __init__(self, spark: SparkSession, symbols: int = 50, start: str = "2020-01-01", end: str = "2020-12-31", seed: int = 42):
        self.spark, self.n, self.start, self.end, self.seed = spark, symbols, start, end, seed

    def table(self, name: str) -> DataFrame:
        return getattr(self, name)()

    # ---- axes and noise

    def unit(self, salt: int, t: Column | None = None) -> Column:
        """A number in (0, 1) from the symbol's number, the day and a salt: cubes modulo a prime."""
        day = F.unix_date("date") if t is None else t
        x = (C("i") * 7_919 + day * 104_729 + salt * 1_299_709 + self.seed) % PRIME
        return (((x * x % PRIME) * x + 12_345) % PRIME + 0.5) / PRIME

    def symbols(self) -> DataFrame:
        """(i, symbol): the first tenth on the growth board, then main boards in turn."""
        growth = F.concat(F.lit("688"), F.lpad(C("i").cast("string"), 3, "0"), F.lit(".SH"))
        main = F.when(C("i") % 2 == 1, F.concat(F.lit("60"), F.lpad(C("i").cast("string"), 4, "0"), F.lit(".SH"))).otherwise(F.concat(F.lit("00"), F.lpad(C("i").cast("string"), 4, "0"), F.lit(".SZ")))
        return self.spark.range(self.n).select(C("id").alias("i")).select("i", F.when(C("i") < self.n // 10, growth).otherwise(main).alias("symbol"))

    def calendar(self) -> DataFrame:
        return sessions(self.spark, self.start, self.end)

    def _grid(self) -> DataFrame:
        """Symbols and sessions are the two axes of the market; their product is the market itself."""
        return self.symbols().join(F.broadcast(self.calendar()))

    def _known_next(self, rows: DataFrame) -> DataFrame:
        """Adds ``available_at``: 9:30 of the next session."""
        return calendars.step(rows, self.calendar(), "date", 1, "_n").withColumn("available_at", C("_n").cast("timestamp") + F.expr("INTERVAL 570 MINUTES")).drop("_n")

    # ---- prices

    def daily(self) -> DataFrame:
        normal = F.sqrt(-2 * F.ln(self.unit(1))) * F.cos(2 * F.pi() * self.unit(2))
        jump = F.when(self.unit(3) < 0.005, 0.09).when(self.unit(3) < 0.01, -0.09).otherwise(0.0)
        order = windows.by_symbol()
        p = self._grid().withColumn("_step", 3e-4 + 0.02 * normal + jump).withColumn("_row", F.row_number().over(order)).withColumn("_halt", self.unit(4) < 0.01)
        p = p.withColumn("_walk", 20 * F.exp(F.sum("_step").over(order.rowsBetween(W.unboundedPreceding, 0)))).withColumn("_last", F.lag("_walk").over(order))
        price = lambda x: F.when(~C("_halt"), x)
        p = p.select("i", "symbol", "date", price(C("_walk") * (1 + 0.01 * (self.unit(5) - 0.5))).alias("open"), price(C("_walk")).alias("close"), C("_halt").alias("is_suspended"), "_last", "_row", F.when(C("_halt"), 0).otherwise(F.floor(1e6 * (0.5 + self.unit(6)))).cast("long").alias("volume"))
        p = p.withColumn("high", F.greatest("open", "close") * 1.002).withColumn("low", F.least("open", "close") * 0.998).withColumn("amount", F.coalesce(C("close") * C("volume"), F.lit(0.0)))
        change = C("close") / C("_last") - 1
        return p.select("symbol", "date", "open", "high", "low", "close", "volume", "amount", (1 + 0.05 * F.floor((C("_row") - 1) / 60)).alias("adj_factor"), "is_suspended", F.coalesce(change >= 0.08, F.lit(False)).alias("is_limit_up"), F.coalesce(change <= -0.08, F.lit(False)).alias("is_limit_down"), (C("i") % 17 == 0).alias("is_st"), (C("_row") + 100).cast("int").alias("days_since_listing"))

    def intraday(self, minutes: int = 30) -> DataFrame:
        """240 / minutes bars a session, stamped at their ends, between the day's open and close."""
        count = 240 // minutes
        k = F.explode(F.sequence(F.lit(1), F.lit(count)))
        b = self.daily().where("not is_suspended").select("symbol", "date", "open", "close", "volume", "adj_factor", k.alias("_k"))
        at = C("_k") * minutes + F.when(C("_k") * minutes <= 120, 570).otherwise(660)
        price = C("open") + (C("close") - C("open")) * C("_k") / count
        return b.select("symbol", F.timestamp_seconds(F.unix_date("date") * 86_400 + at * 60).alias("ts"), price.alias("close"), F.floor(C("volume") / count).alias("volume"), "adj_factor", F.when(C("_k") * minutes <= 120, "morning").otherwise("afternoon").alias("session"))

    def universe(self) -> DataFrame:
        """Membership of the broad universe without the growth board and special treatment, at equal weights."""
        kept = universe.filter_boards(self._grid(), growth=False).where("i % 17 <> 0")
        return kept.select("date", "symbol", F.lit(True).alias("in_universe"), (1 / F.count("*").over(W.partitionBy("date"))).alias("weight"))

    # ---- facts

    def corporate_actions(self) -> DataFrame:
        """A dividend every sixty sessions."""
        g = self._grid().withColumn("_row", F.row_number().over(windows.by_symbol())).where("(_row + i) % 60 = 0")
        return g.select("symbol", F.lit("dividend").alias("action_type"), F.date_sub("date", 20).alias("announce_date"), C("date").alias("ex_date"), F.round(0.1 + self.unit(7), 4).alias("cash"), F.when(C("i") % 5 == 0, 0.1).otherwise(0.0).alias("bonus"))

    def status_overrides(self) -> DataFrame:
        """Sparse corrections: special treatment lifted on some days."""
        return self._grid().where("i % 17 = 0 and dayofmonth(date) <= 5").select("symbol", "date", F.lit(False).alias("is_st"))

    def share_capital(self) -> DataFrame:
        g = self._grid().select("symbol", "date", (100_000_000 + C("i") * 1_000_000).alias("float_shares"))
        return g.withColumn("total_shares", F.floor(C("float_shares") * 1.5))

    def fundamentals(self) -> DataFrame:
        """Forecast, flash and official rows of each quarter, known after their lags."""
        ends = self.spark.sql(f"SELECT explode(sequence(trunc(date'{self.start}', 'quarter'), date'{self.end}', interval 3 month)) AS _q").select(F.last_day(F.add_months("_q", 2)).alias("report_period"))
        kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("report_type"), F.lit(v).alias("lag")) for k, v in LAGS.items())))
        r = self.symbols().join(F.broadcast(ends)).select("i", "symbol", "report_period", kinds.alias("k")).select("i", "symbol", "report_period", "k.*")
        noise = self.unit(8, F.unix_date("report_period"))
        value = F.when((C("report_type") == "official") | (C("i") % 3 != 0), F.round(1e6 * (1 + noise) * F.quarter("report_period") * (1 + C("lag") / 1000), 2))
        known = F.date_add("report_period", C("lag"))
        return r.select("symbol", "report_period", "report_type", known.alias("announce_date"), known.alias("available_at"), F.year("report_period").alias("fiscal_year"), F.quarter("report_period").alias("fiscal_quarter"), value.alias("net_profit"), F.round(value * 8, 2).alias("total_equity"))

    def industry(self) -> DataFrame:
        """One industry a symbol and level, and another from the middle of the year on for every fourth."""
        days = F.explode(F.array(F.lit(self.start).cast("date"), F.add_months(F.lit(self.start).cast("date"), 6)))
        s = self.symbols().select("i", "symbol", days.alias("date")).withColumn("_late", C("date") > F.lit(self.start).cast("date")).where("not _late or i % 4 = 0")
        code = (C("i") * 31 + C("_late").cast("int")) % INDUSTRIES
        return s.select("symbol", "date", F.lit("sw").alias("system"), F.lit(1).alias("level"), F.format_string("I%02d", code).alias("industry_code"))

    def concepts(self) -> DataFrame:
        """One to three concepts a symbol; every second one expires."""
        begin = F.lit(self.start).cast("date")
        c = self.symbols().select("i", "symbol", F.explode(F.sequence(F.lit(0), C("i") % 3)).alias("k"))
        return c.select("symbol", F.lit("own").alias("source"), F.format_string("K%02d", (C("i") * 7 + C("k") * 4) % CONCEPTS).alias("concept_code"), F.date_add(begin, (C("k") * 30).cast("int")).alias("effective_date"), F.when((C("i") + C("k")) % 2 == 0, F.date_add(begin, (C("k") * 30 + 90).cast("int"))).alias("expired_date"))

    # ---- flows

    def margin_trading(self) -> DataFrame:
        return self._known_next(self._grid().select("symbol", "date", F.round(1e6 * (1 + self.unit(9)), 2).alias("fin_balance"), F.round(1e5 * (1 + self.unit(10)), 2).alias("sec_balance")))

    def money_flow(self) -> DataFrame:
        flow = lambda salt, size: F.round(size * (self.unit(salt) - 0.5), 2)
        rows = self._grid().select("symbol", "date", flow(11, 1e6).alias("net_xl"), flow(12, 5e5).alias("net_l"), flow(13, 2e5).alias("net_m"), flow(14, 1e5).alias("net_s"))
        return self._known_next(rows.withColumn("net_main", C("net_xl") + C("net_l")))

    def call_auction(self) -> DataFrame:
        """Price, volume and five levels of the opening auction, known at 9:30 of the day."""
        d = self.daily().where("not is_suspended")
        levels = [F.round(C("open") + sign * 0.01 * k, 4).alias(f"{side}{k}") for side, sign in (("bid", -1), ("ask", 1)) for k in range(1, 6)]
        return d.select("symbol", "date", (C("date").cast("timestamp") + F.expr("INTERVAL 570 MINUTES")).alias("available_at"), C("open").alias("auction_price"), F.floor(C("volume") / 20).alias("auction_volume"), (C("open") * F.floor(C("volume") / 20)).alias("auction_amount"), *levels)

    def billboard(self) -> DataFrame:
        """Buyers and sellers of the symbols that are listed on a day."""
        sides = F.explode(F.array(F.lit("BUY"), F.lit("SELL")))
        g = self._grid().where("(i + unix_date(date)) % 7 = 0").select("i", "symbol", "date", sides.alias("direction"))
        buy, sell = F.round(1e5 * (1 + self.unit(15)), 2), F.round(1e5 * (1 + self.unit(16)), 2)
        return g.select("symbol", "date", "direction", buy.alias("buy"), sell.alias("sell"), (buy - sell).alias("net"))

    def factor_exposure(self) -> DataFrame:
        names = F.posexplode(F.array(*map(F.lit, FACTORS))).alias("k", "factor")
        g = self._grid().select("i", "symbol", "date", names)
        normal = F.sqrt(-2 * F.ln(self.unit(17, F.unix_date("date") + C("k") * 1_000))) * F.cos(2 * F.pi() * self.unit(18, F.unix_date("date") + C("k") * 1_000))
        return g.select("symbol", "date", "factor", normal.alias("value"))

    def index_valuation(self) -> DataFrame:
        t = F.unix_date("date")
        return self.calendar().select(F.lit("000300.SH").alias("symbol"), "date", (0.01 + 0.005 * F.sin(t / 20)).alias("turnover"), F.lit(5e12).alias("circulating_mcap"), ((0.01 + 0.005 * F.sin(t / 20)) * 5e12).alias("amount"))
