"""Queries of a market-data source over the order tables, and of the data layer on it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import day, query, r6
from ..session import shared_dir, ship
from ..sources import contract
from ..sources.layer import DataLayer, adjust, factor_from_actions
from ..sources.trade import LAGS, SIZES, TradeSource


def _market(spark: SparkSession, sf_dir: str) -> TradeSource:
    return TradeSource(ship(spark), sf_dir)


def _r(*names: str, digits: int = 4) -> list:
    return [r6(n, n, digits) for n in names]


def _rs(*names: str, digits: int = 4) -> str:
    return ", ".join(f"round({n}, {digits}) AS {n}" for n in names)


def _bound(lo: int | None, hi: int | None) -> str:
    return " AND ".join(f"l_quantity {sign} {b}" for sign, b in ((">=", lo), ("<", hi)) if b is not None)


_BY = "OVER (PARTITION BY symbol ORDER BY date)"
_PLACE = "(l_orderkey, l_linenumber, l_extendedprice)"
_SIGNED = "CASE WHEN l_linestatus = 'O' THEN l_extendedprice ELSE -l_extendedprice END"
_DAYS = f"""bs AS (SELECT n_name AS symbol, n_nationkey AS i, n_regionkey AS region, CAST(l_shipdate AS DATE) AS date, arg_min(l_extendedprice, {_PLACE}) AS open, max(l_extendedprice) AS high, min(l_extendedprice) AS low, arg_max(l_extendedprice, {_PLACE}) AS close,
 CAST(sum(l_quantity) AS BIGINT) AS quantity, sum(l_extendedprice) AS amount, count(*) AS lines, avg(l_discount) AS discount, avg(l_tax) AS tax, max(l_tax) AS top_tax, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'A'), 0) AS kept, coalesce(sum(l_extendedprice) FILTER (l_returnflag = 'R'), 0) AS back,
 {', '.join(f"coalesce(sum({_SIGNED}) FILTER ({_bound(*b)}), 0) AS {k}" for k, b in SIZES.items())}, coalesce(sum(l_extendedprice) FILTER (l_quantity >= 48 AND l_linestatus = 'O'), 0) AS bought, coalesce(sum(l_extendedprice) FILTER (l_quantity >= 48 AND l_linestatus = 'F'), 0) AS sold, count(*) FILTER (l_quantity >= 48) AS listed
 FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY ALL)"""
_CAL = "cal AS (SELECT DISTINCT CAST(l_shipdate AS DATE) AS date FROM lineitem WHERE isodow(l_shipdate) < 6)"
_NEXT = f"{_CAL}, nx AS (SELECT d.date, min(c.date) AS later FROM (SELECT DISTINCT date FROM bs) d JOIN cal c ON c.date > d.date GROUP BY 1)"
_KNOWN = "strftime(later + INTERVAL 570 MINUTE, '%Y-%m-%d %H:%M') AS known"
_ACTIONS = "act AS (SELECT symbol, max(date) AS ex_date, max(date) - 20 AS announce_date, max(top_tax) AS cash, (count(*) % 5) / 50.0::DOUBLE AS bonus FROM bs GROUP BY symbol, date_trunc('quarter', date))"
_FACTOR = f"{_ACTIONS}, af AS (SELECT b.symbol, b.date, exp(sum(coalesce(ln(1 + a.bonus), 0)) OVER (PARTITION BY b.symbol ORDER BY b.date ROWS UNBOUNDED PRECEDING)) AS adj_factor FROM bs b LEFT JOIN act a ON a.symbol = b.symbol AND a.ex_date = b.date)"
_DAILY = f"""{_DAYS}, {_FACTOR}, dl AS (SELECT b.i, b.symbol, b.date, quantity % 11 = 0 AS is_suspended, CASE WHEN quantity % 11 <> 0 THEN open END AS open, CASE WHEN quantity % 11 <> 0 THEN high END AS high, CASE WHEN quantity % 11 <> 0 THEN low END AS low, CASE WHEN quantity % 11 <> 0 THEN close END AS close,
 CASE WHEN quantity % 11 = 0 THEN 0 ELSE quantity END AS volume, CASE WHEN quantity % 11 = 0 THEN 0 ELSE amount END AS amount, adj_factor, coalesce(close / lag(close) OVER w - 1 >= 0.5, false) AS is_limit_up, coalesce(close / lag(close) OVER w - 1 <= -0.5, false) AS is_limit_down, i % 7 = 0 AS is_st, row_number() OVER w AS days_since_listing FROM bs b JOIN af ON af.symbol = b.symbol AND af.date = b.date WINDOW w AS (PARTITION BY b.symbol ORDER BY b.date))"""


@query("SELECT n_nationkey AS i, n_name AS symbol, n_regionkey AS region FROM nation")
def market_symbols(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _market(spark, sf_dir).symbols()


@query(f"WITH {_CAL} SELECT CAST(date AS VARCHAR) AS date FROM cal")
def market_calendar(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).rows("calendar").select(day())


@query(f"WITH {_DAILY} SELECT symbol, CAST(date AS VARCHAR) AS date, {_rs('open', 'high', 'low', 'close')}, volume, round(amount, 2) AS amount, round(adj_factor, 6) AS adj_factor, is_suspended, is_limit_up, is_limit_down, is_st, CAST(days_since_listing AS INTEGER) AS days_since_listing FROM dl")
def market_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).rows("daily").select("symbol", day(), *_r("open", "high", "low", "close"), "volume", r6("amount", "amount", 2), r6("adj_factor", "adj_factor"), "is_suspended", "is_limit_up", "is_limit_down", "is_st", "days_since_listing")


@query("SELECT event_type AS symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, round(value, 5) AS close, CAST(1 AS BIGINT) AS volume, CASE WHEN hour(ts) < 12 THEN 'morning' ELSE 'afternoon' END AS session FROM events")
def market_intraday(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Minute prices of every day."""
    b = DataLayer(_market(spark, sf_dir)).rows("intraday")
    return b.select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"), r6("close", "close", 5), "volume", "session")


@query(f"WITH {_DAYS}, u AS (SELECT date, symbol, amount FROM bs WHERE i % 7 <> 0 QUALIFY row_number() OVER (PARTITION BY date ORDER BY amount DESC, symbol) <= 12) SELECT CAST(date AS VARCHAR) AS date, symbol, true AS in_universe, round(amount / sum(amount) OVER (PARTITION BY date), 8) AS weight FROM u")
def market_universe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).rows("universe").select(day(), "symbol", "in_universe", r6("weight", "weight", 8))


@query(f"WITH {_DAYS}, {_ACTIONS} SELECT symbol, 'dividend' AS action_type, CAST(announce_date AS VARCHAR) AS announced, CAST(ex_date AS VARCHAR) AS ex_date, round(cash, 4) AS cash, round(bonus, 4) AS bonus FROM act")
def market_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = DataLayer(_market(spark, sf_dir)).rows("corporate_actions")
    return a.select("symbol", "action_type", F.date_format("announce_date", "yyyy-MM-dd").alias("announced"), F.date_format("ex_date", "yyyy-MM-dd").alias("ex_date"), *_r("cash", "bonus"))


@query(f"WITH {_DAYS}, {_FACTOR} SELECT symbol, CAST(date AS VARCHAR) AS date, round(adj_factor, 6) AS adj_factor FROM af")
def factor_of_actions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    return factor_from_actions(m.corporate_actions(), m._days().select("symbol", "date")).select("symbol", day(), r6("adj_factor", "adj_factor"))


@query(f"WITH {_DAYS} SELECT symbol, CAST(date AS VARCHAR) AS date, false AS is_st FROM bs WHERE i % 7 = 0 AND day(date) <= 5")
def market_overrides(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).rows("status_overrides").select("symbol", day(), "is_st")


_LAG = "list_value(" + ", ".join(f"{{'k': '{k}', 'd': {v}}}" for k, v in LAGS.items()) + ")"
_FUND = f"""qs AS (SELECT n_name AS symbol, last_day(CAST(date_trunc('quarter', o_orderdate) + INTERVAL 2 MONTH AS DATE)) AS report_period, sum(o_totalprice) AS official, sum(o_totalprice) FILTER (o_orderkey % 2 = 0) AS flash, CASE WHEN count(*) % 3 <> 0 THEN sum(o_totalprice) FILTER (o_orderkey % 4 = 0) * 2 END AS forecast FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY 1, 2),
 fund AS (SELECT symbol, report_period, k.k AS report_type, report_period + CAST(k.d AS INTEGER) AS available_at, CASE k.k WHEN 'official' THEN official WHEN 'flash' THEN flash ELSE forecast END AS net_profit FROM (SELECT *, unnest({_LAG}) AS k FROM qs))"""


@query(f"WITH {_FUND} SELECT symbol, CAST(report_period AS VARCHAR) AS report_period, report_type, CAST(available_at AS VARCHAR) AS available_at, round(net_profit, 2) AS net_profit, round(net_profit * 3, 2) AS total_equity FROM fund WHERE report_type IN ('official', 'flash')")
def market_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two kinds of reports, by an equal value of a column."""
    f = DataLayer(_market(spark, sf_dir)).rows("fundamentals", report_type=["official", "flash"])
    return f.select("symbol", F.date_format("report_period", "yyyy-MM-dd").alias("report_period"), "report_type", F.date_format("available_at", "yyyy-MM-dd").alias("available_at"), r6("net_profit", "net_profit", 2), r6("total_equity", "total_equity", 2))


@query(f"WITH {_DAILY}, o AS (SELECT symbol, date, CASE WHEN i % 7 = 0 AND day(date) <= 5 THEN false ELSE is_st END AS st, close * adj_factor / last_value(adj_factor) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS close, amount / nullif(volume, 0) AS vwap FROM dl), c AS (SELECT symbol, date, CAST(sum(lines) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING) * 1000 AS BIGINT) AS float_shares FROM bs) SELECT symbol, CAST(date AS VARCHAR) AS date, {_rs('close')}, round(vwap + 1e-8, 4) AS vwap, st AS is_st, float_shares, CAST(floor(float_shares * 1.5) AS BIGINT) AS total_shares FROM o JOIN c USING (symbol, date)")
def layer_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars with share capital, overrides that win, and forward adjustment.  The tiny shift parts quotients that end in 5, which the two sides round apart."""
    return DataLayer(_market(spark, sf_dir)).daily(mode="forward").select("symbol", day(), *_r("close"), F.round(F.col("vwap") + 1e-8, 4).alias("vwap"), "is_st", "float_shares", "total_shares")


@query(f"WITH {_DAILY} SELECT symbol, CAST(date AS VARCHAR) AS date, round(open * adj_factor, 7) AS open, round(close * adj_factor, 7) AS close, round(amount / nullif(volume, 0) * adj_factor, 7) AS vwap FROM dl WHERE symbol IN ('NATION_3', 'NATION_11') AND date BETWEEN DATE '1996-02-01' AND DATE '1997-01-31'")
def layer_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two symbols' backward-adjusted bars of a year."""
    return DataLayer(_market(spark, sf_dir)).daily(["NATION_3", "NATION_11"], "1996-02-01", "1997-01-31").select("symbol", day(), *_r("open", "close", "vwap", digits=7))


_RANK = "(report_period, CASE report_type WHEN 'official' THEN 3 WHEN 'flash' THEN 2 ELSE 1 END)"


@query(f"WITH {_FUND} SELECT symbol, round(arg_max(net_profit, {_RANK}) FILTER (net_profit IS NOT NULL), 2) AS net_profit FROM fund WHERE available_at <= DATE '1998-08-20' AND available_at >= DATE '1998-08-20' - 600 GROUP BY 1")
def layer_fundamental(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).fundamental_as_of(["net_profit"], "1998-08-20").select("symbol", r6("net_profit", "net_profit", 2))


_IND = f"{_DAYS}, i0 AS (SELECT symbol, any_value(i) AS i, any_value(region) AS region, min(date) AS a, min(date) FILTER (date >= DATE '1997-01-01') AS b FROM bs GROUP BY 1), ind AS (SELECT symbol, a AS date, printf('I%02d', region % 5) AS industry_code FROM i0 UNION ALL SELECT symbol, b, printf('I%02d', (region + 1) % 5) FROM i0 WHERE i % 4 = 0 AND b IS NOT NULL)"


@query(f"WITH {_IND} SELECT symbol, arg_max(industry_code, date) AS industry_code FROM ind WHERE date <= DATE '1997-03-03' GROUP BY 1")
def layer_industry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).industry_at("1997-03-03")


@query(f"WITH {_IND} SELECT bs.symbol, CAST(bs.date AS VARCHAR) AS date, arg_max(industry_code, ind.date) AS industry_code FROM bs LEFT JOIN ind ON ind.symbol = bs.symbol AND ind.date <= bs.date GROUP BY 1, 2")
def industry_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    return DataLayer(m).industry_on(m._days().select("symbol", "date")).select("symbol", day(), "industry_code")


_CON = "con AS (SELECT n_name AS symbol, c_mktsegment AS concept_code, CAST(min(o_orderdate) AS DATE) AS a, CASE WHEN count(*) % 2 = 0 THEN CAST(max(o_orderdate) AS DATE) END AS z FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_orderpriority = '1-URGENT' GROUP BY 1, 2)"
_VALID = "a <= DATE '1999-04-15' AND (z IS NULL OR z > DATE '1999-04-15')"


@query(f"WITH {_CON} SELECT DISTINCT symbol, concept_code FROM con WHERE {_VALID}")
def layer_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).concepts_at("1999-04-15")


@query(f"WITH {_CON} SELECT DISTINCT symbol FROM con WHERE concept_code = 'BUILDING' AND {_VALID}")
def concept_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).concept_members("BUILDING", "1999-04-15")


def _known():
    return F.date_format("available_at", "yyyy-MM-dd HH:mm").alias("known")


@query(f"WITH {_DAYS}, {_NEXT} SELECT symbol, CAST(bs.date AS VARCHAR) AS date, round(kept, 2) AS fin_balance, round(back, 2) AS sec_balance, {_KNOWN} FROM bs LEFT JOIN nx ON nx.date = bs.date")
def market_margin(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).rows("margin_trading").select("symbol", day(), *_r("fin_balance", "sec_balance", digits=2), _known())


@query(f"WITH {_DAYS}, {_NEXT} SELECT symbol, CAST(bs.date AS VARCHAR) AS date, {', '.join(f'round({k}, 2) AS net_{k}' for k in SIZES)}, round(xl + l, 2) AS net_main, {_KNOWN} FROM bs LEFT JOIN nx ON nx.date = bs.date")
def market_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).rows("money_flow").select("symbol", day(), *(r6(f"net_{k}", f"net_{k}", 2) for k in (*SIZES, "main")), _known())


@query(f"WITH {_DAILY} SELECT symbol, CAST(date AS VARCHAR) AS date, round(open, 4) AS auction_price, volume // 20 AS auction_volume, round(open - 0.05, 4) AS bid5, round(open + 0.01, 4) AS ask1, CAST(date AS VARCHAR) || ' 09:30' AS known FROM dl WHERE NOT is_suspended")
def market_auction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).rows("call_auction").select("symbol", day(), *_r("auction_price"), "auction_volume", *_r("bid5", "ask1"), _known())


@query(f"WITH {_DAYS}, {_CAL}, l AS (SELECT date FROM cal WHERE date <= DATE '1998-06-10' ORDER BY date DESC LIMIT 5) SELECT symbol, CAST(bs.date AS VARCHAR) AS date, CASE WHEN bought >= sold THEN 'BUY' ELSE 'SELL' END AS direction, round(bought - sold, 2) AS net FROM bs JOIN l ON l.date = bs.date WHERE listed > 0")
def market_billboard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last five sessions up to a date."""
    return DataLayer(_market(spark, sf_dir)).billboard("1998-06-10", 5).select("symbol", day(), "direction", r6("net", "net", 2))


@query(f"WITH {_DAYS} SELECT symbol, CAST(date AS VARCHAR) AS date, round(ln(amount), 5) AS size, round(tax, 5) AS beta FROM bs")
def market_factors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The long table pivoted over the factors asked for."""
    return DataLayer(_market(spark, sf_dir)).factors(["size", "beta"]).select("symbol", day(), *_r("size", "beta", digits=5))


@query(f"WITH {_DAYS} SELECT 'ALL' AS symbol, CAST(date AS VARCHAR) AS date, round(sum(lines) / 1000.0, 6) AS turnover, round(sum(amount), 2) AS amount FROM bs GROUP BY date")
def market_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return DataLayer(_market(spark, sf_dir)).rows("index_valuation", ["ALL"]).select("symbol", day(), r6("turnover", "turnover"), r6("amount", "amount", 2))


@query(f"WITH {_DAILY} SELECT symbol, CAST(date AS VARCHAR) AS date, round(close, 4) AS close, volume FROM dl WHERE symbol IN ('NATION_1', 'NATION_7', 'NATION_12') AND date BETWEEN DATE '1996-05-01' AND DATE '1996-07-31'")
def landed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same contract over landed Parquet: symbols and dates are pushed into the scan."""
    root = f"{shared_dir(spark)}/landed-{uuid.uuid4().hex}"
    contract.LandedSource.land(_market(spark, sf_dir), root, ["daily"])
    got = DataLayer(contract.LandedSource(spark, root)).rows("daily", ["NATION_1", "NATION_7", "NATION_12"], "1996-05-01", "1996-07-31")
    return got.select("symbol", day(), *_r("close"), "volume")


@query(f"WITH {_DAILY}, r AS (SELECT symbol, arg_max(adj_factor, date) AS f FROM dl WHERE date <= DATE '1997-06-30' GROUP BY 1) SELECT dl.symbol, CAST(date AS VARCHAR) AS date, round(close * adj_factor / f, 4) AS close FROM dl JOIN r ON r.symbol = dl.symbol")
def reference_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Forward adjustment to the factor known at a reference date."""
    return adjust(_market(spark, sf_dir).daily(), "forward", "1997-06-30").select("symbol", day(), *_r("close"))
