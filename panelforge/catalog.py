"""Registered queries of the engine and the SQL they are checked against.

Numbers are rounded alike on both sides, dates are text, so that values compare exactly.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .features import library
from .functions import stats
from .operators import folds, joins, labels, paths
from .operators import windows as w
from .plans import panels
from .session import ship, table
from .sources.layer import adjust, factor_from_actions

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "momentum_barrier_mix"

EV = """ev AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date, arg_min(value, ts) AS open, max(value) AS high, min(value) AS low,
 arg_max(value, ts) AS close, avg(value) AS vwap, count(*) AS volume, sum(value) AS amount FROM events GROUP BY 1, 2)"""
SEG = """seg AS (SELECT c_mktsegment AS symbol, CAST(o_orderdate AS DATE) AS date, avg(o_totalprice) AS close, count(*) AS volume,
 sum(o_totalprice) AS amount FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2)"""
NAT = """nat AS (SELECT n_name AS symbol, CAST(l_shipdate AS DATE) AS date, avg(l_extendedprice) AS close, sum(l_quantity) AS volume,
 sum(l_extendedprice) AS amount, any_value(n_regionkey) AS industry FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1, 2)"""
PAST = "OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN {} PRECEDING AND {})"


def past(n: int, ago: int = 0) -> str:
    return PAST.format(n - 1 + ago, f"{ago} PRECEDING" if ago else "CURRENT ROW")


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


def day(c="date"):
    return F.date_format(c, "yyyy-MM-dd").alias("date")


def r6(c, name: str, digits: int = 6):
    return F.round(c, digits).alias(name)


COL = F.col

# ---- sources, projections, schema ------------------------------------------------------------------------------


@query(f"WITH {EV} SELECT symbol, CAST(date AS VARCHAR) AS date, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, round(vwap,6) AS vwap, volume, round(amount,4) AS amount FROM ev")
def daily_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.event_bars(spark, sf_dir)
    return p.select("symbol", day(), *(r6(c, c) for c in ("open", "high", "low", "close", "vwap")), "volume", r6("amount", "amount", 4))


@query(f"WITH {SEG}, g AS (SELECT * FROM (SELECT DISTINCT symbol FROM seg), (SELECT DISTINCT date FROM seg)) SELECT g.symbol, CAST(g.date AS VARCHAR) AS date, round(close,4) AS close, close IS NULL AS absent FROM g LEFT JOIN seg USING (symbol, date)")
def dense_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.densify(panels.segment_prices(spark, sf_dir)).select("symbol", day(), r6("close", "close", 4), COL("close").isNull().alias("absent"))


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_key_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joins.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


@query("SELECT o_custkey, o_orderkey, CAST(CAST(o_orderdate AS DATE) AS VARCHAR) AS date FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def keep_last_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return joins.keep_last(o, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", day("o_orderdate"))


@query(f"WITH {EV} SELECT count(*) FILTER (close <= 0) AS bad_price, count(*) FILTER (high < low) AS bad_range, count(*) FILTER (open IS NULL OR close IS NULL) AS null_price, count(*) - count(DISTINCT (symbol, date)) AS repeats FROM ev")
def invariant_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    count = lambda c: F.coalesce(F.sum(F.when(c, 1).otherwise(0)), F.lit(0))
    p = panels.event_bars(spark, sf_dir)
    return p.agg(count(COL("close") <= 0).alias("bad_price"), count(COL("high") < COL("low")).alias("bad_range"), count(COL("open").isNull() | COL("close").isNull()).alias("null_price"), (F.count("*") - F.count_distinct("symbol", "date")).alias("repeats"))


@query(f"WITH {EV} SELECT symbol, CAST(date AS VARCHAR) AS date, date_part('month', date) AS month, round(close * (1 + volume % 3) / last_value(1 + volume % 3) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING), 6) AS forward_close, round(close * (1 + volume % 3), 6) AS backward_close FROM ev")
def adjusted_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Backward and forward adjustment with a factor that stands in for corporate actions."""
    p = panels.event_bars(spark, sf_dir).select("symbol", "date", "close", "volume", "amount", (1 + COL("volume") % 3).alias("adj_factor"))
    both = adjust(p, "forward").withColumnRenamed("close", "forward_close").join(adjust(p, "backward").select("symbol", "date", COL("close").alias("backward_close")), ["symbol", "date"])
    return both.select("symbol", day(), F.month("date").cast("long").alias("month"), r6("forward_close", "forward_close"), r6("backward_close", "backward_close"))


@query(f"WITH {EV}, a AS (SELECT symbol, date, 1 + (volume % 5) / 100.0 AS g FROM ev WHERE day(date) % 7 = 0) SELECT ev.symbol, CAST(ev.date AS VARCHAR) AS date, round(exp(sum(ln(coalesce(g, 1))) OVER (PARTITION BY ev.symbol ORDER BY ev.date)), 8) AS factor FROM ev LEFT JOIN a USING (symbol, date)")
def action_factor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cumulative product of share ratios, as a running sum of logarithms."""
    p = panels.event_bars(spark, sf_dir)
    actions = p.where(F.dayofmonth("date") % 7 == 0).select("symbol", COL("date").alias("ex_date"), (COL("volume") % 5 / 100.0).alias("bonus"))
    return factor_from_actions(actions, p).select("symbol", day(), r6("adj_factor", "factor", 8))


# ---- windows and features --------------------------------------------------------------------------------------


@query(
    f"WITH {EV}, m AS (SELECT symbol, date, ln(close) - lag(ln(close), 5) OVER (PARTITION BY symbol ORDER BY date) AS m5, ln(close) - lag(ln(close), 10) OVER (PARTITION BY symbol ORDER BY date) AS m10 FROM (SELECT symbol, date, CASE WHEN close > 0 THEN close END AS close FROM ev)) SELECT symbol, CAST(date AS VARCHAR) AS date, round(m5,6) AS mom_5, round(m10,6) AS mom_10, round(m5 - avg(m5) OVER (PARTITION BY date),6) AS residual FROM m"
)
def momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.event_bars(spark, sf_dir).select("symbol", "date", w.log_return(COL("close"), 5).alias("m5"), w.log_return(COL("close"), 10).alias("m10"))
    return p.select("symbol", day(), r6("m5", "mom_5"), r6("m10", "mom_10"), r6(COL("m5") - F.avg("m5").over(W.partitionBy("date")), "residual"))


@query(
    f"WITH {EV}, l AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date) AS r FROM ev WHERE close > 0) SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN count(r) {past(10)} = 10 THEN round(stddev_samp(r) {past(10)}, 6) END AS vol_10, CASE WHEN count(close) {past(10)} = 10 THEN round(avg(close) {past(10)}, 6) END AS ma_10, CASE WHEN count(volume) {past(5, 1)} = 5 THEN round(volume / avg(volume) {past(5, 1)}, 6) END AS volume_ratio, round(ln(close), 6) AS log_price FROM l"
)
def price_volume_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.event_bars(spark, sf_dir).where("close > 0").withColumn("r", w.log_return(COL("close")))
    return p.select("symbol", day(), r6(w.std(COL("r"), 10), "vol_10"), r6(w.mean(COL("close"), 10), "ma_10"), r6(COL("volume") / w.mean(COL("volume"), 5, ago=1), "volume_ratio"), r6(F.ln("close"), "log_price"))


@query(
    f"WITH {SEG}, a AS (SELECT *, CASE WHEN count(close) {past(200)} = 200 THEN avg(close) {past(200)} END AS ma FROM seg), b AS (SELECT *, lag(ma, 20) OVER (PARTITION BY symbol ORDER BY date) AS old FROM a) SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN ma IS NULL OR old IS NULL THEN NULL WHEN close > ma AND ma > old THEN 2 WHEN close > ma THEN 3 WHEN NOT ma > old THEN 4 ELSE 1 END AS stage, coalesce(close > ma AND ma > old, false) AS is_stage_2 FROM b"
)
def trend_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = w.with_stage(panels.segment_prices(spark, sf_dir))
    return p.select("symbol", day(), "stage", F.coalesce(COL("stage") == 2, F.lit(False)).alias("is_stage_2"))


@query(f"WITH {SEG} SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN count(close) {past(60)} = 60 THEN round(close / max(close) {past(60)} - 1, 6) END AS dist_60, CASE WHEN count(close) {past(252)} = 252 THEN round(close / max(close) {past(252)} - 1, 6) END AS dist_252 FROM seg")
def distance_to_high(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.segment_prices(spark, sf_dir).select("symbol", day(), r6(w.distance_to_high(COL("close"), 60), "dist_60"), r6(w.distance_to_high(COL("close"), 252), "dist_252"))


@query(
    f"WITH {NAT}, s AS (SELECT symbol, date, ln(close) AS y, row_number() OVER (PARTITION BY symbol ORDER BY date) AS x FROM nat) SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN count(y) {past(20)} = 20 THEN round((exp(252 * regr_slope(y, x) {past(20)} / 100) - 1) * greatest(regr_r2(y, x) {past(20)}, 0), 5) + 0.0 END AS score FROM s"
)
def smooth_momentum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rolling regression of log prices on the row number; the slope is scaled down here since shipped values swing far."""
    p = panels.nation_flow(spark, sf_dir).select("symbol", "date", F.ln("close").alias("y"), F.row_number().over(w.by_symbol()).alias("x"))
    slope, r2 = F.regr_slope("y", "x").over(w.rows(20)), F.regr_r2("y", "x").over(w.rows(20))
    return p.select("symbol", day(), (F.round(w.full((F.exp(252 * slope / 100) - 1) * F.greatest(r2, F.lit(0.0)), COL("y"), 20), 5) + 0.0).alias("score"))


def _smooth_momentum(spark: SparkSession, sf_dir: str, n: int) -> DataFrame:
    p = panels.nation_flow(spark, sf_dir).withColumn("x", F.row_number().over(w.by_symbol()))
    return p.select("symbol", day(), r6(w.smooth_momentum(COL("close"), COL("x"), n), "score"))


@query()
def smooth_momentum_60(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's shorter window, on the slope itself."""
    return _smooth_momentum(spark, sf_dir, 60)


@query()
def smooth_momentum_90(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reference's longer window, on the slope itself."""
    return _smooth_momentum(spark, sf_dir, 90)


@query(
    f"WITH {EV}, n AS (SELECT symbol, date, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date) AS r, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i FROM ev WHERE close > 0), p AS (SELECT a.symbol, a.date, count(b.r) AS c, sum(pow(1 - 2.0 / 21, a.i - b.i)) FILTER (b.r IS NOT NULL) AS w, sum(pow(1 - 2.0 / 21, 2 * (a.i - b.i))) FILTER (b.r IS NOT NULL) AS w2, sum(pow(1 - 2.0 / 21, a.i - b.i) * b.r) AS s, sum(pow(1 - 2.0 / 21, a.i - b.i) * b.r * b.r) AS q FROM n a JOIN n b ON a.symbol = b.symbol AND b.i <= a.i GROUP BY 1, 2) SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN c >= 10 THEN round(sqrt((q / w - (s / w) * (s / w)) * w * w / (w * w - w2)), 6) END AS ewm_vol FROM p"
)
def ewm_volatility(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.ewm_std(panels.event_bars(ship(spark), sf_dir).where("close > 0"), 20)
    return p.select("symbol", day(), F.when(~F.isnan("ewm_vol"), F.round("ewm_vol", 6)).alias("ewm_vol"))


@query(
    f"WITH RECURSIVE {EV}, t AS (SELECT symbol, date, close, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, CASE WHEN lag(close) OVER v IS NOT NULL THEN greatest(abs(high - low), abs(high - lag(close) OVER v), abs(low - lag(close) OVER v)) END AS tr FROM ev WINDOW v AS (PARTITION BY symbol ORDER BY date)), a AS (SELECT symbol, i, tr AS atr FROM t WHERE i = 2 UNION ALL SELECT t.symbol, t.i, atr * (1 - 1.0 / 7) + tr / 7 FROM a JOIN t ON t.symbol = a.symbol AND t.i = a.i + 1) SELECT t.symbol, CAST(t.date AS VARCHAR) AS date, CASE WHEN t.i >= 8 THEN round(atr, 6) END AS atr, CASE WHEN t.i >= 8 THEN round((close - lag(close, 5) OVER (PARTITION BY t.symbol ORDER BY t.date)) / nullif(atr, 0), 5) END AS velocity FROM t LEFT JOIN a USING (symbol, i)"
)
def average_true_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.atr(panels.event_bars(ship(spark), sf_dir), 7, 5)
    clean = lambda c, d: F.when(~F.isnan(c), F.round(c, d)).alias(c)
    return p.select("symbol", day(), clean("atr", 6), clean("velocity", 5))


@query(
    f"WITH {EV} SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN count(*) {past(5)} = 5 AND lag(high, 2) OVER (PARTITION BY symbol ORDER BY date) = max(high) {past(5)} THEN round(lag(high, 2) OVER (PARTITION BY symbol ORDER BY date), 6) END AS swing_high, CASE WHEN count(*) {past(5)} = 5 AND lag(low, 2) OVER (PARTITION BY symbol ORDER BY date) = min(low) {past(5)} THEN round(lag(low, 2) OVER (PARTITION BY symbol ORDER BY date), 6) END AS swing_low, CASE WHEN lag(high, 2) OVER (PARTITION BY symbol ORDER BY date) < low THEN 1 WHEN lag(low, 2) OVER (PARTITION BY symbol ORDER BY date) > high THEN -1 ELSE 0 END AS gap FROM ev"
)
def swings_and_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.event_bars(spark, sf_dir)
    gap = F.when(w.lag(COL("high"), 2) < COL("low"), 1).when(w.lag(COL("low"), 2) > COL("high"), -1).otherwise(0)
    return p.select("symbol", day(), r6(w.swing(COL("high"), 2, True), "swing_high"), r6(w.swing(COL("low"), 2, False), "swing_low"), gap.alias("gap"))


_FFD = w.fractional_weights(0.4)


@query(
    f"WITH {SEG}, k AS (SELECT symbol, date, list(ln(close)) {past(len(_FFD))} AS x FROM seg) SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN len(x) = {len(_FFD)} THEN round(list_sum(list_transform(list_zip(x, {_FFD[::-1]}), lambda z: z[1] * z[2])), 5) END AS ffd FROM k"
)
def fractional_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.segment_prices(spark, sf_dir)
    return p.select("symbol", day(), r6(w.fractional_difference(F.ln("close"), _FFD), "ffd", 5))


@query(f"WITH {NAT} SELECT symbol, CAST(date AS VARCHAR) AS date, round((rank() OVER (PARTITION BY date ORDER BY amount) + (count(*) OVER (PARTITION BY date, amount) - 1) / 2.0) / count(*) OVER (PARTITION BY date), 6) AS pct FROM nat")
def percentile_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.nation_flow(spark, sf_dir).select("symbol", day(), r6(w.rank_pct(COL("amount"), ["date"]), "pct"))


@query(f"WITH {SEG}, g AS (SELECT s.symbol, d.date, p.close FROM (SELECT DISTINCT symbol FROM seg) s, (SELECT DISTINCT date FROM seg) d LEFT JOIN seg p ON p.symbol = s.symbol AND p.date = d.date) SELECT symbol, CAST(date AS VARCHAR) AS date, round(last_value(close IGNORE NULLS) OVER (PARTITION BY symbol ORDER BY date ROWS UNBOUNDED PRECEDING), 4) AS filled FROM g")
def forward_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.densify(panels.segment_prices(spark, sf_dir)).select("symbol", day(), r6(w.forward_fill(COL("close")), "filled", 4))


@query("SELECT event_type AS symbol, CAST(CAST(ts AS DATE) AS VARCHAR) AS date, round(ln(arg_max(value, ts)) - ln(arg_min(value, ts)), 6) AS morning FROM events WHERE hour(ts) < 12 AND value > 0 GROUP BY 1, 2 HAVING count(*) >= 2")
def morning_return(spark: SparkSession, sf_dir: str) -> DataFrame:
    bars = table(spark, sf_dir, "events").select(COL("event_type").alias("symbol"), "ts", COL("value").alias("close"))
    return library.morning_return(bars).select("symbol", day(), r6("morning", "morning"))


# ---- gates -----------------------------------------------------------------------------------------------------


@query(f"WITH {NAT}, k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC NULLS LAST, symbol) AS r, count(*) OVER (PARTITION BY date) AS n FROM nat) SELECT symbol, CAST(date AS VARCHAR) AS date, r <= 3 AS top_3, r <= greatest(1, n * 0.2) AS top_20_pct FROM k")
def rank_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.nation_flow(spark, sf_dir)
    r = w.rank_first(COL("amount"), ["date"])
    return p.select("symbol", day(), (r <= 3).alias("top_3"), (r <= F.greatest(F.lit(1.0), F.count("amount").over(W.partitionBy("date")) * 0.2)).alias("top_20_pct"))


@query(f"WITH {NAT}, m AS (SELECT *, CASE WHEN count(amount) {past(20)} >= 10 THEN median(amount) {past(20)} END AS med FROM nat), k AS (SELECT *, row_number() OVER (PARTITION BY date ORDER BY med DESC NULLS LAST, symbol) AS r FROM m) SELECT symbol, CAST(date AS VARCHAR) AS date, med IS NOT NULL AND r <= 5 AS liquid FROM k")
def liquidity_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.nation_flow(spark, sf_dir).withColumn("med", w.median(COL("amount"), 20, 10))
    return p.select("symbol", day(), F.coalesce(w.rank_first(COL("med"), ["date"]) <= 5, F.lit(False)).alias("liquid"))


@query(
    f"WITH {NAT}, m AS (SELECT *, ln(close) - lag(ln(close), 5) OVER (PARTITION BY symbol ORDER BY date) AS r FROM nat), i AS (SELECT date, industry, avg(r) AS a, min(symbol) AS s FROM m WHERE r IS NOT NULL GROUP BY 1, 2), k AS (SELECT date, industry, row_number() OVER (PARTITION BY date ORDER BY a DESC, s) AS n FROM i) SELECT m.symbol, CAST(m.date AS VARCHAR) AS date, coalesce(n <= 2, false) AND r IS NOT NULL AS strong, r IS NOT NULL AND row_number() OVER (PARTITION BY m.date, m.industry ORDER BY r DESC NULLS LAST, m.symbol) <= greatest(1, count(r) OVER (PARTITION BY m.date, m.industry) * 0.3) AS leader FROM m LEFT JOIN k USING (date, industry)"
)
def industry_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of the two strongest industries, and leaders inside each."""
    m = panels.nation_flow(spark, sf_dir).withColumn("r", w.log_return(COL("close"), 5))
    i = m.where("r is not null").groupBy("date", "industry").agg(F.avg("r").alias("a"), F.min("symbol").alias("s"))
    k = i.withColumn("n", F.row_number().over(W.partitionBy("date").orderBy(F.desc("a"), "s"))).select("date", "industry", "n")
    j = m.join(k, ["date", "industry"], "left")
    lead = w.rank_first(COL("r"), ["date", "industry"]) <= F.greatest(F.lit(1.0), F.count("r").over(W.partitionBy("date", "industry")) * 0.3)
    return j.select("symbol", day(), (F.coalesce(COL("n") <= 2, F.lit(False)) & COL("r").isNotNull()).alias("strong"), F.coalesce(lead, F.lit(False)).alias("leader"))


@query(
    f"WITH {EV}, m AS (SELECT *, close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r, close - lag(close) OVER (PARTITION BY symbol ORDER BY date) AS d FROM ev), b AS (SELECT date, count(*) FILTER (d > 0) / nullif(count(d), 0) >= 0.45 AS breadth FROM m GROUP BY 1) SELECT symbol, CAST(date AS VARCHAR) AS date, coalesce(CASE WHEN count(volume) {past(5, 1)} >= 2 THEN volume / avg(volume) {past(5, 1)} END >= 1.0, false) AS confirmed, coalesce(r <= 0.5, false) AS calm, coalesce(breadth, false) AS breadth FROM m JOIN b USING (date)"
)
def market_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Volume confirmation, no climax, and market breadth spread over all symbols by a window instead of a join."""
    p = panels.event_bars(spark, sf_dir).withColumn("d", COL("close") - w.lag(COL("close")))
    by = W.partitionBy("date")
    rise = F.sum(F.when(COL("d") > 0, 1).otherwise(0)).over(by) / F.nullif(F.count("d").over(by), F.lit(0))
    no = F.lit(False)
    return p.select("symbol", day(), F.coalesce(COL("volume") / w.mean(COL("volume"), 5, 1, 2) >= 1.0, no).alias("confirmed"), F.coalesce(COL("close") / w.lag(COL("close"), 3) - 1 <= 0.5, no).alias("calm"), F.coalesce(rise >= 0.45, no).alias("breadth"))


# ---- as-of and intervals ---------------------------------------------------------------------------------------


@query("WITH f AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) + 1 AS t, o_orderkey, CASE WHEN o_orderkey % 4 = 0 THEN NULL ELSE o_totalprice END AS v FROM orders) SELECT symbol, round(arg_max(v, (t, o_orderkey)) FILTER (v IS NOT NULL), 2) AS value FROM f WHERE t <= DATE '1998-01-01' GROUP BY 1")
def fundamental_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last known value that is not null at a date: null fields fall through to older reports."""
    f = table(spark, sf_dir, "orders").select(COL("o_custkey").alias("symbol"), F.date_add(F.to_date("o_orderdate"), 1).alias("t"), "o_orderkey", F.when(COL("o_orderkey") % 4 != 0, COL("o_totalprice")).alias("v")).where("t <= DATE '1998-01-01'")
    return f.groupBy("symbol").agg(F.max_by("v", F.when(COL("v").isNotNull(), F.struct("t", "o_orderkey"))).alias("v")).select("symbol", r6("v", "value", 2))


@query("WITH q AS (SELECT o_custkey AS symbol, year(o_orderdate) AS y, sum(o_totalprice) FILTER (quarter(o_orderdate) <= 2) AS half, sum(o_totalprice) AS whole FROM orders GROUP BY 1, 2) SELECT a.symbol, a.y AS fiscal_year, round(a.half + b.whole - b.half, 2) AS ttm FROM q a JOIN q b ON a.symbol = b.symbol AND b.y = a.y - 1 WHERE a.half IS NOT NULL AND b.half IS NOT NULL")
def trailing_twelve_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    q = o.groupBy(COL("o_custkey").alias("symbol"), F.year("o_orderdate").cast("long").alias("y")).agg(F.sum(F.when(F.quarter("o_orderdate") <= 2, COL("o_totalprice"))).alias("half"), F.sum("o_totalprice").alias("whole"))
    b = q.select("symbol", (COL("y") + 1).alias("y"), COL("half").alias("h0"), COL("whole").alias("w0"))
    return q.join(b, ["symbol", "y"]).where("half is not null and h0 is not null").select("symbol", COL("y").alias("fiscal_year"), r6(COL("half") + COL("w0") - COL("h0"), "ttm", 2))


@query("WITH e AS (SELECT user_id, ts, event_id FROM events WHERE event_type <> 'purchase'), p AS (SELECT user_id, ts, value FROM events WHERE event_type = 'purchase') SELECT e.event_id, round(arg_max(p.value, p.ts), 6) AS last_value FROM e LEFT JOIN p ON p.user_id = e.user_id AND p.ts <= e.ts GROUP BY 1")
def as_of_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    left, right = e.where("event_type <> 'purchase'").select("user_id", "ts", "event_id"), e.where("event_type = 'purchase'").select("user_id", "ts", "value")
    return joins.as_of(left, right, "user_id", "ts", "ts", ["value"]).select("event_id", r6("value", "last_value"))


@query("WITH i AS (SELECT o_orderkey, o_custkey, CAST(o_orderdate AS DATE) AS a, CASE WHEN o_orderkey % 5 = 0 THEN NULL ELSE max(CAST(l_shipdate AS DATE)) END AS z FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1, 2, 3) SELECT DISTINCT o_custkey AS symbol FROM i WHERE a <= DATE '1997-06-01' AND (z IS NULL OR z > DATE '1997-06-01')")
def members_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, l = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    i = o.join(l, o["o_orderkey"] == l["l_orderkey"]).groupBy("o_orderkey", "o_custkey", F.to_date("o_orderdate").alias("a")).agg(F.max(F.to_date("l_shipdate")).alias("z0")).withColumn("z", F.when(COL("o_orderkey") % 5 != 0, COL("z0")))
    return joins.valid_at(i, F.lit("1997-06-01").cast("date"), "a", "z").select(COL("o_custkey").alias("symbol")).distinct()


# ---- samplers and labels ---------------------------------------------------------------------------------------


@query(
    f"WITH {EV}, s AS (SELECT symbol, date, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS g FROM ev), t AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - row_number() OVER (PARTITION BY symbol, g ORDER BY date) AS run FROM s), u AS (SELECT *, row_number() OVER (PARTITION BY symbol, g, run ORDER BY date) AS k FROM t) SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(g AS INTEGER) AS side FROM u WHERE k = 3 AND g <> 0"
)
def run_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The third equal sign in a row, by gaps and islands."""
    s = panels.event_bars(spark, sf_dir).withColumn("g", F.signum(COL("close") - w.lag(COL("close"))))
    t = s.withColumn("run", w.run_number(COL("g")))
    return t.withColumn("k", F.row_number().over(W.partitionBy("symbol", "g", "run").orderBy("date"))).where("k = 3 and g <> 0").select("symbol", day(), COL("g").cast("int").alias("side"))


@query(
    f"WITH RECURSIVE {EV}, x AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, coalesce(ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date), 0) AS d FROM ev WHERE close > 0), c AS (SELECT symbol, date, i, greatest(0, d) AS p, least(0, d) AS n, false AS f FROM x WHERE i = 1 UNION ALL SELECT x.symbol, x.date, x.i, CASE WHEN least(0, n + d) >= -0.5 AND greatest(0, p + d) > 0.5 THEN 0 ELSE greatest(0, p + d) END, CASE WHEN least(0, n + d) < -0.5 THEN 0 ELSE least(0, n + d) END, least(0, n + d) < -0.5 OR greatest(0, p + d) > 0.5 FROM c JOIN x ON x.symbol = c.symbol AND x.i = c.i + 1) SELECT symbol, CAST(date AS VARCHAR) AS date FROM c WHERE f"
)
def cusum_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.cusum_events(panels.event_bars(ship(spark), sf_dir), 0.5).select("symbol", day())


@query(
    f"WITH RECURSIVE {EV}, x AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol ORDER BY date) AS i, coalesce(ln(volume) - lag(ln(volume)) OVER (PARTITION BY symbol ORDER BY date), 0) AS d FROM ev WHERE volume > 0), c AS (SELECT symbol, date, i, greatest(0, d) AS p, least(0, d) AS n, false AS f FROM x WHERE i = 1 UNION ALL SELECT x.symbol, x.date, x.i, CASE WHEN least(0, n + d) >= -0.3 AND greatest(0, p + d) > 0.3 THEN 0 ELSE greatest(0, p + d) END, CASE WHEN least(0, n + d) < -0.3 THEN 0 ELSE least(0, n + d) END, least(0, n + d) < -0.3 OR greatest(0, p + d) > 0.3 FROM c JOIN x ON x.symbol = c.symbol AND x.i = c.i + 1) SELECT symbol, CAST(date AS VARCHAR) AS date FROM c WHERE f"
)
def volume_cusum_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same filter on changes of volume."""
    return paths.cusum_events(panels.event_bars(ship(spark), sf_dir), 0.3, "volume").select("symbol", day())


@query()
def entropy_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.entropy_events(panels.segment_prices(ship(spark), sf_dir)).select("symbol", day())


def _spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = panels.event_bars(spark, sf_dir)
    e = bars.select(F.concat_ws("|", "symbol", F.date_format("date", "yyyyMMdd")).alias("event_id"), "symbol", COL("date").alias("event_start"), F.date_add("date", 4).alias("t1"))
    return e, bars


_SPANS = "sp AS (SELECT symbol || '|' || strftime(date, '%Y%m%d') AS event_id, symbol, date AS event_start, date + 4 AS t1 FROM ev)"
_BARRIER = """path AS (SELECT e.*, b.date, b.close, first_value(b.close) OVER (PARTITION BY e.event_id ORDER BY b.date) AS entry FROM e JOIN ev b ON b.symbol = e.symbol AND b.date BETWEEN e.event_start AND e.t1),
 rr AS (SELECT *, (close / entry - 1) * coalesce(side, 1) AS r FROM path),
 agg AS (SELECT event_id, symbol, event_start, t1, target, side, min(date) FILTER (r >= {pt} * target) AS up, min(date) FILTER (r <= -{sl} * target) AS down, count(*) AS n FROM rr GROUP BY ALL),
 tt AS (SELECT *, least(up, down, t1) AS touch FROM agg),
 lab AS (SELECT tt.*, CASE WHEN n < 2 THEN 'no_data' WHEN up = touch THEN 'upper' WHEN down = touch THEN 'lower' ELSE 'vertical' END AS kind, coalesce((SELECT any_value(r) FROM rr WHERE rr.event_id = tt.event_id AND rr.date = touch), (SELECT arg_max(r, date) FROM rr WHERE rr.event_id = tt.event_id)) AS ret FROM tt)"""


@query(
    f"WITH {EV}, e AS (SELECT symbol || '|' || strftime(date, '%Y%m%d') AS event_id, symbol, date AS event_start, date + 4 AS t1, 0.3 AS target, CAST(NULL AS DOUBLE) AS side FROM ev), {_BARRIER.format(pt=2, sl=1)} SELECT event_id, CAST(touch AS VARCHAR) AS touch_date, kind AS touch_type, CASE WHEN kind <> 'no_data' THEN round(ret, 6) END AS ret, CASE kind WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END AS bin FROM lab"
)
def triple_barrier(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, bars = _spans(spark, sf_dir)
    got = labels.triple_barrier(e.withColumn("target", F.lit(0.3)).withColumn("side", F.lit(None).cast("double")), bars, 2, 1)
    return got.select("event_id", F.date_format("touch_time", "yyyy-MM-dd").alias("touch_date"), "touch_type", r6("ret", "ret"), "bin")


@query(
    f"WITH {EV}, m AS (SELECT symbol, date, ln(close) - lag(ln(close), 5) OVER (PARTITION BY symbol ORDER BY date) AS m FROM ev), k AS (SELECT symbol, date FROM m WHERE m IS NOT NULL QUALIFY row_number() OVER (PARTITION BY date ORDER BY m DESC, symbol) <= greatest(1, count(*) OVER (PARTITION BY date) * 0.4)), c AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM (SELECT DISTINCT date FROM ev)), e AS (SELECT k.symbol || '|' || strftime(k.date, '%Y%m%d') AS event_id, k.symbol, c2.date AS event_start, c3.date AS t1, 0.2 AS target, CAST(NULL AS DOUBLE) AS side FROM k JOIN c c1 ON c1.date = k.date JOIN c c2 ON c2.seq = c1.seq + 1 JOIN c c3 ON c3.seq = c1.seq + 6), {_BARRIER.format(pt=1.5, sl=1)} SELECT kind AS touch_type, count(*) AS n, round(avg(ret), 6) AS mean_ret FROM lab GROUP BY 1"
)
def momentum_barrier_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Momentum, top share by day, entry at the next session, barriers, mix of outcomes: the whole chain without user code."""
    bars = panels.event_bars(spark, sf_dir)
    m = bars.withColumn("m", w.log_return(COL("close"), 5)).where("m is not null")
    by = W.partitionBy("date")
    picks = m.withColumn("r", w.rank_first(COL("m"), ["date"])).withColumn("k", F.greatest(F.lit(1.0), F.count("m").over(by) * 0.4)).where("r <= k").select("symbol", "date")
    c = panels.calendar(bars)
    step = lambda n, name: c.select(COL("date").alias(name), (COL("seq") - n).alias("seq"))
    e = picks.join(c, "date").join(step(1, "event_start"), "seq").join(step(6, "t1"), "seq")
    e = e.select(F.concat_ws("|", "symbol", F.date_format("date", "yyyyMMdd")).alias("event_id"), "symbol", "event_start", "t1", F.lit(0.2).alias("target"), F.lit(None).cast("double").alias("side"))
    got = labels.triple_barrier(e, bars, 1.5, 1)
    return got.groupBy("touch_type").agg(F.count("*").alias("n"), F.round(F.avg("ret"), 6).alias("mean_ret"))


@query(f"WITH {EV}, c AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM (SELECT DISTINCT date FROM ev WHERE isodow(date) < 6)) SELECT CAST(d.date AS VARCHAR) AS date, CAST((SELECT c.date FROM c WHERE c.seq = (SELECT count(*) FROM c WHERE c.date <= d.date) + 2) AS VARCHAR) AS entry FROM (SELECT DISTINCT date FROM ev) d")
def next_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = panels.event_bars(spark, sf_dir).select("date").distinct()
    got = joins.sessions_after(days, days.where(F.weekday("date") < 5), "date", 2, "entry")
    return got.select(day(), F.date_format("entry", "yyyy-MM-dd").alias("entry"))


# ---- weights and cross-validation ------------------------------------------------------------------------------


@query(f"WITH {EV}, {_SPANS} SELECT ev.symbol, CAST(ev.date AS VARCHAR) AS date, count(sp.event_id) AS c FROM ev LEFT JOIN sp ON sp.symbol = ev.symbol AND ev.date BETWEEN sp.event_start AND sp.t1 GROUP BY 1, 2")
def concurrency(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, bars = _spans(spark, sf_dir)
    return labels.concurrency(e, bars).select("symbol", day(), "c")


_UNIQ = f"{_SPANS}, cc AS (SELECT ev.symbol, ev.date, count(sp.event_id) AS c FROM ev LEFT JOIN sp ON sp.symbol = ev.symbol AND ev.date BETWEEN sp.event_start AND sp.t1 GROUP BY 1, 2), lr AS (SELECT symbol, date, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol ORDER BY date) AS r FROM ev), un AS (SELECT sp.event_id, sp.event_start, avg(1.0 / nullif(c, 0)) AS u, abs(sum(r / nullif(c, 0))) AS a FROM sp JOIN cc ON cc.symbol = sp.symbol AND cc.date BETWEEN sp.event_start AND sp.t1 JOIN lr ON lr.symbol = cc.symbol AND lr.date = cc.date GROUP BY 1, 2)"


@query(f"WITH {EV}, {_UNIQ} SELECT event_id, round(u, 6) AS uniqueness, round(a, 6) AS attribution, round(a * count(*) OVER () / sum(a) OVER (), 6) AS weight FROM un")
def uniqueness_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, bars = _spans(spark, sf_dir)
    u = labels.normalise(labels.uniqueness(e, bars).withColumn("weight", COL("attribution")), "weight")
    return u.select("event_id", r6("uniqueness", "uniqueness"), r6("attribution", "attribution"), r6("weight", "weight"))


@query(f"WITH {EV}, {_UNIQ}, d AS (SELECT event_id, sum(u) OVER (ORDER BY event_start, event_id ROWS UNBOUNDED PRECEDING) AS c, sum(u) OVER () AS t FROM un) SELECT event_id, round(greatest(0, 1 - (0.5 / t) * t + (0.5 / t) * c), 6) AS decay FROM d")
def decay_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, bars = _spans(spark, sf_dir)
    return labels.time_decay(labels.uniqueness(e, bars), 0.5).select("event_id", r6("decay", "decay"))


@query(
    f"WITH {EV}, {_SPANS}, b AS (SELECT *, row_number() OVER (ORDER BY event_start, event_id) - 1 AS i, count(*) OVER () AS n FROM sp), f AS (SELECT *, CASE WHEN i < (n // 4 + 1) * (n % 4) THEN i // (n // 4 + 1) ELSE n % 4 + (i - (n // 4 + 1) * (n % 4)) // (n // 4) END AS fold FROM b), s AS (SELECT fold, min(event_start) AS lo, max(t1) AS hi, any_value(n) AS n FROM f GROUP BY 1), r AS (SELECT s.*, coalesce((SELECT min(i) FROM f WHERE f.event_start > s.hi), s.n) AS rgt FROM s) SELECT CAST(r.fold AS INTEGER) AS fold, f.event_id, CASE WHEN f.fold = r.fold THEN 'test' ELSE 'train' END AS part FROM r, f WHERE f.fold = r.fold OR f.t1 < r.lo OR f.i >= r.rgt + floor(r.n * 0.02)"
)
def purged_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.purged_folds(_spans(spark, sf_dir)[0], 4, 0.02)


# ---- evaluation, allocation, sizing ----------------------------------------------------------------------------

_R = "rt AS (SELECT symbol, date, close / lag(close) OVER (PARTITION BY symbol ORDER BY date) - 1 AS r FROM seg)"


def _returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.segment_prices(spark, sf_dir).select("symbol", "date", (COL("close") / w.lag(COL("close")) - 1).alias("r")).where("r is not null")


@query(f"WITH {SEG}, {_R} SELECT symbol, round(avg(r) / stddev_samp(r), 6) AS sharpe, round(avg(r) / stddev_samp(r) * sqrt(252), 5) AS annual, round((sum(r * r) / (sum(r) * sum(r)) - 1.0 / count(r)) / (1 - 1.0 / count(r)), 7) AS hhi FROM rt WHERE r IS NOT NULL GROUP BY 1")
def sharpe_and_hhi(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = _returns(spark, sf_dir)
    return stats.sharpe(r, ["symbol"]).join(stats.hhi(r, ["symbol"]), "symbol").select("symbol", r6("sharpe", "sharpe"), r6("annual", "annual", 5), r6("hhi", "hhi", 7))


@query(f"WITH {SEG}, {_R}, q AS (SELECT symbol, r, avg(r) OVER (PARTITION BY symbol) AS m, stddev_samp(r) OVER (PARTITION BY symbol) AS s FROM rt WHERE r IS NOT NULL) SELECT symbol, count(*) AS n, round(avg(pow(r - m, 3)) / pow(any_value(s), 3), 5) AS skew, round(avg(pow(r - m, 4)) / pow(any_value(s), 4), 5) AS kurt FROM q GROUP BY 1")
def return_moments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.moments(_returns(spark, sf_dir), ["symbol"]).select("symbol", "n", r6("skew", "skew", 5), r6("kurt", "kurt", 5))


@query(f"WITH {SEG}, h AS (SELECT symbol, date, close AS nav, max(close) OVER (PARTITION BY symbol ORDER BY date) AS hwm FROM seg), m AS (SELECT symbol, hwm, min(nav) AS low, min(date) AS start FROM h GROUP BY 1, 2 HAVING hwm > min(nav)) SELECT symbol, round(hwm, 4) AS hwm, CAST(start AS VARCHAR) AS date, round(1 - low / hwm, 6) AS drawdown, round((lead(start) OVER (PARTITION BY symbol ORDER BY start) - start) / 365.25, 6) AS tuw FROM m")
def drawdown_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = stats.drawdowns(panels.segment_prices(spark, sf_dir).withColumn("nav", COL("close")))
    return d.select("symbol", r6("hwm", "hwm", 4), day("start"), r6("drawdown", "drawdown"), r6("tuw", "tuw"))


@query("WITH m AS (SELECT c_mktsegment AS symbol, date_trunc('month', o_orderdate) AS mo, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2), b AS (SELECT symbol, CAST(min(mo) AS DATE) AS lo, CAST(max(mo) AS DATE) AS hi FROM m GROUP BY 1), g AS (SELECT symbol, unnest(generate_series(lo, hi, INTERVAL 1 MONTH)) AS mo FROM b), f AS (SELECT g.symbol, coalesce(n, 0) AS n FROM g LEFT JOIN m ON m.symbol = g.symbol AND m.mo = g.mo) SELECT symbol, round((sum(n * n) / (sum(n) * sum(n)) - 1.0 / count(*)) / (1 - 1.0 / count(*)), 8) AS hhi FROM f GROUP BY 1 HAVING count(*) > 2")
def bets_in_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Concentration of bets over months; months without bets count as zero."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    m = o.join(c, o["o_custkey"] == c["c_custkey"]).groupBy(COL("c_mktsegment").alias("symbol"), F.trunc("o_orderdate", "month").alias("mo")).agg(F.count("*").alias("n"))
    g = m.groupBy("symbol").agg(F.min("mo").alias("lo"), F.max("mo").alias("hi")).select("symbol", F.explode(F.expr("sequence(lo, hi, interval 1 month)")).alias("mo"))
    f = g.join(m, ["symbol", "mo"], "left").select("symbol", F.coalesce("n", F.lit(0)).cast("double").alias("r"))
    return stats.hhi(f, ["symbol"]).where("hhi is not null").select("symbol", r6("hhi", "hhi", 8))


@query(f"WITH {SEG}, {_R}, v AS (SELECT symbol, 1 / var_samp(r) AS iv FROM rt WHERE r IS NOT NULL GROUP BY 1) SELECT symbol, round(iv / sum(iv) OVER (), 8) AS weight FROM v")
def inverse_variance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.inverse_variance(_returns(spark, sf_dir)).select("symbol", r6("weight", "weight", 8))


@query(f"WITH {SEG}, {_R} SELECT x.symbol AS a, y.symbol AS b, round(covar_samp(x.r, y.r), 6) AS cov, round(corr(x.r, y.r), 6) AS corr FROM rt x JOIN rt y ON x.date = y.date WHERE x.r IS NOT NULL AND y.r IS NOT NULL GROUP BY 1, 2")
def covariance_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return stats.covariance(_returns(spark, sf_dir)).select("a", "b", r6("cov", "cov"), r6("corr", "corr"))


@query()
def hierarchical_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The matrix of at most ``stats.MOST_ASSETS`` assets goes to the driver, as its linkage is sequential."""
    import numpy as np

    r = _returns(spark, sf_dir)
    if (n := r.select("symbol").distinct().count()) > stats.MOST_ASSETS:
        raise ValueError(f"{n} assets; their matrix goes to the driver, so at most {stats.MOST_ASSETS}")
    m = stats.covariance(r).toPandas()
    names = sorted(set(m["a"]))
    cov, corr = (m.pivot(index="a", columns="b", values=c).loc[names, names].to_numpy() for c in ("cov", "corr"))
    weight = stats.hierarchical_parity(np.nan_to_num(cov), np.nan_to_num(corr))
    return spark.createDataFrame(list(zip(names, (round(float(x), 8) for x in weight))), "symbol string, weight double")


@query(
    f"WITH {EV}, s AS (SELECT symbol, date AS a, CASE WHEN day(date) % 7 = 0 THEN NULL ELSE date + 3 END AS z, (volume % 11 - 5) / 5.0 AS g FROM ev), t AS (SELECT DISTINCT symbol, a AS t FROM s UNION SELECT symbol, z FROM s WHERE z IS NOT NULL) SELECT t.symbol, CAST(t.t AS VARCHAR) AS date, round(coalesce(avg(g), 0), 6) + 0e0 AS signal FROM t LEFT JOIN s ON s.symbol = t.symbol AND s.a <= t.t AND (s.z IS NULL OR t.t < s.z) GROUP BY 1, 2"
)
def active_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.event_bars(spark, sf_dir)
    s = p.select("symbol", COL("date").alias("start"), F.when(F.dayofmonth("date") % 7 != 0, F.date_add("date", 3)).alias("t1"), ((COL("volume") % 11 - 5) / 5.0).alias("signal"))
    return stats.active_signals(s).select("symbol", day("t"), (F.round("signal", 6) + 0.0).alias("signal"))


@query(f"WITH {EV} SELECT symbol, CAST(date AS VARCHAR) AS date, round(greatest(-1, least(1, round_even((close / vwap - 1) / 0.25, 0) * 0.25)), 6) AS size, CAST(trunc((vwap - close) / sqrt(100 + (vwap - close) * (vwap - close)) * 50) AS INTEGER) AS position FROM ev WHERE vwap > 0")
def position_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.event_bars(spark, sf_dir).where("vwap > 0")
    return p.select("symbol", day(), r6(stats.discretise(COL("close") / COL("vwap") - 1, 0.25), "size"), stats.target_position(F.lit(100.0), COL("vwap"), COL("close"), 50).alias("position"))


from .queries import evaluation, gating, market, modelling, research, rules, storage, trends  # noqa: E402,F401
