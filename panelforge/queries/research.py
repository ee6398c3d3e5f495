"""Queries of sessions, universes, facts, features, samples and sizing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import COL, EV, NAT, SEG, day, past, query, r6
from ..features import library, registry
from ..functions import stats
from ..operators import facts, gates, labels, paths, samples, universe
from ..operators import windows as w
from ..plans import panels, sessions
from ..session import ship, table

BY = "OVER (PARTITION BY symbol ORDER BY date)"


def dated(c: str, name: str):
    return F.date_format(c, "yyyy-MM-dd").alias(name)


# ---- sessions ---------------------------------------------------------------------------------------------------

_STEPS = {"prev_1": -1, "prev_3": -3, "next_0": 0, "next_1": 1, "next_3": 3}
_DAYS = "d AS (SELECT DISTINCT CAST(ts AS DATE) AS date FROM events), c AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM d WHERE isodow(date) < 6)"


@query(f"WITH {_DAYS}, p AS (SELECT d.date, (SELECT count(*) FROM c WHERE c.date <= d.date) AS place, isodow(d.date) < 6 AS open FROM d) SELECT CAST(date AS VARCHAR) AS date, open AS is_session, place AS sessions_so_far, CAST(date AS VARCHAR) AS next_0, " + ", ".join(f"CAST((SELECT c.date FROM c WHERE c.seq = p.place {'+' if n > 0 else '-'} {abs(n)}{'' if n > 0 else ' + CASE WHEN open THEN 0 ELSE 1 END'}) AS VARCHAR) AS {k}" for k, n in _STEPS.items() if n) + " FROM p")
def calendar_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Membership, counts and steps along the weekdays."""
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    own = days.where(F.weekday("date") < 5)
    out = days.join(sessions.places(days, own), "date")
    for name, n in _STEPS.items():
        out = sessions.step(out, own, "date", n, name)
    return out.select(day(), "is_session", COL("at").alias("sessions_so_far"), *(dated(k, k) for k in _STEPS))


@query(f"WITH {_DAYS} SELECT CAST(date AS VARCHAR) AS date FROM c WHERE date BETWEEN DATE '2024-01-05' AND DATE '2024-03-15'")
def session_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).where(F.weekday("date") < 5)
    return sessions.between(days, datetime.date(2024, 1, 5), datetime.date(2024, 3, 15)).select(day())


@query(f"WITH {_DAYS} SELECT CAST(date AS VARCHAR) AS date, " + ", ".join(f"strftime(date + INTERVAL {m} MINUTE, '%Y-%m-%d %H:%M') AS {k}" for k, m in sessions.TIMES.items()) + " FROM d")
def session_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = table(spark, sf_dir, "events").select(F.to_date("ts").alias("date")).distinct()
    return sessions.times(days).select(day(), *(F.date_format(k, "yyyy-MM-dd HH:mm").alias(k) for k in sessions.TIMES))


# ---- universes --------------------------------------------------------------------------------------------------

_CODES = "list_value('430', '833', '688', '600', '000', '920')[c_custkey % 6 + 1] || lpad(CAST(c_custkey % 1000 AS VARCHAR), 3, '0') || list_value('.SH', '.sz', '.BJ', '', '.XSHG')[c_custkey % 5 + 1]"


@query(f"WITH s AS (SELECT c_custkey, {_CODES} AS symbol FROM customer), b AS (SELECT *, upper(symbol) LIKE '%.BJ' OR substr(symbol, 1, 2) IN ('43', '83', '87', '92') AS northern, substr(symbol, 1, 3) = '688' AND (symbol NOT LIKE '%.%' OR split_part(upper(symbol), '.', 2) IN ('SH', 'XSHG')) AS growth FROM s) SELECT c_custkey, symbol, northern, growth, NOT northern AND NOT growth AS main_a, NOT northern AS hs_a FROM b")
def board_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boards by code, and what the broad universes keep of them."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (COL("c_custkey") % n + 1).cast("int"))
    code = F.concat(pick(["430", "833", "688", "600", "000", "920"], 6), F.lpad((COL("c_custkey") % 1000).cast("string"), 3, "0"), pick([".SH", ".sz", ".BJ", "", ".XSHG"], 5))
    s = table(spark, sf_dir, "customer").select("c_custkey", code.alias("symbol"))
    out = s.select("*", universe.is_northern(COL("symbol")).alias("northern"), universe.is_growth(COL("symbol")).alias("growth"))
    for spec in universe.BROAD:
        kept = universe.filter_boards(s, growth=not universe.broad(spec)[0]).select("c_custkey", F.lit(True).alias(spec))
        out = out.join(kept, "c_custkey", "left").withColumn(spec, F.coalesce(spec, F.lit(False)))
    return out


_UNI = "u AS (SELECT date, symbol, CASE WHEN r <= 10 THEN amount / 1000 END AS weight FROM (SELECT *, row_number() OVER (PARTITION BY date ORDER BY amount DESC, symbol) AS r FROM nat) WHERE r <= 12)"


def _universe(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    nat = panels.nation_flow(spark, sf_dir)
    u = nat.withColumn("r", w.rank_first(COL("amount"), ["date"])).where("r <= 12").select("date", "symbol", F.when(COL("r") <= 10, COL("amount") / 1000).alias("weight"))
    return u, nat


@query(f"WITH {NAT}, {_UNI}, m AS (SELECT symbol, date, volume >= 50 AS ok FROM nat) SELECT u.symbol, CAST(u.date AS VARCHAR) AS date, round(weight / nullif(sum(weight) OVER (PARTITION BY u.date), 0), 8) AS weight FROM u JOIN m ON m.symbol = u.symbol AND m.date = u.date AND m.ok")
def universe_intersection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members that pass a mask, with weights that sum to one again."""
    u, nat = _universe(spark, sf_dir)
    return universe.intersect(u, nat.select("symbol", "date", (COL("volume") >= 50).alias("ok"))).select("symbol", day(), r6("weight", "weight", 8))


@query(f"WITH {NAT}, {_UNI} SELECT symbol, round(weight, 4) AS weight, weight IS NOT NULL AS weighted FROM u WHERE date = DATE '1995-06-01'")
def universe_on_a_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    import datetime

    u, _ = _universe(spark, sf_dir)
    at = datetime.date(1995, 6, 1)
    both = universe.members(u, at).join(universe.weights(u, at), "symbol", "left")
    return both.select("symbol", r6("weight", "weight", 4), COL("weight").isNotNull().alias("weighted"))


@query(f"WITH {NAT}, {_UNI} SELECT CAST(min(date) AS VARCHAR) AS first, CAST(max(date) AS VARCHAR) AS last, count(DISTINCT symbol) AS symbols FROM u")
def universe_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return universe.span(_universe(spark, sf_dir)[0]).select(dated("first", "first"), dated("last", "last"), "symbols")


@query(f"WITH {NAT} SELECT symbol, CAST(date AS VARCHAR) AS date, round(amount, 4) AS amount FROM nat QUALIFY row_number() OVER (PARTITION BY date ORDER BY amount DESC, symbol) <= 12")
def universe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    u, nat = _universe(spark, sf_dir)
    return universe.only_members(nat, u).select("symbol", day(), r6("amount", "amount", 4))


# ---- facts ------------------------------------------------------------------------------------------------------

_REPORTS = """rep AS (SELECT o_custkey AS symbol, CAST(o_orderdate AS DATE) AS report_period, list_value('official', 'flash', 'forecast')[o_orderkey % 3 + 1] AS report_type, CAST(o_orderdate AS DATE) + 30 AS available_at,
 max(CASE WHEN o_orderkey % 4 <> 0 THEN o_totalprice END) AS profit, max(CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice * 3 END) AS equity FROM orders GROUP BY 1, 2, 3, 4)"""


def _reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, key = table(spark, sf_dir, "orders"), COL("o_orderkey")
    kind = F.element_at(F.array(*map(F.lit, ("official", "flash", "forecast"))), (key % 3 + 1).cast("int"))
    r = o.groupBy(COL("o_custkey").alias("symbol"), F.to_date("o_orderdate").alias("report_period"), kind.alias("report_type"))
    return r.agg(F.max(F.when(key % 4 != 0, COL("o_totalprice"))).alias("profit"), F.max(F.when(key % 7 != 0, COL("o_totalprice") * 3)).alias("equity")).withColumn("available_at", F.date_add("report_period", 30))


_RANKED = "(report_period, CASE report_type WHEN 'official' THEN 3 WHEN 'flash' THEN 2 ELSE 1 END)"


@query(f"WITH {_REPORTS} SELECT symbol, round(arg_max(profit, {_RANKED}) FILTER (profit IS NOT NULL), 2) AS profit, round(arg_max(equity, {_RANKED}) FILTER (equity IS NOT NULL), 2) AS equity FROM rep WHERE available_at <= DATE '1998-01-01' GROUP BY 1")
def fundamentals_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each field falls through its nulls to older periods and lower kinds of report on its own."""
    got = facts.latest_as_of(_reports(spark, sf_dir), ["profit", "equity"], F.lit("1998-01-01").cast("date"))
    return got.select("symbol", r6("profit", "profit", 2), r6("equity", "equity", 2))


_QUARTERS = """q AS (SELECT o_custkey AS symbol, year(o_orderdate) AS fiscal_year, quarter(o_orderdate) AS fiscal_quarter, max(CAST(o_orderdate AS DATE)) AS report_period, max(CAST(o_orderdate AS DATE)) + 20 AS available_at, CASE WHEN count(*) % 5 <> 0 THEN sum(o_totalprice) END AS v FROM orders GROUP BY 1, 2, 3)"""


def _quarters(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    q = o.groupBy(COL("o_custkey").alias("symbol"), F.year("o_orderdate").alias("fiscal_year"), F.quarter("o_orderdate").alias("fiscal_quarter")).agg(F.max(F.to_date("o_orderdate")).alias("report_period"), F.when(F.count("*") % 5 != 0, F.sum("o_totalprice")).alias("profit"))
    return q.withColumn("available_at", F.date_add("report_period", 20)).withColumn("report_type", F.lit("official"))


@query(f"WITH {_QUARTERS}, k AS (SELECT * FROM q WHERE available_at <= DATE '1997-09-15'), l AS (SELECT symbol, arg_max((fiscal_year, fiscal_quarter, v), report_period) AS n FROM k GROUP BY 1) SELECT l.symbol, round(CASE WHEN n[2] = 4 THEN n[3] ELSE n[3] + (SELECT max(v) FROM k WHERE k.symbol = l.symbol AND fiscal_year = n[1] - 1 AND fiscal_quarter = 4) - (SELECT max(v) FROM k WHERE k.symbol = l.symbol AND fiscal_year = n[1] - 1 AND fiscal_quarter = n[2]) END, 2) AS ttm FROM l")
def ttm_as_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Twelve months up to the newest report, with the rules of fourth quarters and absent parts."""
    return facts.trailing_year(_quarters(spark, sf_dir), "profit", F.lit("1997-09-15").cast("date")).select("symbol", r6("value", "ttm", 2))


# ---- features ---------------------------------------------------------------------------------------------------


_KINDS = "list_value('today_open', 'today_close', 'next_open')[volume % 3 + 1]"


@query(f"WITH {EV}, k AS (SELECT symbol, date, {_KINDS} AS known FROM ev) SELECT symbol, CAST(date AS VARCHAR) AS date, known, CASE WHEN known = 'today_open' THEN 0 ELSE 1 END AS shift_open, CASE WHEN known = 'next_open' THEN 1 ELSE 0 END AS shift_close FROM k")
def feature_shift_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By how many bars a value known at its time is moved for an entry at the open and at the close."""
    known = F.element_at(F.array(*map(F.lit, registry.KNOWN)), (COL("volume") % 3 + 1).cast("int"))
    moved = lambda entry: F.coalesce(*(F.when(COL("known") == k, registry.shift_days(k, entry)) for k in registry.KNOWN)).alias(f"shift_{entry}")
    return panels.event_bars(spark, sf_dir).select("symbol", "date", known.alias("known")).select("symbol", day(), "known", *map(moved, registry.ENTRY))


_WIDE = """g AS (SELECT s.symbol, d.date, p.close, p.volume, p.amount FROM (SELECT DISTINCT symbol FROM seg) s CROSS JOIN (SELECT DISTINCT date FROM seg) d LEFT JOIN seg p ON p.symbol = s.symbol AND p.date = d.date),
 pn AS (SELECT *, 40 + date_part('day', date) AS float_shares, 90 + date_part('month', date) AS total_shares, CASE WHEN date_part('day', date) % 9 <> 0 THEN 1009.7 * (date_part('day', date) - 15) / 7 END AS profit_ttm, 5003.7 + date_part('year', date) AS equity, close * 1.01 AS auction_price, volume % 3 AS auction_volume FROM g)"""


def _wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense panel with stand-ins for what the source tables lack."""
    p, d = panels.densify(panels.segment_prices(spark, sf_dir)), F.dayofmonth("date")
    return p.select("*", (40 + d).alias("float_shares"), (90 + F.month("date")).alias("total_shares"), F.when(d % 9 != 0, 1009.7 * (d - 15) / 7).alias("profit_ttm"), (5003.7 + F.year("date")).alias("equity"), (COL("close") * 1.01).alias("auction_price"), (COL("volume") % 3).alias("auction_volume"))


@query(f"WITH {SEG}, {_WIDE} SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN count(volume) {past(5)} = 5 THEN round(avg(volume / CAST(float_shares AS DOUBLE)) {past(5)}, 6) END AS turnover_5d, CASE WHEN count(volume) {past(20)} = 20 THEN round(avg(volume / CAST(float_shares AS DOUBLE)) {past(20)}, 6) END AS turnover_20d, CASE WHEN count(volume) {past(5, 1)} = 5 THEN round(volume / nullif(avg(volume) {past(5, 1)}, 0), 6) END AS volume_ratio_5d FROM pn")
def turnover_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ["turnover_5d", "turnover_20d", "volume_ratio_5d"]
    return registry.matrix(_wide(spark, sf_dir), library.LIBRARY, names, "close").select("symbol", day(), *(r6(n, n) for n in names))


@query(f"WITH {SEG}, {_WIDE} SELECT symbol, CAST(date AS VARCHAR) AS date, round(close * total_shares / nullif(profit_ttm, 0), 5) AS pe_ttm, round(close * total_shares / equity, 5) AS pb FROM pn")
def valuation_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.matrix(_wide(spark, sf_dir), library.LIBRARY, ["pe_ttm", "pb"], "close").select("symbol", day(), r6("pe_ttm", "pe_ttm", 5), r6("pb", "pb", 5))


@query(f"WITH {SEG}, {_WIDE} SELECT symbol, CAST(date AS VARCHAR) AS date, round(auction_price / nullif(lag(close) {BY}, 0) - 1, 6) AS auction_premium, round(auction_volume / nullif(CAST(lag(volume) {BY} AS DOUBLE), 0), 6) AS auction_volume_ratio FROM pn")
def auction_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known by the open, so they do not move for an entry at the open."""
    names = ["auction_premium", "auction_volume_ratio"]
    return registry.matrix(_wide(spark, sf_dir), library.LIBRARY, names, "open").select("symbol", day(), *(r6(n, n) for n in names))


_FEATURES = ["mom_5d", "mom_20d_resid", "realized_vol_20d", "dist_to_high_60d", "is_stage2_200d", "auction_premium"]
_MATRIX = f"""x AS (SELECT *, CASE WHEN close > 0 THEN ln(close) END AS y, CASE WHEN count(close) {past(200)} = 200 THEN avg(close) {past(200)} END AS ma FROM pn),
 f AS (SELECT symbol, date, volume, y - lag(y, 5) {BY} AS mom_5d, y - lag(y, 20) {BY} AS mom_20d, y - lag(y) {BY} AS r, CASE WHEN count(close) {past(60)} = 60 THEN close / max(close) {past(60)} - 1 END AS dist_to_high_60d,
  CASE WHEN close > ma AND ma > lag(ma, 20) {BY} THEN 1.0 ELSE 0.0 END AS is_stage2_200d, auction_price / nullif(lag(close) {BY}, 0) - 1 AS auction_premium FROM x),
 h AS (SELECT *, mom_20d - avg(mom_20d) OVER (PARTITION BY date) AS mom_20d_resid, CASE WHEN count(r) {past(20)} = 20 THEN stddev_samp(r) {past(20)} END AS realized_vol_20d FROM f),
 mx AS (SELECT symbol, date, {', '.join(f'lag({n}) {BY} AS {n}' for n in _FEATURES[:-1])}, auction_premium, coalesce(volume <> 3, true) AS trustworthy FROM h)"""
_ROUND = ", ".join(f"round({n}, 6) AS {n}" for n in _FEATURES)


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.matrix(_wide(spark, sf_dir), library.LIBRARY, _FEATURES, "open", COL("volume") != 3)


@query(f"WITH {SEG}, {_WIDE}, {_MATRIX} SELECT symbol, CAST(date AS VARCHAR) AS date, {_ROUND}, trustworthy FROM mx")
def feature_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features with their needs, moved so that a row holds what is known before its open."""
    return _matrix(spark, sf_dir).select("symbol", day(), *(r6(n, n) for n in _FEATURES), "trustworthy")


@query(f"WITH {SEG}, {_WIDE}, {_MATRIX} SELECT symbol, CAST(date AS VARCHAR) AS date, {', '.join(f'CASE WHEN trustworthy THEN round({n}, 6) END AS {n}' for n in _FEATURES)} FROM mx")
def trusted_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return registry.trusted_values(_matrix(spark, sf_dir), _FEATURES).select("symbol", day(), *(r6(n, n) for n in _FEATURES))


@query(f"WITH {SEG}, {_WIDE}, {_MATRIX}, e AS (SELECT symbol, date FROM seg WHERE volume > 2) SELECT e.symbol || '|' || strftime(e.date, '%Y%m%d') AS event_id, {', '.join(f'round(mx.{n}, 6) AS {n}' for n in _FEATURES)} FROM e LEFT JOIN mx ON mx.symbol = e.symbol AND mx.date = e.date")
def features_on_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features of events that enter at the open; a matrix for another entry time would be refused."""
    p = panels.segment_prices(spark, sf_dir)
    events = samples.to_events(p.where("volume > 2").select("symbol", "date"), p.select("date").distinct(), 0.1, 5)
    return registry.attach(events, _matrix(spark, sf_dir), "open", _FEATURES).select("event_id", *(r6(n, n) for n in _FEATURES))


@query(
    "WITH b AS (SELECT event_type AS symbol, ts, CAST(ts AS DATE) AS date, arg_max(value, event_id) AS close FROM events WHERE value > 0 AND hour(ts) < 15 GROUP BY 1, 2), r AS (SELECT *, ln(close) - lag(ln(close)) OVER (PARTITION BY symbol, date ORDER BY ts) AS r, row_number() OVER (PARTITION BY symbol, date ORDER BY ts) AS i FROM b), v AS (SELECT *, CASE WHEN count(r) OVER k = 10 THEN var_samp(r) OVER k END AS v FROM r WINDOW k AS (PARTITION BY symbol, date ORDER BY ts ROWS BETWEEN 9 PRECEDING AND CURRENT ROW)) SELECT d.symbol, CAST(d.date AS VARCHAR) AS date, any_value(round(s, 5)) AS vol_slope FROM (SELECT DISTINCT event_type AS symbol, CAST(ts AS DATE) AS date FROM events) d LEFT JOIN (SELECT symbol, date, CASE WHEN count(r) >= 10 AND count(v) >= 2 THEN regr_slope(v, i) END AS s FROM v GROUP BY 1, 2) x ON x.symbol = d.symbol AND x.date = d.date GROUP BY 1, 2"
)
def volume_slope(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slope of rolling variances inside a day's bars up to 15:00."""
    e = table(spark, sf_dir, "events")
    bars = e.where((COL("value") > 0) & (F.hour("ts") < 15)).groupBy(COL("event_type").alias("symbol"), "ts").agg(F.max_by("value", "event_id").alias("close"))
    days = e.select(COL("event_type").alias("symbol"), F.to_date("ts").alias("date")).distinct()
    return library.volume_slope(bars, sessions.last_sessions(days, days, 1)).select("symbol", day(), r6("vol_slope", "vol_slope", 5))


@query(f"WITH {NAT}, k AS (SELECT symbol, date, amount, list(amount) {past(252)} AS l FROM nat) SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN len(l) >= 50 THEN round(len(list_filter(l, lambda v: v <= amount)) / len(l), 6) END AS own_rank FROM k")
def rolling_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.nation_flow(spark, sf_dir).select("symbol", day(), r6(w.rolling_rank(COL("amount"), 252), "own_rank"))


@query(f"WITH {NAT}, s AS (SELECT symbol, date, ln(close) AS y, row_number() {BY} AS x FROM nat) SELECT symbol, CAST(date AS VARCHAR) AS date, CASE WHEN count(y) {past(60)} = 60 THEN round(greatest(regr_r2(y, x) {past(60)}, 0), 5) END AS fit FROM s")
def trend_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.nation_flow(spark, sf_dir).withColumn("x", F.row_number().over(w.by_symbol()))
    return p.select("symbol", day(), r6(w.smooth_fit(COL("close"), COL("x"), 60), "fit", 5))


# ---- gates ------------------------------------------------------------------------------------------------------


@query(f"WITH {SEG}, ix AS (SELECT date, avg(close) AS c FROM seg GROUP BY 1), im AS (SELECT date, coalesce(c > CASE WHEN count(c) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) = 20 THEN avg(c) OVER (ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW) END, false) AS above FROM ix), m AS (SELECT date, close - lag(close) {BY} AS d, volume >= 3 AS up, volume = 1 AS down FROM seg), b AS (SELECT date, coalesce(count(*) FILTER (d > 0) / nullif(count(d), 0) >= 0.45, false) AND (count(*) FILTER (up) - count(*) FILTER (down)) / count(*) >= -0.5 AS ok FROM m GROUP BY 1) SELECT symbol, CAST(date AS VARCHAR) AS date, ok AND above AS ok FROM seg JOIN b USING (date) JOIN im USING (date)")
def breadth_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Advances, net limits and an index above its mean, spread over all symbols."""
    p = panels.segment_prices(spark, sf_dir).withColumn("is_limit_up", COL("volume") >= 3).withColumn("is_limit_down", COL("volume") == 1)
    days = gates.breadth(p, 0.45, p.groupBy("date").agg(F.avg("close").alias("close")), above=20, net_limits=-0.5)
    return gates.spread(days, p).select("symbol", day(), "ok")


@query(f"WITH {SEG} SELECT symbol, CAST(date AS VARCHAR) AS date, coalesce(CASE WHEN count(close) {past(60)} = 60 THEN close / max(close) {past(60)} - 1 END >= -0.25, false) AS near, close BETWEEN 100000 AND 200000 AS inside FROM seg")
def level_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panels.segment_prices(spark, sf_dir).select("symbol", day(), gates.near_high(COL("close")).alias("near"), gates.between(COL("close"), 100000, 200000).alias("inside"))


@query(f"WITH {NAT}, k AS (SELECT symbol, date, CASE WHEN volume > 20 THEN amount END AS s FROM nat) SELECT symbol, CAST(date AS VARCHAR) AS date, s IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY s NULLS LAST, symbol) <= 4 AS ok FROM k")
def eligible_rank_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four smallest of what is eligible."""
    p = panels.nation_flow(spark, sf_dir).withColumnRenamed("amount", "score")
    return gates.ranked(p, top=4, ascending=True, eligible=COL("volume") > 20).select("symbol", day(), "ok")


# ---- samples ----------------------------------------------------------------------------------------------------

_OPEN = """path AS (SELECT e.*, b.date, b.close, b.open FROM e LEFT JOIN ev b ON b.symbol = e.symbol AND b.date BETWEEN e.event_start AND e.t1),
 en AS (SELECT event_id, max(open) FILTER (date = event_start AND open > 0) AS entry FROM path GROUP BY 1),
 rr AS (SELECT path.*, entry, (close / entry - 1) * coalesce(side, 1) AS r FROM path JOIN en USING (event_id)),
 agg AS (SELECT event_id, symbol, event_start, t1, target, side, any_value(entry) AS entry, min(date) FILTER (r >= {pt} * target) AS up, min(date) FILTER (r <= -{sl} * target) AS down, count(close) AS n FROM rr GROUP BY 1, 2, 3, 4, 5, 6),
 tt AS (SELECT *, least(up, down, t1) AS touch FROM agg),
 lab AS (SELECT tt.*, CASE WHEN target IS NULL OR target <= 0 OR entry IS NULL THEN 'invalid' WHEN n < 1 THEN 'no_data' WHEN up = touch THEN 'upper' WHEN down = touch THEN 'lower' ELSE 'vertical' END AS kind, coalesce((SELECT any_value(r) FROM rr WHERE rr.event_id = tt.event_id AND rr.date = touch), (SELECT arg_max(r, date) FROM rr WHERE rr.event_id = tt.event_id)) AS ret FROM tt)"""
_EVENTS = "e AS (SELECT symbol || '|' || strftime(date, '%Y%m%d') AS event_id, symbol, date AS event_start, date + 4 AS t1, CASE WHEN volume % 10 <> 0 THEN 0.3 WHEN volume % 20 = 0 THEN 0.0 END AS target, CASE WHEN volume % 3 > 0 THEN sign(volume % 3 - 1.5) END AS side FROM ev)"


@query(f"WITH {EV}, {_EVENTS}, {_OPEN.format(pt=2, sl=1)} SELECT event_id, CAST(touch AS VARCHAR) AS touch_date, kind AS touch_type, CASE WHEN kind NOT IN ('invalid', 'no_data') THEN round(ret, 6) END AS ret, CASE WHEN kind NOT IN ('invalid', 'no_data') AND ret > 0 THEN 1 ELSE 0 END AS bin FROM lab")
def meta_labels_at_open(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entry at the open, sides that come from a first model, invalid targets: bins of the second model."""
    bars, v = panels.event_bars(spark, sf_dir), COL("volume")
    e = bars.select(F.concat_ws("|", "symbol", F.date_format("date", "yyyyMMdd")).alias("event_id"), "symbol", COL("date").alias("event_start"), F.date_add("date", 4).alias("t1"), F.when(v % 10 != 0, 0.3).when(v % 20 == 0, 0.0).alias("target"))
    sides = bars.where(v % 3 > 0).select("symbol", COL("date").alias("event_start"), F.signum(v % 3 - 1.5).alias("side"))
    got = labels.triple_barrier(labels.with_side(e, sides), bars, 2, 1, "open", meta="any")
    return got.select("event_id", dated("touch_time", "touch_date"), "touch_type", r6("ret", "ret"), "bin")


_SPEC = """c AS (SELECT date, row_number() OVER (ORDER BY date) AS seq FROM (SELECT DISTINCT date FROM ev)), lastday AS (SELECT max(date) AS pe FROM ev),
 g0 AS (SELECT symbol, date, sign(close - lag(close) OVER (PARTITION BY symbol ORDER BY date)) AS g FROM ev), g1 AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) - row_number() OVER (PARTITION BY symbol, g ORDER BY date) AS run FROM g0), g2 AS (SELECT *, row_number() OVER (PARTITION BY symbol, g, run ORDER BY date) AS k FROM g1),
 e AS (SELECT a.symbol || '|' || strftime(n.date, '%Y%m%d') AS event_id, a.symbol, n.date AS event_start, CASE WHEN pe > n.date AND (z.date IS NULL OR z.date > pe) THEN pe ELSE z.date END AS t1, 0.2 AS target, CAST(NULL AS DOUBLE) AS side FROM g2 a JOIN c ON c.date = a.date JOIN c n ON n.seq = c.seq + 1 LEFT JOIN c z ON z.seq = n.seq + 5 CROSS JOIN lastday WHERE k = 3 AND g <> 0)"""
_MOM = "mm AS (SELECT symbol, date, ln(close) - lag(ln(close), 5) OVER (PARTITION BY symbol ORDER BY date) AS m FROM (SELECT s.symbol, d.date, p.close FROM (SELECT DISTINCT symbol FROM ev) s CROSS JOIN (SELECT DISTINCT date FROM ev) d LEFT JOIN ev p ON p.symbol = s.symbol AND p.date = d.date)), fx AS (SELECT symbol, date, lag(m) OVER (PARTITION BY symbol ORDER BY date) AS mom_5d FROM mm)"


def _thirds(panel: DataFrame) -> DataFrame:
    """The third equal sign in a row."""
    t = panel.withColumn("g", F.signum(COL("close") - w.lag(COL("close"))))
    t = t.withColumn("run", w.run_number(COL("g")))
    return t.withColumn("k", F.row_number().over(W.partitionBy("symbol", "g", "run").orderBy("date"))).where("k = 3 and g <> 0")


@query(f"WITH {EV}, {_SPEC}, {_OPEN.format(pt=1.5, sl=1)}, {_MOM} SELECT event_id, kind AS touch_type, CAST(lab.t1 AS VARCHAR) AS until, round(ret, 6) AS ret, CASE kind WHEN 'upper' THEN 1 WHEN 'lower' THEN -1 ELSE 0 END AS bin, round(mom_5d, 6) AS mom_5d FROM lab LEFT JOIN fx ON fx.symbol = lab.symbol AND fx.date = lab.event_start WHERE kind NOT IN ('invalid', 'no_data') AND ret IS NOT NULL")
def labeled_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The safe entry point: sampler, entry at the next open, barriers, and features known before that open."""
    bars = panels.event_bars(spark, sf_dir)
    spec = samples.SampleSpec(_thirds, samples.Exit(1.5, 1.0, 5), "open")
    values = registry.matrix(panels.densify(bars), library.LIBRARY, ["mom_5d"], "open")
    got = samples.build(spec, bars, panels.calendar(bars), values, "open", ["mom_5d"], 0.2)
    return got.select("event_id", "touch_type", dated("t1", "until"), r6("ret", "ret"), "bin", r6("mom_5d", "mom_5d"))


_SPAN = "sp AS (SELECT symbol || '|' || strftime(date, '%Y%m%d') AS event_id, symbol, date AS event_start, CASE WHEN volume % 8 <> 0 THEN date + 4 END AS t1 FROM ev)"
_FINAL = f"{_SPAN}, cc AS (SELECT ev.symbol, ev.date, count(sp.event_id) AS c FROM ev LEFT JOIN sp ON sp.symbol = ev.symbol AND ev.date >= sp.event_start AND (sp.t1 IS NULL OR ev.date <= sp.t1) GROUP BY 1, 2), lr AS (SELECT symbol, date, ln(close) - lag(ln(close)) {BY} AS r FROM ev), un AS (SELECT sp.event_id, any_value(sp.event_start) AS event_start, avg(1.0 / nullif(c, 0)) FILTER (sp.t1 IS NOT NULL) AS u, abs(sum(r / nullif(c, 0)) FILTER (sp.t1 IS NOT NULL)) AS a FROM sp LEFT JOIN cc ON cc.symbol = sp.symbol AND cc.date BETWEEN sp.event_start AND sp.t1 LEFT JOIN lr ON lr.symbol = cc.symbol AND lr.date = cc.date GROUP BY 1), dd AS (SELECT *, sum(coalesce(u, 1)) OVER (ORDER BY event_start, event_id ROWS UNBOUNDED PRECEDING) AS cum, sum(coalesce(u, 1)) OVER () AS t FROM un), fw AS (SELECT *, greatest(0, 1 - (0.5 / t) * t + (0.5 / t) * cum) AS decay FROM dd)"


def _sample_spans(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    bars = panels.event_bars(spark, sf_dir)
    return bars.select(F.concat_ws("|", "symbol", F.date_format("date", "yyyyMMdd")).alias("event_id"), "symbol", COL("date").alias("event_start"), F.when(COL("volume") % 8 != 0, F.date_add("date", 4)).alias("t1")), bars


@query(f"WITH {EV}, {_FINAL} SELECT event_id, round(u, 6) AS uniqueness, round(decay, 6) AS decay, round(coalesce(u, 1) * decay * count(*) OVER () / sum(coalesce(u, 1) * decay) OVER (), 6) AS weight FROM fw")
def final_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Uniqueness times decay, summing to the number of samples; an event without an end counts as 1."""
    spans, bars = _sample_spans(spark, sf_dir)
    return labels.sample_weights(spans, bars, "uniqueness", 0.5).select("event_id", r6("uniqueness", "uniqueness"), r6("decay", "decay"), r6("weight", "weight"))


@query(f"WITH {EV}, {_FINAL} SELECT event_id, round(a, 6) AS attribution, round(coalesce(a, 1), 6) AS weight FROM fw")
def attribution_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans, bars = _sample_spans(spark, sf_dir)
    return labels.sample_weights(spans, bars, "attribution", to_n=False).select("event_id", r6("attribution", "attribution"), r6("weight", "weight"))


@query(f"WITH {EV}, m AS (SELECT symbol, date, volume > 5 AS ok FROM ev WHERE volume % 4 <> 0) SELECT ev.symbol, CAST(ev.date AS VARCHAR) AS date, coalesce(m.ok, false) AS kept FROM ev LEFT JOIN m ON m.symbol = ev.symbol AND m.date = ev.date")
def filtered_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs that a mask keeps, and those that it does not."""
    p = panels.event_bars(spark, sf_dir)
    mask = p.where("volume % 4 <> 0").select("symbol", "date", (COL("volume") > 5).alias("ok"))
    kept = [samples.filter_pairs(p, mask, k).select("symbol", day(), F.lit(k).alias("kept")) for k in (True, False)]
    return kept[0].union(kept[1])


@query("WITH p AS (SELECT event_type AS symbol, CAST(ts AS DATE) AS date FROM events), n AS (SELECT symbol, date, row_number() OVER (PARTITION BY symbol, date) AS k FROM p) SELECT symbol || '|' || strftime(date, '%Y%m%d') || CASE WHEN k > 1 THEN '|' || (k - 1) ELSE '' END AS event_id FROM n")
def event_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return samples.event_ids(table(spark, sf_dir, "events").select(COL("event_type").alias("symbol"), F.to_date("ts").alias("date"))).select("event_id")


# ---- sizing and concentration -----------------------------------------------------------------------------------


@query(f"WITH {EV}, p AS (SELECT symbol, date, close, vwap, CAST(volume % 13 - 6 AS INTEGER) AS cur, CAST(volume % 7 - 3 AS INTEGER) AS tgt FROM ev WHERE vwap > 0), l AS (SELECT *, generate_series(CAST(abs(cur + sign(tgt - cur)) AS INTEGER), abs(tgt)) AS way FROM p) SELECT symbol, CAST(date AS VARCHAR) AS date, round(20.0 * 20.0 * (1 / (0.9 * 0.9) - 1), 6) AS width, CASE WHEN tgt <> cur THEN round(list_sum(list_append(list_transform(list_filter(way, lambda j: abs(j) < 5), lambda j: vwap - (j / 5.0) * sqrt(94.0 / (1 - (j / 5.0) * (j / 5.0)))), 0)) / abs(tgt - cur), 5) END AS limit_price FROM l")
def limit_prices(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.event_bars(spark, sf_dir).where("vwap > 0").withColumn("cur", (COL("volume") % 13 - 6).cast("int")).withColumn("tgt", (COL("volume") % 7 - 3).cast("int"))
    limit = stats.limit_price(COL("tgt"), COL("cur"), COL("vwap"), F.lit(94.0), 5)
    return p.select("symbol", day(), r6(stats.calibrate(F.lit(20.0), F.lit(0.9)), "width"), (F.round(limit, 5) + 0.0).alias("limit_price"))


@query()
def bet_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes from probabilities; the normal distribution has no SQL."""
    p = panels.event_bars(ship(spark), sf_dir).withColumn("p", (COL("volume") % 101) / 100.0)
    return p.select("symbol", day(), r6(stats.bet_sizes(COL("p"), F.lit(1.0), 2, F.signum(COL("close") - COL("open"))), "size"))


_HHI = "(sum(r * r) FILTER ({c}) / (sum(r) FILTER ({c}) * sum(r) FILTER ({c})) - 1.0 / count(r) FILTER ({c})) / (1 - 1.0 / count(r) FILTER ({c}))"


@query(f"WITH {SEG}, rt AS (SELECT symbol, close / lag(close) {BY} - 1 AS r FROM seg) SELECT symbol, round({_HHI.format(c='r >= 0')}, 8) AS positive, round({_HHI.format(c='r < 0')}, 8) AS negative FROM rt GROUP BY 1")
def signed_concentration(spark: SparkSession, sf_dir: str) -> DataFrame:
    r = panels.segment_prices(spark, sf_dir).select("symbol", (COL("close") / w.lag(COL("close")) - 1).alias("r"))
    up, down = stats.signed_hhi(r, ["symbol"], True), stats.signed_hhi(r, ["symbol"], False)
    return up.withColumnRenamed("hhi", "positive").join(down.withColumnRenamed("hhi", "negative"), "symbol").select("symbol", r6("positive", "positive", 8), r6("negative", "negative", 8))


# ---- state machines -----------------------------------------------------------------------------------------------

_BARS = f"n AS (SELECT symbol, date, high, low, close, row_number() {BY} AS i, lag(high, 2) {BY} AS h2, lag(low, 2) {BY} AS l2 FROM ev)"


@query(
    f"""WITH RECURSIVE {EV}, {_BARS}, z AS (
 SELECT symbol, date, i, 0 AS side, CAST(NULL AS DOUBLE) AS lo, CAST(NULL AS DOUBLE) AS hi, 0 AS retest, 0 AS broken FROM n WHERE i = 1
 UNION ALL
 SELECT symbol, date, i, CASE WHEN h2 < low THEN 1 WHEN l2 > high THEN -1 ELSE kept END, CASE WHEN h2 < low THEN h2 WHEN l2 > high THEN high ELSE lo END, CASE WHEN h2 < low THEN low WHEN l2 > high THEN l2 ELSE hi END, retest, broken
 FROM (SELECT n.symbol, n.date, n.i, n.h2, n.l2, n.low, n.high, z.lo, z.hi,
   CASE WHEN z.side = 1 AND n.close < z.lo OR z.side = -1 AND n.close > z.hi THEN 1 ELSE 0 END AS broken,
   CASE WHEN z.side = 1 AND n.close >= z.lo AND n.low <= z.hi OR z.side = -1 AND n.close <= z.hi AND n.high >= z.lo THEN 1 ELSE 0 END AS retest,
   CASE WHEN z.side = 1 AND n.close < z.lo OR z.side = -1 AND n.close > z.hi THEN 0 ELSE z.side END AS kept
  FROM z JOIN n ON n.symbol = z.symbol AND n.i = z.i + 1))
 SELECT symbol, CAST(date AS VARCHAR) AS date, CAST(side AS BIGINT) AS imbalance, CAST(retest AS BIGINT) AS retest, CAST(broken AS BIGINT) AS broken FROM z"""
)
def gap_zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.gap_zones(panels.event_bars(ship(spark), sf_dir)).select("symbol", day(), "imbalance", "retest", "broken")


_TR = f"""t0 AS (SELECT symbol, date, high, low, close, row_number() {BY} AS i, greatest(abs(high - low), abs(high - lag(close) {BY}), abs(low - lag(close) {BY})) AS tr, lag(close) {BY} IS NOT NULL AS had FROM ev),
 a AS (SELECT symbol, i, tr AS e FROM t0 WHERE i = 2 UNION ALL SELECT t0.symbol, t0.i, a.e * 0.8 + t0.tr * 0.2 FROM a JOIN t0 ON t0.symbol = a.symbol AND t0.i = a.i + 1),
 t AS (SELECT t0.*, a.e FROM t0 LEFT JOIN a ON a.symbol = t0.symbol AND a.i = t0.i)"""
_STEP = """{k} AS (SELECT symbol, i, (high + low) / 2 + {m} * e AS up, (high + low) / 2 - {m} * e AS down, close AS c, -1 AS way, 0 AS age FROM t WHERE i = 6
 UNION ALL SELECT symbol, i, top, bottom, close, now, CASE WHEN now = way THEN age + 1 ELSE 0 END FROM (SELECT *, CASE WHEN way = 1 THEN CASE WHEN close >= bottom THEN 1 ELSE -1 END ELSE CASE WHEN close > top THEN 1 ELSE -1 END END AS now FROM
  (SELECT t.symbol, t.i, t.close, s.way, s.age, CASE WHEN s.c <= s.up THEN least((t.high + t.low) / 2 + {m} * t.e, s.up) ELSE (t.high + t.low) / 2 + {m} * t.e END AS top, CASE WHEN s.c >= s.down THEN greatest((t.high + t.low) / 2 - {m} * t.e, s.down) ELSE (t.high + t.low) / 2 - {m} * t.e END AS bottom FROM {k} s JOIN t ON t.symbol = s.symbol AND t.i = s.i + 1)))"""


@query(f"WITH RECURSIVE {EV}, {_TR}, {_STEP.format(k='s1', m='1.0')} SELECT t.symbol, CAST(t.date AS VARCHAR) AS date, CAST(way AS BIGINT) AS direction, round(CASE WHEN way = 1 THEN down ELSE up END, 6) AS line, CAST(age AS BIGINT) AS age FROM t LEFT JOIN s1 ON s1.symbol = t.symbol AND s1.i = t.i")
def supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null before the range is known."""
    p = paths.supertrend(panels.event_bars(ship(spark), sf_dir), 5, 1.0)
    return p.select("symbol", day(), "direction", r6("line", "line"), "age")


@query(f"WITH RECURSIVE {EV}, {_TR}, {_STEP.format(k='s3', m='1.5')}, {_STEP.format(k='s2', m='1.0')} SELECT t.symbol, CAST(t.date AS VARCHAR) AS date, CAST(s3.way AS BIGINT) AS slow_direction, CAST(s3.age AS BIGINT) AS slow_age, CAST(s2.way AS BIGINT) AS fast_direction, CAST(s2.age AS BIGINT) AS fast_age FROM t LEFT JOIN s3 ON s3.symbol = t.symbol AND s3.i = t.i LEFT JOIN s2 ON s2.symbol = t.symbol AND s2.i = t.i")
def dual_supertrend(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.supertrends(panels.event_bars(ship(spark), sf_dir), 5, {"slow_": 1.5, "fast_": 1.0})
    return p.select("symbol", day(), "slow_direction", "slow_age", "fast_direction", "fast_age")


@query(f"WITH RECURSIVE {SEG}, k AS (SELECT symbol, date, row_number() {BY} AS i, close, CASE WHEN count(close) {past(20)} = 20 THEN close >= max(close) {past(20)} ELSE false END AS hit FROM seg), f AS (SELECT symbol, date, i, row_number() {BY} AS n FROM (SELECT *, lag(hit, 1, false) {BY} AS before FROM k) WHERE hit AND NOT before), c AS (SELECT symbol, date, n, i AS last, true AS keep FROM f WHERE n = 1 UNION ALL SELECT f.symbol, f.date, f.n, CASE WHEN f.i - c.last > 5 THEN f.i ELSE c.last END, f.i - c.last > 5 FROM c JOIN f ON f.symbol = c.symbol AND f.n = c.n + 1) SELECT symbol, CAST(date AS VARCHAR) AS date FROM c WHERE keep")
def breakout_sampler(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First touches of a rolling high, none within five sessions of the last one kept."""
    return paths.breakouts(panels.segment_prices(ship(spark), sf_dir), 20, 5).select("symbol", day())


@query()
def trend_direction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.trend_direction(panels.event_bars(ship(spark), sf_dir), 5, 1.5, 1.0).select("symbol", day(), "direction")
