"""Every schema's rules over a table that keeps some and breaks some."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import COL, EV, query
from ..operators import validation
from ..plans import panels
from ..session import ship, table
from .market import _CON, _DAILY, _DAYS, _FUND, _IND, _NEXT, _market


def _sql(schema: validation.Schema, rows: str) -> str:
    """SQL of ``validation.report`` over SQL of the rows: nulls in required columns, broken rules, repeated keys."""
    plain = lambda test: test.replace("to_date(", "date(")
    counts = {f"{c}_null": f"count(*) FILTER ({c} IS NULL)" for c in schema.required} | {n: f"count(*) FILTER (NOT coalesce({plain(e)}, true))" for n, e in schema.rules.items()}
    out = [f"SELECT '{n}' AS rule, {x} AS bad FROM t" for n, x in counts.items()]
    if schema.key:
        out.append(f"SELECT 'key_repeats', CAST(coalesce(sum(k - 1), 0) AS BIGINT) FROM (SELECT count(*) AS k FROM t GROUP BY {', '.join(schema.key)})")
    return f"{rows} " + " UNION ALL ".join(out)


_NIGHT = "CASE WHEN hour(ts) < 6 THEN 'night' WHEN hour(ts) < 12 THEN 'morning' ELSE 'afternoon' END"
_MINUTES = f"WITH t AS (SELECT event_type AS symbol, ts, value AS close, 1 AS volume, {_NIGHT} AS session, CASE WHEN hour(ts) = 23 THEN 1.5 ELSE 1.0 END AS adj_factor FROM events)"


@query(_sql(validation.INTRADAY, _MINUTES) + " UNION ALL SELECT 'factor_per_day', count(*) FROM (SELECT 1 FROM t GROUP BY symbol, CAST(ts AS DATE) HAVING count(DISTINCT adj_factor) > 1)")
def rules_of_intraday_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, hour = table(spark, sf_dir, "events"), F.hour("ts")
    b = e.select(COL("event_type").alias("symbol"), "ts", COL("value").alias("close"), F.lit(1).alias("volume"), F.when(hour < 6, "night").when(hour < 12, "morning").otherwise("afternoon").alias("session"), F.when(hour == 23, 1.5).otherwise(1.0).alias("adj_factor"))
    more = validation.one_factor_a_day(b).agg(F.count("*").alias("bad")).select(F.lit("factor_per_day").alias("rule"), "bad")
    return validation.report(b, validation.INTRADAY).union(more)


_MEMBERS = f"WITH {_DAYS}, t AS (SELECT date, symbol, true AS in_universe, CASE WHEN day(date) = 13 THEN 1.5 ELSE 1 END * amount / sum(amount) OVER (PARTITION BY date) AS weight FROM bs)"


@query(_sql(validation.UNIVERSE, _MEMBERS) + " UNION ALL SELECT 'weights_sum', count(*) FROM (SELECT 1 FROM t GROUP BY date HAVING abs(sum(weight) - 1) > 1e-3)")
def rules_of_universes(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window as W

    d = _market(spark, sf_dir)._days()
    u = d.select("date", "symbol", F.lit(True).alias("in_universe"), (F.when(F.dayofmonth("date") == 13, 1.5).otherwise(1.0) * COL("amount") / F.sum("amount").over(W.partitionBy("date"))).alias("weight"))
    more = validation.weights_sum_to_one(u).agg(F.count("*").alias("bad")).select(F.lit("weights_sum").alias("rule"), "bad")
    return validation.report(u, validation.UNIVERSE).union(more)


@query(_sql(validation.FUNDAMENTAL, f"WITH {_FUND}, t AS (SELECT symbol, report_period, CASE WHEN report_type = 'official' THEN available_at ELSE report_period - 5 END AS announce_date, CASE WHEN quarter(report_period) = 2 THEN available_at - 90 ELSE available_at END AS available_at, report_type, net_profit - 1000000 AS forecast_min, 2000000 - net_profit AS forecast_max FROM fund)"))
def rules_of_fundamentals(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _market(spark, sf_dir).fundamentals()
    early = F.when(COL("report_type") == "official", COL("announce_date")).otherwise(F.date_sub("report_period", 5))
    moved = F.when(F.quarter("report_period") == 2, F.date_sub("available_at", 90)).otherwise(COL("available_at"))
    t = f.select("symbol", "report_period", early.alias("announce_date"), moved.alias("available_at"), "report_type", (COL("net_profit") - 1e6).alias("forecast_min"), (2e6 - COL("net_profit")).alias("forecast_max"))
    return validation.report(t, validation.FUNDAMENTAL)


@query(_sql(validation.EVENT, f"WITH {EV}, t AS (SELECT symbol || '|' || CAST(volume % 40 AS VARCHAR) AS event_id, symbol, date AS event_start, date + CAST(volume % 5 AS INTEGER) AS t1, close - vwap AS target, CAST(volume % 3 - 1 AS DOUBLE) AS side FROM ev)"))
def rules_of_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.event_bars(ship(spark), sf_dir)
    t = p.select(F.concat("symbol", F.lit("|"), (COL("volume") % 40).cast("string")).alias("event_id"), "symbol", COL("date").alias("event_start"), F.date_add("date", (COL("volume") % 5).cast("int")).alias("t1"), (COL("close") - COL("vwap")).alias("target"), (COL("volume") % 3 - 1).cast("double").alias("side"))
    return validation.report(t, validation.EVENT)


_TYPES = ("upper", "lower", "vertical", "early")


@query(_sql(validation.LABEL, f"WITH {EV}, t AS (SELECT symbol || '|' || CAST(date AS VARCHAR) AS event_id, symbol, date AS event_start, date + 4 AS t1, date + CAST(volume % 7 AS INTEGER) - 1 AS touch_time, list_value({', '.join(map(repr, _TYPES))})[volume % 4 + 1] AS touch_type, close / open - 1 AS ret, CASE WHEN volume % 6 <> 0 THEN volume % 4 - 1 END AS bin FROM ev)"))
def rules_of_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = COL("volume")
    t = panels.event_bars(ship(spark), sf_dir).select(F.concat("symbol", F.lit("|"), COL("date").cast("string")).alias("event_id"), "symbol", COL("date").alias("event_start"), F.date_add("date", 4).alias("t1"), F.date_add("date", (v % 7 - 1).cast("int")).alias("touch_time"), F.element_at(F.array(*map(F.lit, _TYPES)), (v % 4 + 1).cast("int")).alias("touch_type"), (COL("close") / COL("open") - 1).alias("ret"), F.when(v % 6 != 0, v % 4 - 1).alias("bin"))
    return validation.report(t, validation.LABEL)


@query(_sql(validation.WEIGHT, f"WITH {EV}, t AS (SELECT symbol || '|' || CAST(date AS VARCHAR) AS event_id, volume / 70.0 AS uniqueness, (close - 30) / 20 AS final_weight FROM ev)") + " UNION ALL SELECT 'weights_sum', CASE WHEN abs(sum(final_weight) - count(*)) <= 0.05 * count(*) + 1 THEN 0 ELSE 1 END FROM t")
def rules_of_sample_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = panels.event_bars(ship(spark), sf_dir).select(F.concat("symbol", F.lit("|"), COL("date").cast("string")).alias("event_id"), (COL("volume") / 70.0).alias("uniqueness"), ((COL("close") - 30) / 20).alias("final_weight"))
    more = validation.weights_sum_to_count(t).select(F.lit("weights_sum").alias("rule"), (~COL("fine")).cast("long").alias("bad"))
    return validation.report(t, validation.WEIGHT).union(more)


@query(_sql(validation.CONCEPT, f"WITH {_CON}, t AS (SELECT symbol, concept_code, a + 1900 AS effective_date, z AS expired_date FROM con)"))
def rules_of_concepts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.report(_market(spark, sf_dir).concepts().withColumn("effective_date", F.date_add("effective_date", 1900)), validation.CONCEPT)


@query(_sql(validation.INDUSTRY, f"WITH {_IND}, t AS (SELECT symbol, date, 'sw' AS system, CASE WHEN industry_code IN ('I01', 'I03') THEN 2 ELSE 1 END AS level, industry_code, CASE WHEN industry_code = 'I01' THEN 'I00' END AS parent_code FROM ind)"))
def rules_of_industries(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = _market(spark, sf_dir).industry()
    t = i.withColumn("level", F.when(COL("industry_code").isin("I01", "I03"), 2).otherwise(1)).withColumn("parent_code", F.when(COL("industry_code") == "I01", "I00"))
    return validation.report(t, validation.INDUSTRY)


@query(_sql(validation.MARGIN, f"WITH {_DAYS}, {_NEXT}, t AS (SELECT symbol, bs.date, CASE WHEN day(bs.date) = 1 THEN CAST(bs.date AS TIMESTAMP) ELSE later + INTERVAL 570 MINUTE END AS available_at, kept - 20000 AS fin_balance FROM bs LEFT JOIN nx ON nx.date = bs.date)"))
def rules_of_margin_trading(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir).margin_trading()
    t = m.withColumn("available_at", F.when(F.dayofmonth("date") == 1, COL("date").cast("timestamp")).otherwise(COL("available_at"))).withColumn("fin_balance", COL("fin_balance") - 20000)
    return validation.report(t, validation.MARGIN)


@query(_sql(validation.MONEY_FLOW, f"WITH {_DAYS}, {_NEXT}, t AS (SELECT symbol, bs.date, later + INTERVAL 570 MINUTE AS available_at, xl + l + lines % 3 * 0.9 AS net_amount_main, xl AS net_amount_xl, l AS net_amount_l FROM bs LEFT JOIN nx ON nx.date = bs.date)"))
def rules_of_money_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    lines = m._days().select("symbol", "date", "lines")
    t = m.money_flow().join(lines, ["symbol", "date"]).select("symbol", "date", "available_at", (COL("net_main") + COL("lines") % 3 * 0.9).alias("net_amount_main"), COL("net_xl").alias("net_amount_xl"), COL("net_l").alias("net_amount_l"))
    return validation.report(t, validation.MONEY_FLOW)


@query(_sql(validation.AUCTION, f"WITH {_DAILY}, t AS (SELECT symbol, date, date + INTERVAL 570 MINUTE + CASE WHEN day(date) = 2 THEN INTERVAL 1 DAY ELSE INTERVAL 0 DAY END AS available_at, CAST(volume // 20 AS DOUBLE) AS auction_volume, open * (volume // 20) AS auction_amount, open - 0.01 AS bid1_price, CASE WHEN volume % 5 = 0 THEN open - 0.02 ELSE open + 0.01 END AS ask1_price FROM dl WHERE NOT is_suspended)"))
def rules_of_call_auctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    volume = m.daily().select("symbol", "date", "volume", "open")
    late = F.when(F.dayofmonth("date") == 2, F.expr("available_at + INTERVAL 1 DAY")).otherwise(COL("available_at"))
    t = m.call_auction().join(volume, ["symbol", "date"]).select("symbol", "date", late.alias("available_at"), COL("auction_volume").cast("double").alias("auction_volume"), "auction_amount", COL("bid1").alias("bid1_price"), F.when(COL("volume") % 5 == 0, COL("open") - 0.02).otherwise(COL("ask1")).alias("ask1_price"))
    return validation.report(t, validation.AUCTION)


@query(_sql(validation.BILLBOARD, f"WITH {_DAYS}, t AS (SELECT symbol, date, CASE WHEN lines % 6 = 0 THEN 'HOLD' WHEN bought >= sold THEN 'BUY' ELSE 'SELL' END AS direction, bought AS buy_value, sold AS sell_value, bought - sold + listed * 0.9 AS net_value FROM bs WHERE listed > 0)"))
def rules_of_billboards(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = _market(spark, sf_dir)
    more = m._days().select("symbol", "date", "lines", "listed")
    t = m.billboard().join(more, ["symbol", "date"]).select("symbol", "date", F.when(COL("lines") % 6 == 0, "HOLD").otherwise(COL("direction")).alias("direction"), COL("buy").alias("buy_value"), COL("sell").alias("sell_value"), (COL("net") + COL("listed") * 0.9).alias("net_value"))
    return validation.report(t, validation.BILLBOARD)


@query(_sql(validation.FACTOR, f"WITH {_DAYS}, e AS (SELECT symbol, date, unnest(['size', 'beta', 'size']) AS factor, unnest([ln(amount), tax, discount]) AS value, day(date) AS d FROM bs), t AS (SELECT symbol, date, CASE WHEN d <> 9 THEN factor END AS factor, value FROM e)"))
def rules_of_factor_exposures(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = _market(spark, sf_dir).factor_exposure()
    named = F.when(COL("factor") == "value", "size").otherwise(COL("factor"))
    return validation.report(f.withColumn("factor", F.when(F.dayofmonth("date") != 9, named)), validation.FACTOR)
