"""Queries of gates and of schema checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import COL, EV, NAT, SEG, day, past, query, r6
from ..operators import gates, validation
from ..operators import windows as w
from ..plans import panels

_VOL = f"SELECT symbol, date, coalesce(volume / nullif(CASE WHEN count(volume) {past(5, 1)} >= 2 THEN avg(volume) {past(5, 1)} END, 0) >= 1.1, false) AS ok FROM ev"
_CALM = "SELECT symbol, date, coalesce(close / lag(close, 3) OVER (PARTITION BY symbol ORDER BY date) - 1 <= 0.5, false) AS ok FROM ev"


def _masks(spark: SparkSession, sf_dir: str) -> list[DataFrame]:
    p = panels.event_bars(spark, sf_dir)
    return [p.select("symbol", "date", gates.volume_confirms(COL("volume"), ratio=1.1).alias("ok")), p.select("symbol", "date", gates.no_climax(COL("close"), 3, most=0.5).alias("ok"))]


@query(f"WITH {EV}, v AS ({_VOL}), c AS ({_CALM}) SELECT v.symbol, CAST(v.date AS VARCHAR) AS date, v.ok AND c.ok AS ok FROM v JOIN c USING (symbol, date)")
def gates_and(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.combine(_masks(spark, sf_dir)).select("symbol", day(), "ok")


@query(f"WITH {EV}, v AS ({_VOL}), c AS ({_CALM}) SELECT v.symbol, CAST(v.date AS VARCHAR) AS date, v.ok OR c.ok AS ok FROM v JOIN c USING (symbol, date)")
def gates_or(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.combine(_masks(spark, sf_dir), "or").select("symbol", day(), "ok")


_HYG = f"h AS (SELECT *, volume % 7 = 0 AS st, row_number() OVER (PARTITION BY symbol ORDER BY date) AS age, CASE WHEN count(amount) {past(20)} = 20 THEN avg(amount) {past(20)} END AS mean_amount FROM nat)"


@query(f"WITH {NAT}, {_HYG} SELECT symbol, CAST(date AS VARCHAR) AS date, coalesce(NOT st AND age >= 30 AND close >= 100 AND mean_amount >= 1000, false) AS ok FROM h")
def tradable_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.nation_flow(spark, sf_dir).withColumn("is_st", COL("volume") % 7 == 0).withColumn("is_suspended", F.lit(False)).withColumn("is_limit_up", F.lit(None).cast("boolean"))
    p = p.withColumn("days_since_listing", F.row_number().over(w.by_symbol()))
    return gates.tradable(p, 30, 100.0, 1000.0).select("symbol", day(), "ok")


@query(f"WITH {SEG}, ix AS (SELECT date, sum(amount) / sum(volume) AS close FROM seg GROUP BY 1), b AS (SELECT date, ln(close) - lag(ln(close), 20) OVER (ORDER BY date) AS b FROM ix), s AS (SELECT symbol, date, ln(close) - lag(ln(close), 20) OVER (PARTITION BY symbol ORDER BY date) AS m FROM seg), x AS (SELECT symbol, date, m - b AS score FROM s LEFT JOIN b USING (date)) SELECT symbol, CAST(date AS VARCHAR) AS date, round(score, 6) AS score, score IS NOT NULL AND row_number() OVER (PARTITION BY date ORDER BY score DESC NULLS LAST, symbol) <= greatest(1, count(score) OVER (PARTITION BY date) * 0.4) AS ok FROM x")
def relative_strength(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.segment_prices(spark, sf_dir)
    index = p.groupBy("date").agg((F.sum("amount") / F.sum("volume")).alias("close"))
    return gates.relative_strength(p, index, 20, 0.4).select("symbol", day(), r6("score", "score"), "ok")


@query(f"WITH {EV} SELECT * FROM (SELECT unnest(['symbol_null', 'date_null', 'volume_null', 'amount_null', 'price_positive', 'order_high', 'order_low', 'volume_positive', 'amount_positive', 'key_repeats']) AS rule, unnest([0, 0, 0, 0, count(*) FILTER (NOT (close > 0 AND open > 0)), 0, 0, 0, count(*) FILTER (amount < 0), 0]) AS bad FROM ev)")
def schema_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return validation.report(panels.event_bars(spark, sf_dir), validation.DAILY)
