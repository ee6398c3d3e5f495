"""Queries of stores and streams.  Each run has its own folder under the shared one."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..catalog import _R, COL, EV, SEG, _returns, day, query, r6
from ..functions import stats
from ..plans import panels
from ..session import shared_dir
from ..sources.registry import TrialRegistry
from ..sources.shards import ShardStore


def _root(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"


@query(f"WITH {SEG} SELECT symbol, CAST(date AS VARCHAR) AS date, round(CASE WHEN month(date) % 2 = 0 THEN close * 2 ELSE close END, 4) AS close FROM seg WHERE date BETWEEN DATE '1995-02-10' AND DATE '1996-06-20'")
def sharded_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All prices written by month, those of even months corrected by a second write, a range read back."""
    p = panels.segment_prices(spark, sf_dir).select("symbol", "date", "close")
    store = ShardStore(spark, _root(spark), "daily")
    store.put(p)
    store.put(p.where(F.month("date") % 2 == 0).withColumn("close", COL("close") * 2))
    return store.get(None, "1995-02-10", "1996-06-20").select("symbol", day(), r6("close", "close", 4))


@query(f"WITH {SEG}, g AS (SELECT DISTINCT symbol FROM seg), m AS (SELECT CAST(unnest(generate_series(DATE '2001-05-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS m) SELECT symbol, strftime(m, '%Y-%m') AS ym FROM g, m WHERE NOT EXISTS (SELECT 1 FROM seg WHERE seg.symbol = g.symbol AND date_trunc('month', seg.date) = m.m)")
def missing_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = panels.segment_prices(spark, sf_dir).select("symbol", "date", "close")
    store = ShardStore(spark, _root(spark), "daily")
    store.put(p)
    return store.missing(p.select("symbol"), "2001-05-01", "2001-12-31")


@query(f"WITH {SEG}, {_R} SELECT symbol AS dataset_id, 1 AS n, round(avg(r) / stddev_samp(r), 6) AS sharpe FROM rt WHERE r IS NOT NULL GROUP BY 1")
def trial_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trials are recorded with JSON metrics and read back."""
    registry = TrialRegistry(spark, _root(spark))
    s = stats.sharpe(_returns(spark, sf_dir), ["symbol"])
    registry.record_all(s.select(COL("symbol").alias("dataset_id"), F.lit("{}").alias("config"), F.to_json(F.struct(COL("sharpe").alias("sharpe_ratio"))).alias("metrics")))
    value = F.get_json_object("metrics", "$.sharpe_ratio").cast("double")
    return registry.trials().groupBy("dataset_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.max(value), 6).alias("sharpe"))


@query(f"WITH {EV} SELECT symbol, CAST(date AS VARCHAR) AS date, round(open,6) AS open, round(high,6) AS high, round(low,6) AS low, round(close,6) AS close, volume, round(amount,4) AS amount FROM ev")
def streamed_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily bars by a stream over the events; equal to the batch."""
    from ..streaming.bars import stream_daily_bars

    got = stream_daily_bars(spark, sf_dir, _root(spark))
    return got.select("symbol", day(), *(r6(c, c) for c in ("open", "high", "low", "close")), "volume", r6("amount", "amount", 4))


@query("SELECT event_type AS symbol, event_id FROM (SELECT event_type, event_id, value, sum(value) OVER (PARTITION BY event_type ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM events) WHERE floor(s / 500) > floor((s - value) / 500)")
def streamed_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events at which a type's running total passes a multiple of 500, by a stateful stream."""
    from ..streaming.bars import stream_thresholds

    return stream_thresholds(spark, sf_dir, _root(spark), 500.0)


_WAITED = "WITH RECURSIVE m AS (SELECT event_type AS symbol, ts, value, row_number() OVER (PARTITION BY event_type ORDER BY ts) AS i, lag(value) OVER (PARTITION BY event_type ORDER BY ts) AS before FROM events WHERE value > 0), x AS (SELECT *, coalesce(ln(value / before), 0) AS d FROM m)"
_STEP = "c AS (SELECT symbol, ts, i, greatest(0, d) AS p, least(0, d) AS n, false AS f FROM x WHERE i = 1 UNION ALL SELECT x.symbol, x.ts, x.i, CASE WHEN least(0, n + d) >= -{0} AND greatest(0, p + d) > {0} THEN 0 ELSE greatest(0, p + d) END, CASE WHEN least(0, n + d) < -{0} THEN 0 ELSE least(0, n + d) END, least(0, n + d) < -{0} OR greatest(0, p + d) > {0} FROM c JOIN x ON x.symbol = c.symbol AND x.i = c.i + 1)"


@query(f"{_WAITED}, {_STEP.format(4.0)} SELECT symbol, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts FROM c WHERE f AND ts <= (SELECT max(ts) FROM events) - INTERVAL 3 DAY")
def streamed_cusum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CUSUM events of the stream of events by type, each given out once the watermark has passed it."""
    from ..streaming import machines
    from ..streaming.bars import events

    e = events(spark, sf_dir)
    v = lambda n: COL("value").alias(n)
    got = machines.drain(e.select(COL("event_type").alias("symbol"), "ts", v("high"), v("low"), v("close")), "cusum", (4.0,), None, _root(spark))
    return got.where("fired and not late").select("symbol", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("ts"))


_FIXED = "CASE WHEN month(date) % 2 = 0 THEN close * 2 ELSE close END"


@query(f"WITH {SEG}, k AS (SELECT * FROM seg WHERE date < DATE '2001-03-01') SELECT 'first' AS known, symbol, CAST(date AS VARCHAR) AS date, round(close, 4) AS close FROM seg UNION ALL SELECT 'second', symbol, CAST(date AS VARCHAR), round({_FIXED}, 4) FROM seg UNION ALL SELECT 'pruned', symbol, CAST(date AS VARCHAR), round({_FIXED}, 4) FROM k")
def commit_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices, their corrections and a pruning of stale months, each read as known at its time; the last after folding."""
    from ..sources.ledger import CommitStore

    p = panels.segment_prices(spark, sf_dir).select("symbol", "date", "close")
    store = CommitStore(spark, _root(spark), "daily")
    store.put(p, 1.0)
    store.put(p.where(F.month("date") % 2 == 0).withColumn("close", COL("close") * 2), 2.0)
    store.prune("2001-03", 3.0)
    store.compact(4.0)
    out = [store.get(known_at=t).select(F.lit(name).alias("known"), "symbol", day(), r6("close", "close", 4)) for name, t in (("first", 1.0), ("second", 2.5), ("pruned", 5.0))]
    return out[0].union(out[1]).union(out[2])


_GAPS = f"""{SEG}, cv AS (SELECT symbol, strftime(date, '%Y-%m') AS ym FROM seg GROUP BY 1, 2 HAVING count(*) % 3 <> 0), mo AS (SELECT CAST(unnest(generate_series(DATE '1995-01-01', DATE '2001-12-01', INTERVAL 1 MONTH)) AS DATE) AS m),
 ls AS (SELECT symbol, strftime(m, '%Y-%m') AS ym, year(m) * 12 + month(m) - row_number() OVER (PARTITION BY symbol ORDER BY m) AS run FROM (SELECT DISTINCT symbol FROM seg) q, mo WHERE NOT EXISTS (SELECT 1 FROM cv WHERE cv.symbol = q.symbol AND cv.ym = strftime(m, '%Y-%m') AND cv.ym < '2001-06')),
 rg AS (SELECT symbol, min(ym) AS first, max(ym) AS last, count(*) AS n FROM ls GROUP BY symbol, run)"""


def _gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..sources import ledger

    p = panels.segment_prices(spark, sf_dir).select("symbol", F.date_format("date", "yyyy-MM").alias("ym"))
    covered = p.groupBy("symbol", "ym").count().where("count % 3 <> 0")
    return ledger.ranges(ledger.missing(ledger.months(p, "1995-01-01", "2001-12-31"), covered, "2001-06-15"))


@query(f"WITH {_GAPS} SELECT symbol, first, last, n FROM rg")
def gap_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Months not covered, and all from the current one on, as ranges."""
    return _gaps(spark, sf_dir)


@query(f"WITH {_GAPS}, d AS (SELECT *, (row_number() OVER (PARTITION BY first, last ORDER BY symbol) - 1) // greatest(1, least(2, 6 // n)) AS call FROM rg) SELECT first, last, CAST(call AS INTEGER) AS call, string_agg(symbol, ',' ORDER BY symbol) AS symbols, CAST(sum(n) AS BIGINT) AS months FROM d GROUP BY 1, 2, 3")
def fetch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Symbols of the same range share a call, up to a workload."""
    from ..sources import ledger

    return ledger.plan(_gaps(spark, sf_dir), 2, 6).withColumn("symbols", F.array_join("symbols", ","))
