"""Queries of splits, strategy risk and scores."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import _R, _SPANS, COL, EV, SEG, _returns, _spans, query, r6
from ..functions import stats
from ..operators import folds
from ..plans import panels
from ..plans.ordering import position

_PLACED = f"{EV}, {_SPANS}, pl AS (SELECT event_id, event_start, t1, row_number() OVER (ORDER BY event_start, event_id) - 1 AS i, count(*) OVER () AS n FROM sp)"
_CPCV = f"""{_PLACED}, ed AS (SELECT g, CASE WHEN g = 4 THEN n ELSE floor(g * (n / 4)) END AS lo FROM range(5) r(g), (SELECT max(n) AS n FROM pl)),
 gr AS (SELECT pl.*, (SELECT max(g) FROM ed WHERE g < 4 AND ed.lo <= pl.i) AS grp FROM pl),
 wn AS (SELECT grp AS g, min(event_start) AS lo, max(t1) AS hi FROM gr GROUP BY 1),
 sg AS (SELECT row_number() OVER (ORDER BY a.g, b.g) - 1 AS split, a.g AS g1, b.g AS g2 FROM range(4) a(g), range(4) b(g) WHERE a.g < b.g),
 nr AS (SELECT gr.event_id, wn.g, (gr.event_start <= wn.hi AND gr.t1 >= wn.lo) OR (gr.i >= ed.lo AND gr.i < ed.lo + floor(gr.n * 0.01)) AS near FROM gr, wn, ed WHERE ed.g = wn.g + 1),
 cp AS (SELECT sg.split, gr.event_id, gr.grp, CASE WHEN gr.grp IN (sg.g1, sg.g2) THEN 'test' WHEN NOT x.near AND NOT y.near THEN 'train' END AS part FROM gr, sg, nr x, nr y WHERE x.event_id = gr.event_id AND x.g = sg.g1 AND y.event_id = gr.event_id AND y.g = sg.g2)"""


def _cpcv(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.combinatorial_folds(_spans(spark, sf_dir)[0], 4, 2, 0.01)


@query(f"WITH {_CPCV} SELECT split, event_id, part FROM cp WHERE part IS NOT NULL")
def combinatorial_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cpcv(spark, sf_dir).select("split", "event_id", "part")


@query(f"WITH {_CPCV} SELECT event_id, split, row_number() OVER (PARTITION BY event_id ORDER BY split) - 1 AS path FROM cp WHERE part = 'test'")
def combinatorial_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cpcv(spark, sf_dir).where("part = 'test'").select("event_id", "split", "path")


@query(f"WITH {_PLACED}, ed AS (SELECT s AS split, floor(s * (n / 5)) AS lo, CASE WHEN s = 4 THEN n ELSE floor((s + 1) * (n / 5)) END AS hi FROM range(1, 5) r(s), (SELECT max(n) AS n FROM pl)) SELECT split, event_id, CASE WHEN i < lo THEN 'train' ELSE 'test' END AS part FROM pl, ed WHERE i < lo - 2 OR (i >= lo AND i < hi)")
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.walk_forward(_spans(spark, sf_dir)[0], 5, 2)


@query(f"WITH {EV}, x AS (SELECT symbol, date, row_number() OVER (ORDER BY date, symbol) - 1 AS i, sum(amount) OVER (ORDER BY date, symbol ROWS UNBOUNDED PRECEDING) AS total FROM ev) SELECT symbol, CAST(date AS VARCHAR) AS date, i, round(total, 3) AS total FROM x")
def global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions and running totals over a whole table in one order, without a single task over its rows."""
    from ..plans.ordering import running_sum

    p = panels.event_bars(spark, sf_dir).select("symbol", "date", "amount")
    out = running_sum(position(p, "date", ["symbol"]), "date", ["symbol"], "amount", "total")
    return out.select("symbol", F.date_format("date", "yyyy-MM-dd").alias("date"), "i", r6("total", "total", 3))


@query()
def deflated_sharpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probabilistic and deflated Sharpe ratios; moments are aggregated, the normal distribution runs over a row a symbol."""
    m = stats.moments(_returns(spark, sf_dir), ["symbol"])
    spread = m.agg(F.count(F.lit(1)).alias("trials"), F.coalesce(F.var_samp("sharpe"), F.lit(0.0)).alias("var"))
    return stats.deflate(m.join(F.broadcast(spread))).select("symbol", "n", r6("psr", "psr", 8), r6("dsr", "dsr", 8))


@query()
def overfit_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability of overfitting over sixteen chunks of sessions; what leaves the cluster is a row for each chunk and trial."""
    return stats.overfit_table(_returns(spark, sf_dir), 16)


@query(f"WITH {SEG}, {_R}, a AS (SELECT symbol, avg(r) FILTER (r > 0) AS up, avg(r) FILTER (r <= 0) AS down, avg(CASE WHEN r > 0 THEN 1.0 ELSE 0 END) AS p FROM rt WHERE r IS NOT NULL GROUP BY 1), c AS (SELECT *, (52 + 4.0) * (up - down) * (up - down) AS qa, (2 * 52 * down - 4.0 * (up - down)) * (up - down) AS qb, 52 * down * down AS qc FROM a), d AS (SELECT *, (-qb + sqrt(qb * qb - 4 * qa * qc)) / (2 * qa) AS need FROM c) SELECT symbol, round(p, 6) AS precision, round(need, 6) AS implied_precision, round(4.0 * power(up - down, 2) * p * (1 - p) / power((up - down) * p + down, 2), 4) AS implied_freq FROM d")
def strategy_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision that a target Sharpe ratio of 2 asks of 52 bets a year, and bets that the precision found asks for."""
    bets = _returns(spark, sf_dir).groupBy("symbol").agg(F.avg(F.when(COL("r") > 0, COL("r"))).alias("up"), F.avg(F.when(COL("r") <= 0, COL("r"))).alias("down"), F.avg(F.when(COL("r") > 0, 1.0).otherwise(0.0)).alias("p"))
    need = stats.implied_precision(COL("down"), COL("up"), F.lit(52.0), F.lit(2.0))
    return bets.select("symbol", r6("p", "precision"), r6(need, "implied_precision"), r6(stats.implied_frequency(COL("down"), COL("up"), COL("p"), F.lit(2.0)), "implied_freq", 4))


@query()
def failure_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probability that precision falls below what the target asks for."""
    bets = _returns(spark, sf_dir).groupBy("symbol").agg(F.avg(F.when(COL("r") > 0, COL("r"))).alias("up"), F.avg(F.when(COL("r") <= 0, COL("r"))).alias("down"), F.avg(F.when(COL("r") > 0, 1.0).otherwise(0.0)).alias("p"))
    return stats.failure_probability(bets, 52.0, 2.0).select("symbol", r6("failure", "failure", 8))


_SCORED = f"{SEG}, sc AS (SELECT symbol, date, close > lag(close) OVER (PARTITION BY symbol ORDER BY date) AS y, lag(close) OVER (PARTITION BY symbol ORDER BY date) < lag(close, 2) OVER (PARTITION BY symbol ORDER BY date) AS yhat, volume AS wt FROM seg)"


@query(f"WITH {_SCORED}, t AS (SELECT symbol, sum(wt) FILTER (y AND yhat) AS tp, sum(wt) FILTER (yhat AND NOT y) AS fp, sum(wt) FILTER (y AND NOT yhat) AS fn, sum(wt) FILTER (y = yhat) AS hit, sum(wt) AS n, sum(wt * -ln(CASE WHEN y = yhat THEN 0.7 ELSE 0.3 END)) AS ll FROM sc WHERE y IS NOT NULL AND yhat IS NOT NULL GROUP BY 1) SELECT symbol, round(hit / n, 6) AS accuracy, round(tp / (tp + fp), 6) AS precision, round(tp / (tp + fn), 6) AS recall, round(2 * tp / (2 * tp + fp + fn), 6) AS f1, round(-ll / n, 6) AS neg_log_loss FROM t")
def classification_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted scores of a contrarian guess with probability 0.7."""
    by = W.partitionBy("symbol").orderBy("date")
    p = panels.segment_prices(spark, sf_dir).select("symbol", (COL("close") > F.lag("close").over(by)).alias("y"), (F.lag("close").over(by) < F.lag("close", 2).over(by)).alias("yhat"), COL("volume").alias("weight"))
    p = p.where("y is not null and yhat is not null").withColumn("prob", F.when(COL("yhat"), 0.7).otherwise(0.3))
    got = stats.classification_scores(p, ["symbol"])
    return got.select("symbol", *(r6(c, c) for c in ("accuracy", "precision", "recall", "f1", "neg_log_loss")))


@query()
def sequential_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draws of each symbol's overlapping events, by the uniqueness that each would have beside those drawn."""
    from ..operators.bootstrap import sequential_bootstrap as draw

    return draw(*_spans(spark, sf_dir), seed=7)


@query(f"WITH {EV}, {_SPANS} SELECT sp.event_id, CAST(ev.date AS VARCHAR) AS date FROM sp JOIN ev ON ev.symbol = sp.symbol AND ev.date BETWEEN sp.event_start AND sp.t1")
def indicator_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which bars each event spans, in sparse form."""
    from ..operators.bootstrap import indicator_matrix as matrix

    return matrix(*_spans(spark, sf_dir)).select("event_id", F.date_format("date", "yyyy-MM-dd").alias("date"))


