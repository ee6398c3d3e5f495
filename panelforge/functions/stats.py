"""Statistics of return series, portfolio weights and position sizes."""

from __future__ import annotations

import math
from itertools import combinations
from statistics import NormalDist

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

EULER = 0.5772156649015329
_NORMAL = NormalDist()
#: Assets whose covariances may be collected: 4 million numbers.
MOST_ASSETS = 2_000


def sharpe(returns: DataFrame, by: list[str], r: str = "r", periods: int = 252) -> DataFrame:
    """Mean over sample deviation, and annualised; 0 for fewer than two values or no deviation."""
    s = F.stddev_samp(r)
    value = F.when((F.count(r) < 2) | (s == 0) | s.isNull(), 0.0).otherwise(F.avg(r) / s)
    return returns.groupBy(*by).agg(value.alias("sharpe")).withColumn("annual", F.col("sharpe") * math.sqrt(periods))


def hhi(returns: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    """Concentration of returns: null for two or fewer."""
    n, s, q = F.count(r), F.sum(r), F.sum(F.col(r) * F.col(r))
    return returns.groupBy(*by).agg(F.when((n > 2) & (s != 0), (q / (s * s) - 1 / n) / (1 - 1 / n)).alias("hhi"))


def drawdowns(nav: DataFrame, by: str = "symbol") -> DataFrame:
    """(by, hwm, start, drawdown, tuw): one row for each high-water mark that was undercut, with years to the next one."""
    running = nav.withColumn("hwm", F.max("nav").over(W.partitionBy(by).orderBy("date").rowsBetween(W.unboundedPreceding, 0)))
    marks = running.groupBy(by, "hwm").agg(F.min("nav").alias("low"), F.min("date").alias("start")).where("hwm > low")
    after = F.lead("start").over(W.partitionBy(by).orderBy("start"))
    return marks.select(by, "hwm", "start", (1 - F.col("low") / F.col("hwm")).alias("drawdown"), (F.datediff(after, "start") / 365.25).alias("tuw"))


def probabilistic_sharpe(n: int, sharpe_: float, skew: float, kurt: float, benchmark: float = 0.0) -> float:
    """The probability that the true ratio is above a benchmark, from moments."""
    low = 1 - skew * sharpe_ + (kurt - 1) / 4 * sharpe_**2
    return _NORMAL.cdf((sharpe_ - benchmark) * math.sqrt(n - 1) / math.sqrt(low)) if n >= 4 and low > 0 else math.nan


def expected_max_sharpe(trials: int, variance: float = 1.0) -> float:
    if trials < 2:
        return 0.0
    return math.sqrt(variance) * ((1 - EULER) * _NORMAL.inv_cdf(1 - 1 / trials) + EULER * _NORMAL.inv_cdf(1 - 1 / (trials * math.e)))


def moments(returns: DataFrame, by: list[str], r: str = "r") -> DataFrame:
    """Count, Sharpe ratio and central moments over powers of the sample deviation."""
    base = returns.join(returns.groupBy(*by).agg(F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s")), by)
    d = F.col(r) - F.col("_m")
    return base.groupBy(*by).agg(F.count(r).alias("n"), (F.max("_m") / F.max("_s")).alias("sharpe"), (F.avg(d * d * d) / F.pow(F.max("_s"), 3)).alias("skew"), (F.avg(d * d * d * d) / F.pow(F.max("_s"), 4)).alias("kurt"))


def overfit_probability(sums: np.ndarray, counts: np.ndarray) -> float:
    """Combinatorially symmetric cross-validation from sums of each chunk and trial (chunks x trials): the share of splits whose best trial in sample is below the median out of it."""
    chunks, trials = sums.shape
    below = total = 0
    for pick in combinations(range(chunks), chunks // 2):
        own = np.zeros(chunks, bool)
        own[list(pick)] = True
        inside = sums[own].sum(0) / counts[own].sum()
        outside = sums[~own].sum(0) / counts[~own].sum()
        best = int(inside.argmax())
        rank = (outside < outside[best]).sum() / max(1, trials - 1)
        rank = min(max(rank, 1e-10), 1 - 1e-10)
        below += math.log(rank / (1 - rank)) < 0
        total += 1
    return below / total


def inverse_variance(returns: DataFrame) -> DataFrame:
    """(symbol, weight): inverse variances that sum to one."""
    v = returns.groupBy("symbol").agg((1 / F.var_samp("r")).alias("iv"))
    return v.join(F.broadcast(v.agg(F.sum("iv").alias("s")))).select("symbol", (F.col("iv") / F.col("s")).alias("weight"))


def covariance(returns: DataFrame) -> DataFrame:
    """(a, b, cov, corr): pairwise over common dates; the result is the square of the number of symbols, by definition."""
    x, y = returns.select(F.col("symbol").alias("a"), "date", F.col("r").alias("ra")), returns.select(F.col("symbol").alias("b"), "date", F.col("r").alias("rb"))
    return x.join(y, "date").groupBy("a", "b").agg(F.covar_samp("ra", "rb").alias("cov"), F.corr("ra", "rb").alias("corr"))


def hierarchical_parity(cov: np.ndarray, corr: np.ndarray) -> np.ndarray:
    """Weights by single linkage of correlation distance, leaf order and recursive bisection."""
    n = len(cov)
    dist = np.sqrt(np.clip((1 - corr) / 2, 0, None))
    groups = {i: [i] for i in range(n)}
    gap = {(i, j): float(np.linalg.norm(dist[i] - dist[j])) for i in range(n) for j in range(i)}
    new = n
    while len(groups) > 1:
        a, b = min(gap, key=lambda p: (gap[p], p))
        a, b = sorted((a, b))
        del gap[b, a]
        groups[new] = groups.pop(a) + groups.pop(b)
        for c in groups:
            if c != new:
                gap[new, c] = min(gap.pop((max(a, c), min(a, c))), gap.pop((max(b, c), min(b, c))))
        new += 1
    order = next(iter(groups.values()))

    def variance(items: list[int]) -> float:
        s = cov[np.ix_(items, items)]
        w = 1 / np.diag(s)
        w /= w.sum()
        return float(w @ s @ w)

    weight, work = np.ones(n), [order]
    while work:
        items = work.pop()
        if len(items) > 1:
            left, right = items[: len(items) // 2], items[len(items) // 2 :]
            a, b = variance(left), variance(right)
            share = 1 - a / (a + b)
            weight[left] *= share
            weight[right] *= 1 - share
            work += [left, right]
    return weight


def discretise(x: Column, step: float = 0.05) -> Column:
    """Rounded to steps, half to even, between -1 and 1."""
    return F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.bround(x / step) * step))


def sigmoid_size(w: Column, x: Column) -> Column:
    return x / F.sqrt(w + x * x)


def target_position(w: Column, forecast: Column, market: Column, most: int) -> Column:
    return (sigmoid_size(w, forecast - market) * most).cast("int")


def inverse_price(w: Column, forecast: Column, m: Column) -> Column:
    """The market price at which the sigmoid size is ``m``."""
    return forecast - m * F.sqrt(w / (1 - m * m))


def calibrate(x: Column, m: Column) -> Column:
    """The width at which a price gap ``x`` gives the size ``m``."""
    return x * x * (1 / (m * m) - 1)


def limit_price(target: Column, current: Column, forecast: Column, w: Column, most: int) -> Column:
    """The mean of the inverse prices of the positions on the way, over the size of the change; positions at the maximum are left out of the sum but not of the divisor.  Null where nothing changes."""
    change = target - current
    first, last = F.abs(current + F.signum(change)).cast("int"), F.abs(target).cast("int")
    way = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<int>"))
    inside = F.filter(way, lambda j: F.abs(j) < most)
    total = F.aggregate(inside, F.lit(0.0), lambda s, j: s + inverse_price(w, forecast, j / most))
    return F.when(change != 0, total / F.abs(change))


def signed_hhi(returns: DataFrame, by: list[str], positive: bool, r: str = "r") -> DataFrame:
    """Concentration of the returns of one sign."""
    return hhi(returns.where(F.col(r) >= 0 if positive else F.col(r) < 0), by, r)


def bet_sizes(p: Column, prediction: Column, classes: int = 2, side: Column | None = None) -> Column:
    """Size of a bet from the probability of its prediction, times its side."""
    p = F.least(F.greatest(p, F.lit(1e-6)), F.lit(1 - 1e-6))
    return (2 * _normal_cdf()((p - 1 / classes) / F.sqrt(p * (1 - p))) - 1) * prediction * (F.lit(1.0) if side is None else side)


def active_signals(signals: DataFrame) -> DataFrame:
    """(symbol, t, signal): at each start or end the mean of the signals that hold, by a sweep; none is 0."""
    on = signals.select("symbol", F.col("start").alias("t"), F.col("signal").alias("s"), F.lit(1).alias("n"))
    off = signals.where("t1 is not null").select("symbol", F.col("t1").alias("t"), -F.col("signal"), F.lit(-1))
    steps = on.union(off).groupBy("symbol", "t").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    w = W.partitionBy("symbol").orderBy("t").rowsBetween(W.unboundedPreceding, 0)
    return steps.select("symbol", "t", F.when(F.sum("n").over(w) > 0, F.sum("s").over(w) / F.sum("n").over(w)).otherwise(0.0).alias("signal"))


def bet_size(p: float, prediction: float, classes: int = 2) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return prediction * (2 * _NORMAL.cdf((p - 1 / classes) / math.sqrt(p * (1 - p))) - 1)


def _normal_cdf():
    @F.pandas_udf("double")
    def cdf(z: pd.Series) -> pd.Series:
        return z.map(lambda x: _NORMAL.cdf(x) if x == x else math.nan)

    return cdf


def deflate(m: DataFrame) -> DataFrame:
    """Adds ``psr`` and ``dsr`` to moments (n, sharpe, skew, kurt) with the trials and variance of the search; NaN where undefined."""

    @F.pandas_udf("struct<psr double, dsr double>")
    def both(n: pd.Series, s: pd.Series, skew: pd.Series, kurt: pd.Series, trials: pd.Series, var: pd.Series) -> pd.DataFrame:
        rows = zip(n, s, skew, kurt, trials, var)
        return pd.DataFrame([(probabilistic_sharpe(a, b, c, d), probabilistic_sharpe(a, b, c, d, expected_max_sharpe(t, v))) for a, b, c, d, t, v in rows], columns=["psr", "dsr"])

    return m.withColumn("_p", both("n", "sharpe", "skew", "kurt", "trials", "var")).select(*m.columns, "_p.psr", "_p.dsr")


def overfit_table(returns: DataFrame, chunks: int) -> DataFrame:
    """(trials, chunks, pbo) of returns (symbol, date, r): symbols are trials, sessions on which all have a return are rows.

    Rows are summed by chunk and trial first; the driver combines chunks x trials numbers.
    """
    names = returns.select("symbol").distinct().count()
    days = returns.groupBy("date").agg(F.count("r").alias("k")).where(F.col("k") == names).select("date")
    total = days.count()
    size = max(total // chunks, 1)
    numbered = days.withColumn("i", F.row_number().over(W.orderBy("date")) - 1).withColumn("chunk", F.least(F.floor(F.col("i") / size), F.lit(chunks - 1)))
    m = returns.join(numbered, "date").groupBy("chunk", "symbol").agg(F.sum("r").alias("s"), F.count("r").alias("n")).toPandas()
    if total < chunks or names < 2:
        value = math.nan
    else:
        value = overfit_probability(m.pivot(index="chunk", columns="symbol", values="s").to_numpy(), m.groupby("chunk")["n"].max().sort_index().to_numpy())
    return returns.sparkSession.createDataFrame([(names, chunks, value)], "trials long, chunks long, pbo double")


def implied_precision(down: Column, up: Column, freq: Column, target: Column) -> Column:
    """The least share of wins at which bets reach a Sharpe ratio: the larger root of a quadratic."""
    gap = up - down
    a, b, c = (freq + target * target) * gap * gap, (2 * freq * down - target * target * gap) * gap, freq * down * down
    return (-b + F.sqrt(b * b - 4 * a * c)) / (2 * a)


def implied_frequency(down: Column, up: Column, p: Column, target: Column) -> Column:
    gap = up - down
    return target * target * gap * gap * p * (1 - p) / ((gap * p + down) * (gap * p + down))


def failure_probability(bets: DataFrame, freq: float, target: float) -> DataFrame:
    """Adds ``failure`` to bets (up, down, p).  The scale is p(1 - p) itself, not its root, as the survey asks for."""
    need = implied_precision(F.col("down"), F.col("up"), F.lit(freq), F.lit(target))
    return bets.withColumn("failure", _normal_cdf()((need - F.col("p")) / F.nullif(F.col("p") * (1 - F.col("p")), F.lit(0.0))))


def classification_scores(scored: DataFrame, by: list[str]) -> DataFrame:
    """Weighted accuracy, precision, recall, F1 and negative log loss of rows (y, yhat boolean, prob of y, weight), in one pass."""
    w, y, g = F.col("weight"), F.col("y"), F.col("yhat")
    tp, fp, fn = (F.sum(F.when(t, w).otherwise(0)) for t in (y & g, ~y & g, y & ~g))
    p = F.least(F.greatest(F.when(y, F.col("prob")).otherwise(1 - F.col("prob")), F.lit(1e-15)), F.lit(1 - 1e-15))
    ratio = lambda a, b: F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))
    return scored.groupBy(*by).agg(ratio(F.sum(F.when(y == g, w).otherwise(0)), F.sum(w)).alias("accuracy"), ratio(tp, tp + fp).alias("precision"), ratio(tp, tp + fn).alias("recall"), ratio(2 * tp, 2 * tp + fp + fn).alias("f1"), (F.sum(w * F.ln(p)) / F.sum(w)).alias("neg_log_loss"))
