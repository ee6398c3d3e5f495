"""Queries of classifiers on purged folds: scores, importances, search, walking backtests and orthogonal features."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..catalog import COL, NAT, day, query, r6
from ..models import classifiers, orthogonal, scores, trees
from ..models import design as designs
from ..operators import bootstrap, folds, regimes
from ..plans import panels
from ..session import ship, table

FEATURES = ["momentum", "crowding", "jump", "turn"]
HOLD, FOLDS, EMBARGO = 5, 4, 0.01
_BY = "OVER (PARTITION BY symbol ORDER BY date)"
_SAMPLES = f"""{NAT}, raw AS (SELECT symbol, date, ln(close / lag(close, 5) {_BY}) AS momentum, volume / avg(volume) OVER (PARTITION BY symbol ORDER BY date ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) - 1 AS crowding,
 close / lag(close) {_BY} - 1 AS jump, ln(amount / lag(amount, 3) {_BY}) AS turn, lead(date, {HOLD}) {_BY} AS t1, ln(lead(close, {HOLD}) {_BY} / close) AS gain FROM nat),
 sm AS (SELECT symbol || '|' || strftime(date, '%Y%m%d') AS event_id, symbol, date AS event_start, t1, {", ".join(FEATURES)}, CASE WHEN gain > 0 THEN 1 ELSE 0 END AS y, abs(gain) AS weight FROM raw WHERE momentum IS NOT NULL AND t1 IS NOT NULL)"""


def _samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled samples of the nations' panel: four features, whether the price rises over the next sessions, and by how much."""
    by = W.partitionBy("symbol").orderBy("date")
    back = lambda c, n: F.ln(COL(c) / F.lag(c, n).over(by))
    raw = panels.nation_flow(spark, sf_dir).select(
        "symbol", "date", back("close", 5).alias("momentum"), (COL("volume") / F.avg("volume").over(by.rowsBetween(-9, 0)) - 1).alias("crowding"), (COL("close") / F.lag("close").over(by) - 1).alias("jump"),
        back("amount", 3).alias("turn"), F.lead("date", HOLD).over(by).alias("t1"), F.ln(F.lead("close", HOLD).over(by) / COL("close")).alias("gain"), F.row_number().over(by).alias("bar"),
    )
    kept = raw.where("momentum is not null and t1 is not null")
    return kept.select(F.concat("symbol", F.lit("|"), F.date_format("date", "yyyyMMdd")).alias("event_id"), "symbol", COL("date").alias("event_start"), "t1", *FEATURES, (COL("gain") > 0).cast("int").alias("y"), F.abs("gain").alias("weight"), "bar")


def _design(spark: SparkSession, sf_dir: str, keep: tuple = ()) -> designs.Design:
    s = _samples(spark, sf_dir)
    return designs.design(s, FEATURES, folds.purged_folds(s, FOLDS, EMBARGO), weight="weight", keep=list(keep))


_PURGED = f"""pl AS (SELECT *, row_number() OVER (ORDER BY event_start, event_id) - 1 AS i, count(*) OVER () AS n FROM sm),
 fo AS (SELECT *, CASE WHEN i < (n // {FOLDS} + 1) * (n % {FOLDS}) THEN i // (n // {FOLDS} + 1) ELSE n % {FOLDS} + (i - (n // {FOLDS} + 1) * (n % {FOLDS})) // (n // {FOLDS}) END AS own FROM pl),
 sp AS (SELECT own AS fold, min(event_start) AS lo, max(t1) AS hi, any_value(n) AS n FROM fo GROUP BY 1),
 ends AS (SELECT fold, lo, n, coalesce((SELECT min(i) FROM fo WHERE fo.event_start > sp.hi), n) AS rgt FROM sp),
 mb AS (SELECT e.fold, fo.*, CASE WHEN own = e.fold THEN 'test' ELSE 'train' END AS part FROM ends e, fo WHERE own = e.fold OR t1 < lo OR i >= rgt + floor(e.n * {EMBARGO}))"""
_WALK = """pl AS (SELECT *, row_number() OVER (ORDER BY event_start, event_id) - 1 AS i, count(*) OVER () AS n FROM sm),
 ed AS (SELECT s AS fold, floor(s * (n / 5)) AS lo, CASE WHEN s = 4 THEN n ELSE floor((s + 1) * (n / 5)) END AS hi FROM range(1, 5) r(s), (SELECT max(n) AS n FROM pl)),
 mb AS (SELECT ed.fold, pl.*, CASE WHEN i < lo THEN 'train' ELSE 'test' END AS part FROM pl, ed WHERE i < lo - 10 OR (i >= lo AND i < hi))"""


def _bayes(test: str = "SELECT fold, event_id, y, weight, " + ", ".join(FEATURES) + " FROM mb WHERE part = 'test'", features: list[str] = FEATURES, smooth: str = "1e-9", more: str = "") -> str:
    """SQL of the Gaussian classifier: st has each fold's classes, pr the probability of 1 for each row of ``test``; ``more``: further columns of the rows, by which fits do not differ but for ``smooth``."""
    mean = ", ".join(f"sum(weight * {f}) / sum(weight) AS m_{f}, sum(weight * {f} * {f}) / sum(weight) - pow(sum(weight * {f}) / sum(weight), 2) AS v_{f}" for f in features)
    log = " ".join(f"- 0.5 * (ln(2 * pi() * (s.v_{f} + {smooth} * a.v_{f})) + pow(te.{f} - s.m_{f}, 2) / (s.v_{f} + {smooth} * a.v_{f}))" for f in features)
    return f"""st AS (SELECT fold, y, sum(weight) AS w, {mean} FROM mb WHERE part = 'train' GROUP BY 1, 2),
 al AS (SELECT fold, sum(weight) AS w, {mean} FROM mb WHERE part = 'train' GROUP BY 1),
 te AS ({test}),
 lg AS (SELECT te.fold, te.event_id, te.y, te.weight{more}, sum(CASE WHEN s.y = 1 THEN l ELSE -l END) AS d FROM te JOIN st s ON s.fold = te.fold JOIN al a ON a.fold = te.fold, LATERAL (SELECT ln(s.w / a.w) {log} AS l) GROUP BY ALL),
 pr AS (SELECT *, 1 / (1 + exp(-d)) AS p FROM lg)"""


_LOSS = "sum(weight * -ln(least(greatest(CASE WHEN y = 1 THEN p ELSE 1 - p END, 2.220446049250313e-16), 1 - 2.220446049250313e-16))) / sum(weight)"
_HITS = "sum(weight) FILTER ((p > 0.5) = (y = 1)) / sum(weight)"
_F1 = "2 * sum(weight) FILTER (p > 0.5 AND y = 1) / (2 * sum(weight) FILTER (p > 0.5 AND y = 1) + coalesce(sum(weight) FILTER (p > 0.5 AND y = 0), 0) + coalesce(sum(weight) FILTER (p <= 0.5 AND y = 1), 0))"
_ROUND = "round(-{0}, 6) AS neg_log_loss, round({1}, 6) AS accuracy, round(coalesce({2}, 0), 6) AS f1".format(_LOSS, _HITS, _F1)


def _told(df: DataFrame, *keys: str) -> DataFrame:
    return df.select(*keys, r6("neg_log_loss", "neg_log_loss"), r6("accuracy", "accuracy"), r6("f1", "f1"))


@query(f"WITH {_SAMPLES} SELECT event_id, CAST(event_start AS VARCHAR) AS date, CAST(t1 AS VARCHAR) AS t1, {', '.join(f'round({f}, 6) AS {f}' for f in FEATURES)}, y, round(weight, 6) AS weight FROM sm")
def model_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = lambda c, name: F.date_format(c, "yyyy-MM-dd").alias(name)
    return _samples(spark, sf_dir).select("event_id", d("event_start", "date"), d("t1", "t1"), *(r6(f, f) for f in FEATURES), "y", r6("weight", "weight"))


@query(f"WITH {_SAMPLES}, {_PURGED}, {_bayes()} SELECT CAST(fold AS INTEGER) AS fold, {_ROUND} FROM pr GROUP BY 1")
def cv_scores_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted scores of a Gaussian classifier on purged folds."""
    return _told(scores.cv_score(_design(spark, sf_dir), classifiers.Bayes()), "fold")


@query()
def cv_scores_logistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same folds by logistic regression: all folds in each pass of Newton's method."""
    return _told(scores.cv_score(_design(spark, sf_dir), classifiers.Logistic()), "fold")


_PERMUTED = f"""lf AS (SELECT *, row_number() OVER (PARTITION BY fold ORDER BY md5('rows|' || event_id), event_id) AS k FROM mb WHERE part = 'test'),
 rt AS (SELECT fold, {', '.join(f'{f} AS o_{f}' for f in FEATURES)}, row_number() OVER (PARTITION BY fold ORDER BY md5('seed 3|' || event_id), event_id) AS k FROM mb WHERE part = 'test')"""
_VARIANTS = " UNION ALL ".join(f"SELECT fold, event_id, y, weight, {', '.join(f'o_{f} AS {f}' if f == g else f for f in FEATURES)}, '{g}' AS feature FROM lf JOIN rt USING (fold, k)" for g in ["", *FEATURES])


@query(f"WITH {_SAMPLES}, {_PURGED}, {_PERMUTED}, {_bayes(_VARIANTS, more=', te.feature')}, sc AS (SELECT fold, feature, -({_LOSS}) AS s FROM pr GROUP BY 1, 2), im AS (SELECT a.feature, (b.s - a.s) / nullif(-a.s, 0) AS share FROM sc a JOIN sc b ON b.fold = a.fold AND b.feature = '' WHERE a.feature <> '') SELECT feature, round(avg(coalesce(share, 0)), 6) AS mean, round(stddev_samp(coalesce(share, 0)) / sqrt(count(*)), 6) AS std FROM im GROUP BY 1")
def importance_mda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each feature's permutation inside the test folds costs."""
    return scores.feat_imp_mda(_design(spark, sf_dir), classifiers.Bayes(), seed=3)[0].select("feature", r6("mean", "mean"), r6("std", "std"))


_ALONE = ", ".join(f"s_{f} AS (WITH {_bayes(features=[f])} SELECT '{f}' AS feature, fold, -({_LOSS}) AS s FROM pr GROUP BY fold)" for f in FEATURES)


@query(f"WITH {_SAMPLES}, {_PURGED}, {_ALONE} SELECT feature, round(avg(s), 6) AS mean, round(stddev_pop(s) / sqrt(count(*)), 6) AS std FROM ({' UNION ALL '.join(f'SELECT * FROM s_{f}' for f in FEATURES)}) GROUP BY 1")
def importance_sfi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each feature's own score."""
    return scores.feat_imp_sfi(_design(spark, sf_dir), classifiers.Bayes()).select("feature", r6("mean", "mean"), r6("std", "std"))


@query()
def importance_mdi(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Impurity importances of bagged trees whose bags are drawn by uniqueness among overlapping samples."""
    s = _samples(spark, sf_dir)
    placed = s.select("event_id", "symbol", COL("bar").alias("first"), (COL("bar") + HOLD).alias("last"))
    bags = bootstrap.bags(placed, 16, seed=5)
    d = designs.design(s.join(bags, "event_id"), FEATURES, folds.purged_folds(s, FOLDS, EMBARGO), weight="weight", keep=["copies"])
    fitted = trees.BaggedTrees(16, 16, seed=5).fit(d, [d.trial(depth=4, least=0.5)])
    return scores.feat_imp_mdi(d, fitted).select("feature", r6("mean", "mean"), r6("std", "std"))


@query()
def cv_scores_bagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purged folds by bagged trees; bags hold a row as often as a Poisson number of the mean of a sample's uniqueness."""
    s = _samples(spark, sf_dir).withColumn("copies", designs.poisson_bags(1 / (1 + HOLD), 16, 5))
    d = designs.design(s, FEATURES, folds.purged_folds(s, FOLDS, EMBARGO), weight="weight", keep=["copies"])
    return _told(scores.cv_score(d, trees.BaggedTrees(16, 16, seed=5), [d.trial(depth=4, least=0.5)]), "fold")


_DRAWS, _LOW, _HIGH = 6, 1e-4, 10.0
_TRIALS = f"tr AS (SELECT t AS trial, {_LOW} * pow({_HIGH / _LOW}, (('0x' || substr(md5('9|' || t || '|smooth'), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE) AS smooth FROM range({_DRAWS}) r(t))"


@query(f"WITH tr AS (SELECT c_custkey, {_LOW} * pow({_HIGH / _LOW}, (('0x' || substr(md5('9|' || c_custkey || '|smooth'), 1, 8))::BIGINT)::DOUBLE / 4294967296.0::DOUBLE) AS v FROM customer) SELECT c_custkey, round(v, 9) AS v, round(ln(v / {_LOW}) / ln({_HIGH / _LOW}), 9) AS cdf FROM tr")
def log_uniform_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A draw for each customer, by the quantile function as a column, and where it stands in the distribution."""
    drawn = table(spark, sf_dir, "customer").select("c_custkey", scores.LogUniform(_LOW, _HIGH).quantile(scores.uniform(9, COL("c_custkey"), "smooth")).alias("v"))
    return drawn.select("c_custkey", r6("v", "v", 9), r6(F.ln(COL("v") / _LOW) / math.log(_HIGH / _LOW), "cdf", 9))


_SEARCH = f"SELECT fold, event_id, y, weight, {', '.join(FEATURES)}, trial, smooth FROM mb, tr WHERE part = 'test'"


@query(f"WITH {_SAMPLES}, {_PURGED}, {_TRIALS}, {_bayes(_SEARCH, smooth='te.smooth', more=', te.trial')}, sc AS (SELECT trial, fold, coalesce({_F1}, 0) AS s FROM pr GROUP BY 1, 2), av AS (SELECT trial, avg(s) AS score, stddev_pop(s) / sqrt(count(*)) AS error FROM sc GROUP BY 1) SELECT CAST(trial AS INTEGER) AS trial, round(score, 6) AS score, round(error, 6) AS error, trial = first_value(trial) OVER (ORDER BY score DESC, trial) AS best FROM av")
def hyper_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Drawn trials by folds, fitted and scored together."""
    d = _design(spark, sf_dir)
    grid = {"smooth": scores.LogUniform(_LOW, _HIGH)}
    got, best = scores.clf_hyper_fit(d, classifiers.Bayes(), grid, _DRAWS, 9)
    at = scores.trials_of(d, grid, _DRAWS, 9).index(best)
    return got.select("trial", r6("score", "score"), r6("error", "error"), (COL("trial") == at).alias("best"))


@query(f"WITH {_SAMPLES}, {_WALK}, {_bayes()}, k AS (SELECT fold, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test FROM mb GROUP BY 1) SELECT CAST(pr.fold AS INTEGER) AS fold, any_value(n_train) AS n_train, any_value(n_test) AS n_test, {_ROUND} FROM pr JOIN k ON k.fold = pr.fold GROUP BY 1")
def walk_forward_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each block by a model of all before it."""
    s = _samples(spark, sf_dir)
    d = designs.design(s, FEATURES, folds.walk_forward(s, 5, 10), weight="weight")
    return _told(scores.walk_forward_backtest(d, classifiers.Bayes())[1], "fold", "n_train", "n_test")


@query(f"WITH {_SAMPLES}, {_WALK}, {_bayes()} SELECT event_id, CAST(fold AS INTEGER) AS fold, y, CASE WHEN p > 0.5 THEN 1 ELSE 0 END AS guess, round(p, 6) AS p FROM pr")
def walk_forward_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _samples(spark, sf_dir)
    d = designs.design(s, FEATURES, folds.walk_forward(s, 5, 10), weight="weight")
    return scores.walk_forward_backtest(d, classifiers.Bayes())[0].select("event_id", "fold", "y", "guess", r6(COL("p")[1], "p"))


@query(f"WITH {_SAMPLES}, z AS (SELECT {', '.join(f'coalesce(({f} - avg({f}) OVER ()) / stddev_pop({f}) OVER (), 0) AS {f}' for f in FEATURES)} FROM sm) " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(sum({a} * {b}), 4) AS dot FROM z" for i, a in enumerate(FEATURES) for b in FEATURES[i:]))
def feature_gram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of products of standard scores."""
    return orthogonal.gram(_samples(spark, sf_dir), FEATURES).select("a", "b", r6("dot", "dot", 4))


@query(f"WITH {_SAMPLES} SELECT 'PC_' || a AS a, 'PC_' || b AS b, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS corr FROM range(1, 5) x(a), range(1, 5) y(b) WHERE a <= b AND (SELECT count(*) FROM sm) > 1")
def orthogonal_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Correlations of the components of all variance: none but with themselves."""
    p, _, _ = orthogonal.orthogonalize_features(_samples(spark, sf_dir), FEATURES, ["event_id"], 1.0)
    names = [c for c in p.columns if c != "event_id"]
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i:]]
    got = p.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    return got.select(F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), (F.round(f"{a}|{b}", 6) + 0.0).alias("corr")) for a, b in pairs))).alias("e")).select("e.*")


@query()
def hmm_trend_entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a segment's prices enter their trending state, by a model fitted to each day's window."""
    return regimes.trend_entries(panels.segment_prices(ship(spark), sf_dir)).select("symbol", day())


@query()
def hmm_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Filtered probability of the wilder regime of all nations' prices, by a model pooled over them."""
    returns = regimes.log_returns(panels.nation_flow(ship(spark), sf_dir))
    model, _ = regimes.fit_pooled(returns)
    return regimes.filtered(returns, model).select("symbol", day(), r6("p", "p"))
