"""Cross-validated scores, importances of features, search over parameters, and walking backtests, over any classifier.

All folds, trials and permuted columns are scored in one pass: tasks add up weights, losses and hits by key, and nothing but
those sums moves.
"""

from __future__ import annotations

import itertools
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .classifiers import arrays, rows_in
from .design import Design, Trial, with_partner

SCORES = ("neg_log_loss", "accuracy", "f1")
EPS = float(np.finfo(float).eps)


def _sums(design: Design, rows: DataFrame, fitted, variants: list[tuple[int, int]]) -> DataFrame:
    """(trial, fold, permuted, w, loss, hit, tp, fp, fn) of test rows; a variant is a trial and the column taken from ``other`` (-1: none)."""
    held = rows.sparkSession.sparkContext.broadcast((fitted, variants))  # models of bounded size
    folds, classes = design.folds, design.classes
    positive = classes.index(1) if 1 in classes else -1

    def run(batches):
        fitted, variants = held.value
        total: dict = {}
        for batch in batches:
            a = arrays(batch)
            other = batch.column("other").flatten().to_numpy(zero_copy_only=False).reshape(a["n"], -1) if "other" in batch.schema.names and a["n"] else None
            for f in folds:
                rows = rows_in(a, "test", f)
                if not len(rows):
                    continue
                y, w = np.searchsorted(classes, a["y"][rows]), a["weight"][rows]
                for t, column in variants:
                    x = a["x"][rows]
                    if column >= 0:
                        x = x.copy()
                        x[:, column] = other[rows, column]
                    p = fitted.proba(t, f, x)
                    guess = p.argmax(axis=1)
                    loss = -np.log(np.clip(p[np.arange(len(y)), y], EPS, 1 - EPS))
                    yes, said = y == positive, guess == positive
                    total[t, f, column] = total.get((t, f, column), 0) + np.array([w.sum(), (w * loss).sum(), w[guess == y].sum(), w[yes & said].sum(), w[~yes & said].sum(), w[yes & ~said].sum()])
        keys = list(total)
        yield pa.RecordBatch.from_arrays([*(pa.array([k[i] for k in keys], pa.int32()) for i in range(3)), *(pa.array([total[k][i] for k in keys], pa.float64()) for i in range(6))], ["trial", "fold", "permuted", "w", "loss", "hit", "tp", "fp", "fn"])

    out = rows.select("x", "y", "weight", "test", *(["other"] if "other" in rows.columns else [])).mapInArrow(run, "trial int, fold int, permuted int, w double, loss double, hit double, tp double, fp double, fn double")
    return out.groupBy("trial", "fold", "permuted").agg(*(F.sum(c).alias(c) for c in ("w", "loss", "hit", "tp", "fp", "fn")))


def _scored(sums: DataFrame) -> DataFrame:
    """Scores from sums: weighted, null where no weight stands below."""
    over = lambda a, b: F.try_divide(a, b)
    tp2 = 2 * F.col("tp")
    return sums.select("trial", "fold", "permuted", (-over(F.col("loss"), F.col("w"))).alias("neg_log_loss"), over(F.col("hit"), F.col("w")).alias("accuracy"), F.coalesce(over(tp2, tp2 + F.col("fp") + F.col("fn")), F.lit(0.0)).alias("f1"))


def cv_score(design: Design, classifier, trials: list[Trial] | None = None) -> DataFrame:
    """(trial, fold, neg_log_loss, accuracy, f1): each fold's model scored on its test rows, weights in fit and score."""
    trials = trials or [design.trial()]
    fitted = classifier.fit(design, trials)
    return _scored(_sums(design, design.rows, fitted, [(t, -1) for t in range(len(trials))])).drop("permuted")


def feat_imp_mda(design: Design, classifier, scoring: str = "neg_log_loss", seed: int = 0, trial: Trial | None = None) -> tuple[DataFrame, DataFrame]:
    """(feature, mean, std) and (baseline): how much of the score each column holds, by permuting it inside each test fold.

    A fold's fall of the score is taken as a share of what could be lost: of the permuted loss, or of the permuted error; shares that
    do not exist count as 0.  std is the error of the mean over folds.
    """
    if scoring not in ("neg_log_loss", "accuracy"):
        raise ValueError(scoring)
    trial = trial or design.trial()
    fitted = classifier.fit(design, [trial])
    got = _scored(_sums(design, with_partner(design.rows, seed), fitted, [(0, c) for c in (-1, *trial.columns)])).select("fold", "permuted", F.col(scoring).alias("score"))
    base = got.where("permuted = -1").select("fold", F.col("score").alias("base"))
    room = -F.col("score") if scoring == "neg_log_loss" else 1 - F.col("score")
    share = F.coalesce(F.try_divide(F.col("base") - F.col("score"), room), F.lit(0.0))
    each = got.where("permuted >= 0").join(F.broadcast(base), "fold").withColumn("share", share)  # a row a fold
    names = F.array(*map(F.lit, design.names))
    out = each.groupBy("permuted").agg(F.avg("share").alias("mean"), (F.stddev_samp("share") / F.sqrt(F.count("*"))).alias("std"))
    return out.select(F.element_at(names, F.col("permuted") + 1).alias("feature"), "mean", "std"), base.agg(F.avg("base").alias("baseline"))


def feat_imp_sfi(design: Design, classifier, scoring: str = "neg_log_loss", **params) -> DataFrame:
    """(feature, mean, std): the score of each feature alone, all of them fitted together; std is the population's over folds, over its root."""
    trials = [Trial((j,), params) for j in range(len(design.names))]
    got = cv_score(design, classifier, trials)
    out = got.groupBy("trial").agg(F.avg(scoring).alias("mean"), F.when(F.count("*") > 1, F.stddev_pop(scoring) / F.sqrt(F.count("*"))).otherwise(0.0).alias("std"))
    return out.select(F.element_at(F.array(*map(F.lit, design.names)), F.col("trial") + 1).alias("feature"), "mean", "std")


def feat_imp_mdi(design: Design, fitted, trial: int = 0, fold: int = 0) -> DataFrame:
    """(feature, mean, std): the mean share of a feature over the trees that use it, means scaled to add up to one."""
    rows = [(design.names[j], v) for t, f, _, j, v in fitted.importances(len(design.names)) if (t, f) == (trial, fold)]  # a row a tree and feature
    got = design.rows.sparkSession.createDataFrame(rows, "feature string, v double")
    used = F.when(F.col("v") != 0, F.col("v"))
    each = got.groupBy("feature").agg(F.avg(used).alias("mean"), (F.stddev_samp(used) / math.sqrt(fitted.bags)).alias("std"))
    total = each.agg(F.sum("mean").alias("_total"))
    whole = F.when(F.col("_total") > 0, F.col("_total")).otherwise(1.0)
    return each.join(F.broadcast(total)).select("feature", (F.col("mean") / whole).alias("mean"), (F.col("std") / whole).alias("std"))


# ---- search ----------------------------------------------------------------------------------------------------


def uniform(seed: int, draw: int | Column, name: str) -> float | Column:
    """A number in [0, 1) from a digest of seed, number of the draw and name; in Python or as a column."""
    if isinstance(draw, Column):
        digest = F.md5(F.concat(F.lit(f"{seed}|"), draw.cast("string"), F.lit(f"|{name}")).cast("binary"))
        return F.conv(F.substring(digest, 1, 8), 16, 10).cast("double") / 4294967296.0
    import hashlib

    return int(hashlib.md5(f"{seed}|{draw}|{name}".encode()).hexdigest()[:8], 16) / 4294967296.0


class LogUniform:
    """Numbers whose logarithm is uniform between those of a and b."""

    def __init__(self, a: float = 1.0, b: float = math.e):
        if not 0 < a < b:
            raise ValueError((a, b))
        self.a, self.b = a, b

    def quantile(self, u):
        return self.a * (self.b / self.a) ** u if not isinstance(u, Column) else F.lit(self.a) * F.pow(F.lit(self.b / self.a), u)

    def cdf(self, x: float) -> float:
        return min(1.0, max(0.0, math.log(x / self.a) / math.log(self.b / self.a))) if x > 0 else 0.0

    def pdf(self, x: float) -> float:
        return 1 / (x * math.log(self.b / self.a)) if self.a <= x <= self.b else 0.0


def trials_of(design: Design, grid: dict, draws: int = 0, seed: int = 0) -> list[Trial]:
    """Every combination of the grid's lists; or so many draws, of lists evenly and of distributions by their quantiles."""
    if not draws:
        return [design.trial(**dict(zip(grid, values))) for values in itertools.product(*grid.values())]
    pick = lambda d, name, values: values.quantile(uniform(seed, d, name)) if hasattr(values, "quantile") else values[int(uniform(seed, d, name) * len(values))]
    return [design.trial(**{name: pick(d, name, values) for name, values in grid.items()}) for d in range(draws)]


def clf_hyper_fit(design: Design, classifier, grid: dict, draws: int = 0, seed: int = 0) -> tuple[DataFrame, Trial]:
    """(trial, score, error of the mean) of all trials, fitted and scored on all folds together, and the best; f1 decides for labels 0 and 1, else the log loss, and of equal scores the first trial."""
    trials = trials_of(design, grid, draws, seed)
    scoring = "f1" if design.classes == [0, 1] else "neg_log_loss"
    got = cv_score(design, classifier, trials).groupBy("trial").agg(F.avg(scoring).alias("score"), (F.stddev_pop(scoring) / F.sqrt(F.count("*"))).alias("error"))
    rows = got.collect()  # a row a trial
    best = max(rows, key=lambda r: (r["score"], -r["trial"]))["trial"]
    return design.rows.sparkSession.createDataFrame(rows, got.schema), trials[best]


# ---- walking ---------------------------------------------------------------------------------------------------


def predictions(design: Design, fitted, trial: int = 0, keep: list[str] = ()) -> DataFrame:
    """(fold, event_id, y, weight, p array<double>, guess) of every test row, by the model of its fold."""
    held = design.rows.sparkSession.sparkContext.broadcast(fitted)
    folds, classes = design.folds, design.classes

    def run(batches):
        for batch in batches:
            a = arrays(batch)
            for f in folds:
                rows = rows_in(a, "test", f)
                if len(rows):
                    p = held.value.proba(trial, f, a["x"][rows])
                    at = pa.array(rows)
                    yield pa.RecordBatch.from_arrays([pa.array([f] * len(rows), pa.int32()), batch.column("event_id").take(at), batch.column("y").take(at), batch.column("weight").take(at), pa.array(list(p), pa.list_(pa.float64())), pa.array(np.array(classes)[p.argmax(axis=1)], pa.int32()), *(batch.column(c).take(at) for c in keep)], ["fold", "event_id", "y", "weight", "p", "guess", *keep])

    kinds = dict(design.rows.dtypes)
    schema = ", ".join(["fold int", f"event_id {kinds['event_id']}", "y int", "weight double", "p array<double>", "guess int", *(f"{c} {kinds[c]}" for c in keep)])
    return design.rows.select("event_id", "x", "y", "weight", "test", *keep).mapInArrow(run, schema)


def walk_forward_backtest(design: Design, classifier, trial: Trial | None = None, keep: list[str] = ()) -> tuple[DataFrame, DataFrame]:
    """Predictions of every tested row by the model of all rows before its split, and each split's scores with the rows trained and tested."""
    trial = trial or design.trial()
    fitted = classifier.fit(design, [trial])
    scores = _scored(_sums(design, design.rows, fitted, [(0, -1)])).drop("trial", "permuted")
    count = lambda part: design.rows.select(F.explode(part).alias("fold")).groupBy("fold").agg(F.count("*").alias(f"n_{part}"))
    return predictions(design, fitted, 0, keep), scores.join(count("train"), "fold", "left").join(count("test"), "fold", "left")
