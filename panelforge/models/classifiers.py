"""Weighted classifiers fitted for all folds and trials at once by passes of partial sums over a design.

What leaves the cluster is a bounded number of sums for each fold and trial; fitted models are small and are broadcast to
predict.  Each has ``fit(design, trials)``, whose result gives ``proba(trial, fold, x)``: a row of class probabilities for
each row of x, in the order of ``design.classes``.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .design import Design, Trial


def arrays(batch: pa.RecordBatch) -> dict:
    """Columns of a batch of a design as numpy: x (rows x features), y, weight, and lists of folds as (row, fold) pairs."""
    n = batch.num_rows
    x = batch.column("x")
    out = {"n": n, "x": x.flatten().to_numpy(zero_copy_only=False).reshape(n, -1) if n else np.zeros((0, 0)), "y": batch.column("y").to_numpy(), "weight": batch.column("weight").to_numpy()}
    for name in ("train", "test"):
        if name in batch.schema.names:
            lists = batch.column(name)
            size = np.diff(lists.offsets.to_numpy())
            out[name] = (np.repeat(np.arange(n), size), lists.flatten().to_numpy())
    return out


def rows_in(a: dict, part: str, fold: int) -> np.ndarray:
    row, of = a[part]
    return row[of == fold]


def added(parts: DataFrame, *key: str) -> dict:
    """Sums of arrays ``s`` by key: element by element, so that they are combined before the shuffle; a bounded number of keys."""
    each = parts.select(*key, F.posexplode("s").alias("i", "v")).groupBy(*key, "i").agg(F.sum("v").alias("v"))
    out: dict = {}
    for r in each.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda p: p["v"]).alias("s")).collect():
        out[tuple(r[k] for k in key) if len(key) > 1 else r[key[0]]] = np.array(r["s"])
    return out


class Bayes:
    """Gaussian naive Bayes: weighted priors, means and variances of each class, by aggregates alone.

    Variances grow by ``smooth`` (a parameter of the trial, 1e-9) of the feature's variance over the fold's training rows.  A class without training rows has probability 0.
    """

    def fit(self, design: Design, trials: list[Trial]) -> FittedBayes:
        p = len(design.names)
        centre = design.rows.agg(*(F.avg(F.col("x")[j]).alias(f"c{j}") for j in range(p))).first()  # shifts against cancellation
        c = [float(v or 0.0) for v in centre]
        v = lambda j: F.col("x")[j] - c[j]
        sums = [F.sum("weight").alias("w"), *(F.sum(F.col("weight") * v(j)).alias(f"m{j}") for j in range(p)), *(F.sum(F.col("weight") * v(j) * v(j)).alias(f"q{j}") for j in range(p))]
        got = design.rows.select("x", "y", "weight", F.explode("train").alias("fold")).groupBy("fold", "y").agg(*sums).collect()  # a row a fold and class
        n = {f: np.zeros((len(design.classes), 1 + 2 * p)) for f in design.folds}
        for r in got:
            if r["fold"] in n:
                n[r["fold"]][design.classes.index(r["y"])] = [r["w"], *(r[f"m{j}"] for j in range(p)), *(r[f"q{j}"] for j in range(p))]
        return FittedBayes(design.classes, np.array(c), n, trials)


class FittedBayes:
    def __init__(self, classes: list[int], centre: np.ndarray, sums: dict[int, np.ndarray], trials: list[Trial]):
        self.classes, self.centre, self.sums, self.trials = classes, centre, sums, trials

    def proba(self, trial: int, fold: int, x: np.ndarray) -> np.ndarray:
        t, s, p = self.trials[trial], self.sums[fold], len(self.centre)
        w, total = s[:, :1], s.sum(axis=0)
        live = w[:, 0] > 0
        if not live.any():
            return np.full((len(x), len(w)), 1 / len(w))
        mean = np.where(w > 0, s[:, 1 : 1 + p] / np.where(w > 0, w, 1), 0)
        whole = total[1 + p :] / total[0] - (total[1 : 1 + p] / total[0]) ** 2
        var = np.where(w > 0, s[:, 1 + p :] / np.where(w > 0, w, 1), 0) - mean**2 + t.params.get("smooth", 1e-9) * whole
        var = np.maximum(var, 1e-300)
        cols = list(t.columns)
        z = (x - self.centre)[:, None, cols] - mean[None, :, cols]
        score = np.where(live, np.log(np.where(live, w[:, 0], 1) / total[0]), -np.inf) - 0.5 * (np.log(2 * np.pi * var[:, cols]) + z * z / var[:, cols]).sum(axis=2)
        score = np.exp(score - score.max(axis=1, keepdims=True))
        return score / score.sum(axis=1, keepdims=True)


class Logistic:
    """Multinomial logistic regression with an intercept and a ridge of 1 / (2 c) on slopes, by Newton's method over full passes.

    A pass sums loss, gradient and Hessian of every fold and trial at its candidate; a candidate that raises its loss is halved
    towards the last point.  ``rounds`` bounds passes; a fit that is not done by then raises.
    """

    def __init__(self, rounds: int = 60, tolerance: float = 1e-10):
        self.rounds, self.tolerance = rounds, tolerance

    def fit(self, design: Design, trials: list[Trial]) -> FittedLogistic:
        k = len(design.classes) - 1
        keys = [(t, f) for t in range(len(trials)) for f in design.folds]
        size = {t: k * (len(trials[t].columns) + 1) for t in range(len(trials))}
        now = {key: np.zeros(size[key[0]]) for key in keys}  # candidates
        kept: dict = {}  # (point, loss, step) last taken
        todo = list(keys)
        for _ in range(self.rounds):
            if not todo or not k:
                break
            sums = self._pass(design, trials, {key: now[key] for key in todo})
            left = []
            for key in todo:
                m = size[key[0]]
                s = sums.get(key, np.zeros(1 + m + m * m))
                ridge = np.tile(np.concatenate(([0.0], np.full(m // k - 1, 1 / trials[key[0]].params.get("c", 1.0)))), k)
                loss = s[0] + 0.5 * (ridge * now[key] ** 2).sum()
                if key in kept and loss > kept[key][1] * (1 + 1e-13) + 1e-300:
                    point, _, step = kept[key]
                    if np.abs(now[key] - point).max() <= self.tolerance * (1 + np.abs(point).max()):
                        now[key] = point
                        continue
                    now[key] = (now[key] + point) / 2
                    left.append(key)
                    continue
                grad, hess = s[1 : 1 + m] + ridge * now[key], s[1 + m :].reshape(m, m) + np.diag(ridge)
                step = np.linalg.lstsq(hess, grad, rcond=None)[0]
                kept[key] = now[key], loss, step
                if np.abs(step).max() > self.tolerance * (1 + np.abs(now[key]).max()):
                    now[key] = now[key] - step
                    left.append(key)
            todo = left
        if todo and k:
            raise ValueError(f"not converged in {self.rounds} rounds: {todo[:5]}")
        return FittedLogistic(design.classes, {key: now[key].reshape(k, len(trials[key[0]].columns) + 1) for key in keys}, trials)

    def _pass(self, design: Design, trials: list[Trial], at: dict) -> dict:
        held = design.rows.sparkSession.sparkContext.broadcast((at, trials, design.classes))  # a vector for each fold and trial

        def run(batches):
            now, trials, classes = held.value
            total: dict = {}
            for batch in batches:
                a = arrays(batch)
                for (t, f), beta in now.items():
                    rows = rows_in(a, "train", f)
                    if len(rows):
                        total[t, f] = total.get((t, f), 0) + _derivatives(a["x"][rows][:, list(trials[t].columns)], np.searchsorted(classes, a["y"][rows]), a["weight"][rows], beta, len(classes) - 1)
            keys = list(total)
            yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()), pa.array([total[k] for k in keys], pa.list_(pa.float64()))], ["trial", "fold", "s"])

        return added(design.rows.select("x", "y", "weight", "train").mapInArrow(run, "trial int, fold int, s array<double>"), "trial", "fold")


def _softmax(x: np.ndarray, beta: np.ndarray) -> np.ndarray:
    """Probabilities of the classes; the first has score 0."""
    z = np.column_stack((np.zeros(len(x)), np.column_stack((np.ones(len(x)), x)) @ beta.T))
    z = np.exp(z - z.max(axis=1, keepdims=True))
    return z / z.sum(axis=1, keepdims=True)


def _derivatives(x: np.ndarray, y: np.ndarray, w: np.ndarray, beta: np.ndarray, k: int) -> np.ndarray:
    """Loss, gradient and Hessian of weighted rows, end to end."""
    p = _softmax(x, beta.reshape(k, -1))
    one = np.column_stack((np.ones(len(x)), x))
    hit = np.zeros_like(p)
    hit[np.arange(len(y)), y] = 1
    grad = ((p - hit)[:, 1:] * w[:, None]).T @ one
    q = one.shape[1]
    hess = np.empty((k, q, k, q))
    for a in range(k):
        for b in range(a, k):
            block = (one * (w * p[:, a + 1] * ((a == b) - p[:, b + 1]))[:, None]).T @ one
            hess[a, :, b, :] = hess[b, :, a, :] = block
    loss = -(w * np.log(np.maximum(p[np.arange(len(y)), y], 1e-300))).sum()
    return np.concatenate(([loss], grad.ravel(), hess.ravel()))


class FittedLogistic:
    def __init__(self, classes: list[int], beta: dict, trials: list[Trial]):
        self.classes, self.beta, self.trials = classes, beta, trials

    def proba(self, trial: int, fold: int, x: np.ndarray) -> np.ndarray:
        return _softmax(x[:, list(self.trials[trial].columns)], self.beta[trial, fold])
