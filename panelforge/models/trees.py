"""Bagged decision trees on histograms, grown level by level for all folds, trials and bags at once.

A row carries how often each bag holds it (``copies``).  A level is one pass: tasks add up weights by (tree, node, feature, bin,
class) for the nodes still open, a group for each node adds what tasks found and picks the split of the greatest fall of
weighted entropy, and only splits reach the driver.  Trees are broadcast: their size is bounded by bags and depth.  Features of a
split are drawn from all by a hash of seed, tree and node; classes are balanced by the fold's weights if asked for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from .classifiers import arrays, rows_in
from .design import Design, Trial


def entropy(counts: np.ndarray) -> np.ndarray:
    """Weighted entropy (weight times bits) of class weights along the last axis."""
    total = counts.sum(axis=-1, keepdims=True)
    share = counts / np.where(total > 0, total, 1)
    return -(counts * np.log2(np.where(share > 0, share, 1))).sum(axis=-1)


def best_split(hist: np.ndarray, features: np.ndarray, least: float) -> tuple[float, int, int]:
    """(gain, feature, bin): of the given features, the cut whose sides hold ``least`` weight; rows of bins below the cut go left.  Gain 0 where none gains."""
    best = (0.0, -1, -1)
    whole = entropy(hist[features[0]].sum(axis=0))
    for j in sorted(features.tolist()):
        left = hist[j].cumsum(axis=0)[:-1]
        right = hist[j].sum(axis=0) - left
        gain = whole - entropy(left) - entropy(right)
        gain[(left.sum(axis=1) < least) | (right.sum(axis=1) < least)] = 0
        k = int(gain.argmax()) if len(gain) else 0
        if len(gain) and gain[k] > best[0] + 1e-9 * max(whole, 1e-300):
            best = (float(gain[k]), j, k + 1)
    return best


def drawn(seed: int, tree: int, node: int, columns: tuple[int, ...], share: str | float) -> np.ndarray:
    """The features that a node may split on."""
    k = max(1, int(len(columns) ** 0.5) if share == "sqrt" else int(round(share * len(columns))))
    return np.array(columns)[np.random.default_rng([seed, tree, node]).permutation(len(columns))[:k]]


class Tree:
    """Nodes in heap order: feature (-1: a leaf) and first bin of the right side; class weights of every node reached."""

    def __init__(self, depth: int, classes: int):
        self.feature = np.full(2**depth - 1 if depth else 0, -1, np.int32)
        self.bin = np.zeros(len(self.feature), np.int32)
        self.weights = np.zeros((2 ** (depth + 1) - 1, classes))

    def node(self, code: np.ndarray, depth: int) -> np.ndarray:
        """The node each row has come to after at most ``depth`` splits."""
        at = np.zeros(len(code), np.int64)
        for _ in range(depth):
            split = np.flatnonzero((at < len(self.feature)) & (self.feature[np.minimum(at, len(self.feature) - 1)] >= 0)) if len(self.feature) else at[:0]
            if not len(split):
                break
            here = at[split]
            at[split] = 2 * here + 1 + (code[split, self.feature[here]] >= self.bin[here])
        return at


class BaggedTrees:
    """parameters of a trial: depth (6), features ("sqrt" or a share), least (weight of a side, 1), balanced (True)."""

    def __init__(self, trees: int, bins: int = 32, seed: int = 0, edges: list[np.ndarray] | None = None, copies: str = "copies"):
        self.trees, self.bins, self.seed, self.given, self.copies = trees, bins, seed, edges, copies

    def edges(self, design: Design) -> list[np.ndarray]:
        """Inner edges of the bins of each feature: quantiles over all rows, ``bins - 1`` numbers a feature."""
        if self.given is not None:
            return self.given
        at = [i / self.bins for i in range(1, self.bins)]
        got = design.rows.agg(*(F.percentile_approx(F.col("x")[j], at, 100_000).alias(f"e{j}") for j in range(len(design.names)))).first()
        return [np.unique(np.array(e or [], float)) for e in got]

    def fit(self, design: Design, trials: list[Trial]) -> FittedTrees:
        spark, k, p = design.rows.sparkSession, len(design.classes), len(design.names)
        edges = self.edges(design)
        width = max([len(e) for e in edges], default=0) + 1
        mass = {(r["fold"], r["y"]): r["w"] for r in design.rows.select("y", "weight", F.explode("train").alias("fold")).groupBy("fold", "y").agg(F.sum("weight").alias("w")).collect()}
        balance = {}
        for f in design.folds:
            own = np.array([mass.get((f, c), 0.0) for c in design.classes])
            balance[f] = np.where(own > 0, own.sum() / (max((own > 0).sum(), 1) * np.where(own > 0, own, 1)), 0)
        depth = [t.params.get("depth", 6) for t in trials]
        fitted = FittedTrees(design.classes, edges, {(t, f, b): Tree(depth[t], k) for t in range(len(trials)) for f in design.folds for b in range(self.trees)}, trials, self.trees)
        copies = self.copies
        for level in range(max(depth, default=0) + 1):
            held = spark.sparkContext.broadcast((fitted, balance))  # nodes of all trees so far
            first, nodes = 2**level - 1, 2**level

            def gather(batches, held=held, level=level, first=first, nodes=nodes):
                fitted, balance = held.value
                total: dict = {}
                for batch in batches:
                    a = arrays(batch)
                    code = fitted.codes(a["x"])
                    y = np.searchsorted(fitted.classes, a["y"])
                    n = batch.column(copies)
                    often = n.flatten().to_numpy(zero_copy_only=False).reshape(a["n"], -1)
                    for (t, f, b), tree in fitted.trees.items():
                        params = fitted.trials[t].params
                        if level > params.get("depth", 6):
                            continue
                        rows = rows_in(a, "train", f)
                        rows = rows[often[rows, b] > 0]
                        at = tree.node(code[rows], level) - first
                        rows, at = rows[at >= 0], at[at >= 0]
                        if not len(rows):
                            continue
                        w = a["weight"][rows] * often[rows, b] * (balance[f][y[rows]] if params.get("balanced", True) else 1.0)
                        hist = total.setdefault((t, f, b), np.zeros((nodes, p, width, k)))
                        for j in range(p):
                            key = (at * width + code[rows, j]) * k + y[rows]
                            hist[:, j] += np.bincount(key, w, nodes * width * k).reshape(nodes, width, k)
                for (t, f, b), hist in total.items():
                    live = np.flatnonzero(hist[:, 0].sum(axis=(1, 2)))
                    yield pa.RecordBatch.from_arrays([*(pa.array([v] * len(live), pa.int32()) for v in (t, f, b)), pa.array(live + first, pa.int32()), pa.array([h.ravel() for h in hist[live]], pa.list_(pa.float64()))], ["trial", "fold", "bag", "node", "s"])

            seed, all_trials = self.seed, trials

            def choose(key, table, level=level):
                t, f, b, node = (v.as_py() for v in key)
                hist = np.sum([np.array(s) for s in table.column("s").to_pylist()], axis=0).reshape(p, width, k)
                params = all_trials[t].params
                gain, feature, cut = (0.0, -1, 0) if level == params.get("depth", 6) else best_split(hist, drawn(seed, b, node, all_trials[t].columns, params.get("features", "sqrt")), params.get("least", 1.0))
                return pa.table({"trial": pa.array([t], pa.int32()), "fold": pa.array([f], pa.int32()), "bag": pa.array([b], pa.int32()), "node": pa.array([node], pa.int32()), "gain": [gain], "feature": pa.array([feature], pa.int32()), "bin": pa.array([cut], pa.int32()), "weights": pa.array([hist[0].sum(axis=0)], pa.list_(pa.float64()))})

            hists = design.rows.select("x", "y", "weight", "train", copies).mapInArrow(gather, "trial int, fold int, bag int, node int, s array<double>")
            splits = hists.groupBy("trial", "fold", "bag", "node").applyInArrow(lambda key, t: choose(key, t), "trial int, fold int, bag int, node int, gain double, feature int, bin int, weights array<double>").collect()  # a row a node
            for r in splits:
                tree = fitted.trees[r["trial"], r["fold"], r["bag"]]
                tree.weights[r["node"]] = r["weights"]
                if r["feature"] >= 0:
                    tree.feature[r["node"]], tree.bin[r["node"]] = r["feature"], r["bin"]
            if not any(r["feature"] >= 0 for r in splits):
                break
        return fitted


class FittedTrees:
    def __init__(self, classes: list[int], edges: list[np.ndarray], trees: dict, trials: list[Trial], bags: int):
        self.classes, self.edges, self.trees, self.trials, self.bags = classes, edges, trees, trials, bags

    def codes(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(self.edges)]) if len(self.edges) else np.zeros((len(x), 0), np.int64)

    def proba(self, trial: int, fold: int, x: np.ndarray) -> np.ndarray:
        """The mean of the trees' class shares."""
        code, total = self.codes(x), np.zeros((len(x), len(self.classes)))
        for b in range(self.bags):
            tree = self.trees[trial, fold, b]
            w = tree.weights[tree.node(code, self.trials[trial].params.get("depth", 6))]
            s = w.sum(axis=1, keepdims=True)
            total += np.where(s > 0, w / np.where(s > 0, s, 1), 1 / len(self.classes))
        return total / self.bags

    def importances(self, features: int) -> list[tuple[int, int, int, int, float]]:
        """(trial, fold, bag, feature, share) of the fall of weighted entropy in each tree; a tree without splits has 0 throughout."""
        out = []
        for (t, f, b), tree in self.trees.items():
            own = np.zeros(features)
            for node in np.flatnonzero(tree.feature >= 0):
                own[tree.feature[node]] += entropy(tree.weights[node]) - entropy(tree.weights[2 * node + 1]) - entropy(tree.weights[2 * node + 2])
            total = own.sum()
            out += [(t, f, b, j, float(v / total) if total > 0 else 0.0) for j, v in enumerate(own)]
        return out
