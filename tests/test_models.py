"""Classifiers, scores and importances against single-process versions."""

import math

import numpy as np
import pytest

from panelforge.models import classifiers, design, orthogonal, scores, trees
from panelforge.operators import bootstrap

NAMES = ["a", "b", "c"]


def sample(n=240, classes=2, seed=0, far=0.0):
    rng = np.random.default_rng(seed)
    x = rng.normal(0, 1, (n, 3)) + far
    z = x - far
    y = (z[:, 0] + 0.5 * z[:, 1] + rng.normal(0, 1, n) > 0).astype(int) + (classes == 3) * (z[:, 2] > 0.8)
    w = rng.uniform(0.2, 3, n)
    fold = np.arange(n) * 4 // n
    return x, y, w, fold


def built(spark, data, keep=(), extra=""):
    x, y, w, fold = data
    rows = [(f"e{i:04d}", *map(float, x[i]), int(y[i]), float(w[i]), *(k[i] for k in keep)) for i in range(len(y))]
    samples = spark.createDataFrame(rows, "event_id string, a double, b double, c double, y int, weight double" + extra).repartition(5)
    part = [(int(f), f"e{i:04d}", "test" if fold[i] == f else "train") for i in range(len(y)) for f in range(4) if abs(fold[i] - f) != 2 or i % 3]
    splits = spark.createDataFrame(part, "fold int, event_id string, part string")
    trains = {f: np.array([i for i in range(len(y)) if fold[i] != f and (abs(fold[i] - f) != 2 or i % 3)]) for f in range(4)}
    return design.design(samples, NAMES, splits, weight="weight", keep=["copies"] if keep else []), trains


def measured(p, y, w):
    p = np.clip(p, np.finfo(float).eps, 1 - np.finfo(float).eps)
    guess = p.argmax(axis=1)
    tp, fp, fn = (w[m].sum() for m in ((y == 1) & (guess == 1), (y != 1) & (guess == 1), (y == 1) & (guess != 1)))
    return (w * np.log(p[np.arange(len(y)), y])).sum() / w.sum(), w[guess == y].sum() / w.sum(), 2 * tp / (2 * tp + fp + fn)


def gaussian(x, y, w, t, k, smooth=1e-9):
    whole = (w[:, None] * (x - (w[:, None] * x).sum(0) / w.sum()) ** 2).sum(0) / w.sum()
    score = []
    for c in range(k):
        m = y == c
        mean = (w[m, None] * x[m]).sum(0) / w[m].sum()
        var = (w[m, None] * (x[m] - mean) ** 2).sum(0) / w[m].sum() + smooth * whole
        score.append(np.log(w[m].sum() / w.sum()) - 0.5 * (np.log(2 * np.pi * var) + (t - mean) ** 2 / var).sum(1))
    p = np.exp(np.array(score).T - np.max(score, axis=0)[:, None])
    return p / p.sum(1, keepdims=True)


def softmax_by_descent(x, y, w, t, k, c=1.0):
    """The optimum by many small steps along the gradient, with no second derivatives."""
    one = lambda v: np.column_stack((np.ones(len(v)), v))
    beta, hit = np.zeros((k, x.shape[1] + 1)), np.eye(k)[y]
    prob = lambda v: (lambda e: e / e.sum(1, keepdims=True))(np.exp(one(v) @ (beta - beta[0]).T))
    for _ in range(20000):
        g = ((prob(x) - hit) * w[:, None]).T @ one(x)
        g[:, 1:] += (beta - beta[0])[:, 1:] / c
        g[0] = 0
        if np.abs(g).max() < 1e-9:
            break
        beta = beta - g / w.sum()
    return prob(t)


@pytest.mark.parametrize("classes,far", [(2, 0.0), (3, 0.0), (2, 1e5)])
def test_bayes_scores_equal_numpy(spark, classes, far):
    data = sample(classes=classes, far=far)
    d, trains = built(spark, data)
    got = {r["fold"]: tuple(r)[2:] for r in scores.cv_score(d, classifiers.Bayes()).collect()}
    x, y, w, fold = data
    for f, tr in trains.items():
        te = fold == f
        want = measured(gaussian(x[tr], y[tr], w[tr], x[te], classes), y[te], w[te])
        assert np.allclose(got[f], want, atol=1e-7)


@pytest.mark.parametrize("classes", [2, 3])
def test_logistic_scores_equal_numpy(spark, classes):
    data = sample(classes=classes, seed=1)
    d, trains = built(spark, data)
    trials = [d.trial(), design.Trial((0, 2), {"c": 0.1})]
    got = {(r["trial"], r["fold"]): tuple(r)[2:] for r in scores.cv_score(d, classifiers.Logistic(), trials).collect()}
    x, y, w, fold = data
    for f, tr in trains.items():
        te = fold == f
        for t, (cols, c) in enumerate((([0, 1, 2], 1.0), ([0, 2], 0.1))):
            want = measured(softmax_by_descent(x[tr][:, cols], y[tr], w[tr], x[te][:, cols], classes, c), y[te], w[te])
            assert np.allclose(got[t, f], want, atol=1e-6)
    with pytest.raises(ValueError):
        classifiers.Logistic(rounds=1).fit(d, trials)


def grow(x, y, w, depth, columns, seed, bag, share, least, k, node=0):
    """A tree by recursion over raw rows: {node: (feature, bin, class weights)}."""
    own = np.array([w[y == c].sum() for c in range(k)])
    out = {node: (-1, 0, own)}
    if not depth:
        return out
    best = (1e-9 * max(trees.entropy(own), 1e-300), None)
    for j in sorted(trees.drawn(seed, bag, node, columns, share).tolist()):
        for cut in range(1, int(x[:, j].max(initial=0)) + 2):
            go = x[:, j] >= cut
            sides = [np.array([w[(y == c) & m].sum() for c in range(k)]) for m in (~go, go)]
            if min(s.sum() for s in sides) < least:
                continue
            gain = trees.entropy(own) - trees.entropy(sides[0]) - trees.entropy(sides[1])
            if gain > best[0] + 1e-9 * trees.entropy(own) * (best[1] is not None and best[1][0] != j) + 1e-12:
                best = (gain, (j, cut))
    if best[1] is None:
        return out
    j, cut = best[1]
    out[node] = (j, cut, own)
    go = x[:, j] >= cut
    for side, m in ((2 * node + 1, ~go), (2 * node + 2, go)):
        out |= grow(x[m], y[m], w[m], depth - 1, columns, seed, bag, share, least, k, side)
    return out


def test_trees_equal_recursion_over_rows(spark):
    data = sample(classes=3, seed=2)
    x, y, w, fold = data
    rng = np.random.default_rng(5)
    copies = rng.poisson(0.7, (len(y), 4)).astype(int)
    d, trains = built(spark, data, ([list(map(int, c)) for c in copies],), ", copies array<int>")
    edges = [np.quantile(x[:, j], np.linspace(0, 1, 9)[1:-1]) for j in range(3)]
    params = {"depth": 3, "features": 0.67, "least": 2.0}
    fitted = trees.BaggedTrees(4, seed=7, edges=edges).fit(d, [d.trial(**params), d.trial(depth=0)])
    code = np.column_stack([np.searchsorted(e, x[:, j], "right") for j, e in enumerate(edges)])
    for f, tr in trains.items():
        mass = np.array([w[tr][y[tr] == c].sum() for c in range(3)])
        for b in range(4):
            own = tr[copies[tr, b] > 0]
            weight = w[own] * copies[own, b] * (mass.sum() / (3 * mass))[y[own]]
            want = grow(code[own], y[own], weight, 3, (0, 1, 2), 7, b, 0.67, 2.0, 3)
            tree = fitted.trees[0, f, b]
            reached = set(np.flatnonzero(tree.weights.sum(axis=1) > 0))
            assert reached == set(want)
            for node, (j, cut, own_weights) in want.items():
                assert np.allclose(tree.weights[node], own_weights)
                if node < len(tree.feature):
                    assert (tree.feature[node], tree.bin[node]) == (j, cut)
        te = fold == f
        p = fitted.proba(0, f, x[te])
        assert np.allclose(p.sum(axis=1), 1) and np.allclose(fitted.proba(1, f, x[te])[0], np.mean([t.weights[0] / t.weights[0].sum() for (q, g, _), t in fitted.trees.items() if (q, g) == (1, f)], axis=0))
    shares = [v for _, _, _, _, v in fitted.importances(3)]
    assert all(0 <= v <= 1 for v in shares) and {round(sum(shares[i : i + 3]), 9) for i in range(0, len(shares), 3)} <= {0.0, 1.0}
    got = {r["feature"]: (r["mean"], r["std"]) for r in scores.feat_imp_mdi(d, fitted, 0, 2).collect()}
    table = np.array([[v for t, f, b, _, v in fitted.importances(3) if (t, f, b) == (0, 2, bag)] for bag in range(4)])
    table[table == 0] = np.nan
    mean = np.nanmean(table, axis=0)
    for j, n in enumerate(NAMES):
        std = np.nanstd(table[:, j], ddof=1) / 2 / mean.sum()
        assert abs(got[n][0] - mean[j] / mean.sum()) < 1e-9 and abs(got[n][1] - std) < 1e-9


def test_permutation_importance_equals_numpy(spark):
    data = sample(seed=3)
    x, y, w, fold = data
    d, trains = built(spark, data)
    other = {int(r["event_id"][1:]): np.array(r["other"]) for r in design.with_partner(d.rows, 4).collect()}
    for f in range(4):
        own = np.flatnonzero(fold == f)
        assert sorted(other[i][0] for i in own) == sorted(x[own, 0]) and any(other[i][0] != x[i, 0] for i in own)
    for scoring, at in (("neg_log_loss", 0), ("accuracy", 1)):
        got, base = scores.feat_imp_mda(d, classifiers.Bayes(), scoring, 4)
        got = {r["feature"]: (r["mean"], r["std"]) for r in got.collect()}
        shares, bases = {n: [] for n in NAMES}, []
        for f, tr in trains.items():
            te = np.flatnonzero(fold == f)
            fit = lambda t: measured(gaussian(x[tr], y[tr], w[tr], t, 2), y[te], w[te])[at]  # noqa: B023, E731
            bases.append(fit(x[te]))
            for j, n in enumerate(NAMES):
                moved = x[te].copy()
                moved[:, j] = [other[i][j] for i in te]
                s = fit(moved)
                shares[n].append((bases[-1] - s) / (-s if at == 0 else 1 - s))
        assert abs(base.first()[0] - np.mean(bases)) < 1e-9
        for n in NAMES:
            assert np.allclose(got[n], (np.mean(shares[n]), np.std(shares[n], ddof=1) / 2), atol=1e-8)
    assert got["a"][0] > got["c"][0]
    with pytest.raises(ValueError):
        scores.feat_imp_mda(d, classifiers.Bayes(), "f1")


def test_single_feature_importance_and_search(spark):
    data = sample(seed=4)
    x, y, w, fold = data
    d, trains = built(spark, data)
    got = {r["feature"]: (r["mean"], r["std"]) for r in scores.feat_imp_sfi(d, classifiers.Bayes()).collect()}
    for j, n in enumerate(NAMES):
        s = [measured(gaussian(x[tr][:, [j]], y[tr], w[tr], x[fold == f][:, [j]], 2), y[fold == f], w[fold == f])[0] for f, tr in trains.items()]
        assert np.allclose(got[n], (np.mean(s), np.std(s) / 2))
    table, best = scores.clf_hyper_fit(d, classifiers.Logistic(), {"c": [1e-4, 1.0]})
    rows = {r["trial"]: r["score"] for r in table.collect()}
    assert best.params["c"] == [1e-4, 1.0][max(rows, key=rows.get)] and len(rows) == 2
    drawn = scores.trials_of(d, {"c": scores.LogUniform(0.01, 100), "smooth": [1, 2, 3]}, 200, 1)
    assert drawn == scores.trials_of(d, {"c": scores.LogUniform(0.01, 100), "smooth": [1, 2, 3]}, 200, 1)
    logs = np.array([math.log10(t.params["c"]) for t in drawn])
    assert -2 <= logs.min() < -1.7 and 1.7 < logs.max() <= 2 and abs(logs.mean()) < 0.25 and {t.params["smooth"] for t in drawn} == {1, 2, 3}
    dist = scores.LogUniform(0.01, 100)
    assert abs(dist.cdf(dist.quantile(0.3)) - 0.3) < 1e-12 and dist.cdf(0.001) == 0 and dist.pdf(1000) == 0
    assert abs(sum(dist.pdf(v) * v * 0.001 for v in np.exp(np.arange(math.log(0.01), math.log(100), 0.001))) - 1) < 1e-2


def test_walking_predictions_come_in_order(spark):
    data = sample(seed=6)
    x, y, w, fold = data
    rows = spark.createDataFrame([(f"e{i:04d}", *map(float, x[i]), int(y[i]), float(w[i])) for i in range(len(y))], "event_id string, a double, b double, c double, y int, weight double")
    splits = [(s, f"e{i:04d}", "train" if fold[i] < s else "test") for s in (1, 2, 3) for i in range(len(y)) if fold[i] <= s]
    d = design.design(rows, NAMES, spark.createDataFrame(splits, "split int, event_id string, part string"), weight="weight")
    told, table = scores.walk_forward_backtest(d, classifiers.Bayes())
    got = {(r["fold"], int(r["event_id"][1:])): (r["guess"], r["p"][1]) for r in told.collect()}
    assert len(got) == (fold > 0).sum()
    for s in (1, 2, 3):
        tr, te = fold < s, fold == s
        p = gaussian(x[tr], y[tr], w[tr], x[te], 2)
        for i, row in zip(np.flatnonzero(te), p):
            assert got[s, i][0] == row.argmax() and abs(got[s, i][1] - row[1]) < 1e-9
        r = table.where(table.fold == s).first()
        assert np.allclose((r["neg_log_loss"], r["accuracy"], r["f1"]), measured(p, y[te], w[te])) and (r["n_train"], r["n_test"]) == (tr.sum(), te.sum())


def test_odd_designs(spark):
    rows = [("e1", 1.0, None, 1.0, 0, 1.0), ("e2", 1.0, float("nan"), 1.0, 1, 1.0), ("e3", 1.0, 2.0, 3.0, None, 1.0), ("e4", 1.0, 2.0, 3.0, 1, None), ("e5", 1.0, 2.0, 3.0, 1, 1.0), ("e6", 1.0, 2.0, 3.0, 1, 2.0)]
    s = spark.createDataFrame(rows, "event_id string, a double, b double, c double, y int, weight double")
    splits = spark.createDataFrame([(0, "e5", "test"), (0, "e6", "train"), (1, "e6", "test")], "fold int, event_id string, part string")
    d = design.design(s, NAMES, splits, weight="weight")
    assert d.rows.count() == 2 and d.classes == [1] and d.folds == [0, 1]
    for c in (classifiers.Bayes(), classifiers.Logistic()):
        got = {r["fold"]: r["accuracy"] for r in scores.cv_score(d, c).collect()}
        assert got == {0: 1.0, 1: 1.0}  # one class; fold 1 has no training rows
    empty = design.design(s.where("false"), NAMES, splits, weight="weight")
    assert scores.cv_score(empty, classifiers.Bayes()).collect() == []


def test_bags_hold_events_by_uniqueness(spark):
    rng = np.random.default_rng(8)
    rows = [(f"{s}{i}", s, int(a), int(a + rng.integers(1, 9))) for s in ("x", "y") for i, a in enumerate(np.sort(rng.integers(0, 90, 60)))]
    rows += [("lone", "z", 500, 503)]
    placed = spark.createDataFrame(rows, "event_id string, symbol string, first int, last int")
    got = {r["event_id"]: np.array(r["copies"]) for r in bootstrap.bags(placed, 40, seed=1, block=32).collect()}
    again = {r["event_id"]: np.array(r["copies"]) for r in bootstrap.bags(placed.repartition(7), 40, seed=1, block=32).collect()}
    assert set(got) == {r[0] for r in rows} and all((got[k] == again[k]).all() for k in got) and (got["lone"] == 1).all()
    for s in ("x", "y"):
        for block in range(3):
            own = [r for r in rows if r[1] == s and r[2] // 32 == block]
            bars = {b: sum(r[2] <= b <= r[3] for r in own) for r in own for b in range(r[2], r[3] + 1)}
            unique = np.mean([np.mean([1 / bars[b] for b in range(r[2], r[3] + 1)]) for r in own])
            drawn = np.sum([got[r[0]] for r in own], axis=0)
            assert (drawn == max(1, round(unique * len(own)))).all()
    assert (np.sum([got[r[0]] for r in rows if r[1] == "x" and r[2] < 32]) == 0) == (not [r for r in rows if r[1] == "x" and r[2] < 32])
    full = bootstrap.bags(placed, 3, share=1.0, seed=1, block=10**6).collect()
    assert sum(sum(r["copies"]) for r in full) == 3 * len(rows)


def test_poisson_bags(spark):
    rows = spark.range(4000).selectExpr("cast(id as string) as event_id").select("event_id", design.poisson_bags(0.6, 5, 3).alias("copies")).collect()
    n = np.array([r["copies"] for r in rows])
    assert n.shape == (4000, 5) and np.abs(n.mean(axis=0) - 0.6).max() < 0.06 and np.abs(n.var(axis=0) - 0.6).max() < 0.08
    assert np.abs(np.corrcoef(n.T) - np.eye(5)).max() < 0.06


def test_orthogonal_features_equal_numpy(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(0, 1, (300, 5)) @ rng.normal(0, 1, (5, 5)) + 50
    x[:, 3] = 7.0
    holes = rng.random(x.shape) < 0.05
    holes[:, 3] = False
    rows = [(i, *(None if holes[i, j] else float(x[i, j]) for j in range(5))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, " + ", ".join(f"f{j} double" for j in range(5)))
    v = np.where(holes, np.nan, x)[:, [0, 1, 2, 4]]
    z = np.nan_to_num((v - np.nanmean(v, axis=0)) / np.nanstd(v, axis=0))
    value, vector = np.linalg.eigh(z.T @ z)
    value, vector = value[::-1], vector[:, ::-1]
    for share in (0.5, 0.95, 1.0):
        n = min(4, int(np.searchsorted(np.cumsum(value) / value.sum(), share)) + 1)
        p, loads, values = orthogonal.orthogonalize_features(df, [f"f{j}" for j in range(5)], ["id"], share)
        assert p.columns == ["id", *(f"PC_{k + 1}" for k in range(n))]
        got = np.array([list(r)[1:] for r in sorted(p.collect())])
        assert np.allclose(np.abs(got), np.abs(z @ vector[:, :n]), atol=1e-8)
        assert np.allclose([r["value"] for r in sorted(values.collect())], value[:n]) and loads.count() == 4 * n
        assert {r["feature"] for r in loads.collect()} == {"f0", "f1", "f2", "f4"}
    flat = orthogonal.orthogonalize_features(df, ["f3"], ["id"])
    assert flat[0].columns == ["id"] and flat[1].count() == flat[2].count() == 0
