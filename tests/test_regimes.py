"""Hidden Markov regimes against one sequence, one time step, one state at a time."""

import datetime
import math

import numpy as np
import pytest

from panelforge.operators import regimes


def density(x, m, v):
    return math.exp(-((x - m) ** 2) / (2 * v)) / math.sqrt(2 * math.pi * v)


def one_round(x, start, move, mean, var):
    """Scaled forward and backward passes in plain probabilities."""
    n = len(x)
    f, c = [], []
    for t in range(n):
        row = [(start[s] if t == 0 else sum(f[-1][q] * move[q][s] for q in (0, 1))) * density(x[t], mean[s], var[s]) for s in (0, 1)]
        c.append(sum(row))
        f.append([v / c[-1] for v in row])
    b = [[1.0, 1.0]]
    for t in range(n - 2, -1, -1):
        b.insert(0, [sum(move[s][q] * density(x[t + 1], mean[q], var[q]) * b[0][q] for q in (0, 1)) / c[t + 1] for s in (0, 1)])
    g = [[f[t][s] * b[t][s] for s in (0, 1)] for t in range(n)]
    moves = [[sum(f[t][s] * move[s][q] * density(x[t + 1], mean[q], var[q]) * b[t + 1][q] / c[t + 1] for t in range(n - 1)) for q in (0, 1)] for s in (0, 1)]
    return f, g, moves, sum(map(math.log, c))


def fitted(x, rounds):
    m = sum(x) / len(x)
    off = [(v - m) ** 2 for v in x]
    middle, whole = float(np.median(off)), sum(off) / len(x)
    floor = 1e-6 * whole + 1e-14
    calm, wild = [v for v in off if v <= middle], [v for v in off if v >= middle]
    start, move, mean, var = [0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [m, m], [max(sum(k) / len(k), floor) for k in (calm, wild)]
    for _ in range(rounds):
        _, g, moves, _ = one_round(x, start, move, mean, var)
        start = g[0]
        move = [[v / sum(row) for v in row] for row in moves]
        w = [sum(r[s] for r in g) for s in (0, 1)]
        mean = [sum(r[s] * v for r, v in zip(g, x)) / w[s] for s in (0, 1)]
        var = [max(sum(r[s] * v * v for r, v in zip(g, x)) / w[s] - mean[s] ** 2, floor) for s in (0, 1)]
    return start, move, mean, var


def last_probability(x, rounds):
    f, g, _, _ = one_round(x, *fitted(x, rounds))
    size = [sum(r[s] * abs(v) for r, v in zip(g, x)) / sum(r[s] for r in g) for s in (0, 1)]
    return f[-1][size.index(max(size))]


def series(seed, n):
    rng = np.random.default_rng(seed)
    wild, r = False, []
    for _ in range(n):
        wild = wild != (rng.random() < 0.06)
        r.append(float(rng.normal(0.002, 0.03) if wild else rng.normal(0, 0.006)))
    return r


def panel(spark, lengths, seed=0):
    day = datetime.date(2020, 1, 1)
    rows = [(s, day + datetime.timedelta(days=i), float(100 * math.exp(v))) for k, (s, n) in enumerate(lengths.items()) for i, v in enumerate(np.cumsum([0.0, *series(seed + k, n - 1)]))]
    rows += [("a", day + datetime.timedelta(days=5000), None), ("a", day + datetime.timedelta(days=5001), 0.0)]
    return spark.createDataFrame(rows, "symbol string, date date, close double").repartition(5)


def entries(x, dates, window, threshold, least, cooldown, rounds):
    out, level, after = [], None, -1
    if len(x) + 1 < window + least:
        return out
    for i in range(least, len(x)):
        if i <= after:
            continue
        p = last_probability(x[max(0, i - window + 1) : i + 1], rounds)
        if level is not None and level < threshold <= p:
            out.append(dates[i])
            after = i + cooldown
        level = p
    return out


def test_windows_equal_step_by_step_fits():
    x = np.array(series(1, 90))
    windows = np.zeros((4, 40))
    cut = [(0, 40), (30, 70), (10, 31), (50, 90)]
    for k, (a, b) in enumerate(cut):
        windows[k, : b - a] = x[a:b]
    got = regimes.trending(windows, np.array([b - a for a, b in cut]), 12)
    assert np.allclose(got, [last_probability(x[a:b].tolist(), 12) for a, b in cut], atol=1e-8)
    assert np.isfinite(regimes.trending(np.zeros((2, 20)), np.array([20, 12]), 5)).all()


def test_entries_equal_a_scan_and_look_at_no_later_bar(spark):
    p = panel(spark, {"a": 150, "b": 140, "short": 69})
    rows = sorted((r["symbol"], r["date"], r["r"]) for r in regimes.log_returns(p).collect())
    want = []
    for s in ("a", "b", "short"):
        own = [(d, r) for q, d, r in rows if q == s]
        want += [(s, d) for d in entries([r for _, r in own], [d for d, _ in own], 40, 0.6, 30, 7, 8)]
    got = sorted(map(tuple, regimes.trend_entries(p, 40, 0.6, 30, 7, 8).collect()))
    assert got == sorted(want) and len(got) >= 4 and {s for s, _ in got} == {"a", "b"}
    cut = sorted(r["date"] for r in p.where("symbol = 'a' and close > 0").collect())[110]
    early = sorted(map(tuple, regimes.trend_entries(p.where(p.date <= cut), 40, 0.6, 30, 7, 8).collect()))
    assert early == [r for r in got if r[1] <= cut]
    chunked = {(r["symbol"], r["date"]): r["p"] for r in regimes.trend_probabilities(regimes.log_returns(p), 40, 30, 8, 17).collect()}
    whole = {(r["symbol"], r["date"]): r["p"] for r in regimes.trend_probabilities(regimes.log_returns(p), 40, 30, 8, 10**6).collect()}
    assert chunked.keys() == whole.keys() and all(abs(chunked[k] - whole[k]) < 1e-9 for k in whole)
    assert regimes.trend_entries(p.where("false")).collect() == []
    with pytest.raises(ValueError):
        regimes.trend_entries(p, window=5)


def test_pooled_fit_adds_up_symbols(spark):
    p = panel(spark, {"a": 300, "b": 200, "c": 2}, seed=5)
    r = regimes.log_returns(p)
    model, history = regimes.fit_pooled(r, 6, 0.0)
    assert len(history) == 6 and all(b >= a - 1e-9 for a, b in zip(history, history[1:]))
    rows = sorted((x["symbol"], x["date"], x["r"]) for x in r.collect())
    seqs = [[v for s, _, v in rows if s == k] for k in ("a", "b", "c")]
    every = [v for q in seqs for v in q]
    m, sizes = sum(every) / len(every), sorted(map(abs, every))
    middle = float(r.selectExpr("percentile_approx(abs(r), 0.5, 100000)").first()[0])
    assert middle in sizes
    halves = [[(v - m) ** 2 for v in every if (abs(v) <= middle if k == 0 else abs(v) >= middle)] for k in (0, 1)]
    start, move, mean, var = [0.5, 0.5], [[0.9, 0.1], [0.1, 0.9]], [m, m], [sum(h) / len(h) for h in halves]
    logs = []
    for _ in range(6):
        got = [one_round(q, start, move, mean, var) for q in seqs]
        logs.append(sum(g[3] for g in got))
        gam = [(row, v) for g, q in zip(got, seqs) for row, v in zip(g[1], q)]
        start = [sum(g[1][0][s] for g in got) / 3 for s in (0, 1)]
        moves = [[sum(g[2][s][q] for g in got) for q in (0, 1)] for s in (0, 1)]
        move = [[v / sum(row) for v in row] for row in moves]
        w = [sum(row[s] for row, _ in gam) for s in (0, 1)]
        mean = [sum(row[s] * v for row, v in gam) / w[s] for s in (0, 1)]
        var = [sum(row[s] * v * v for row, v in gam) / w[s] - mean[s] ** 2 for s in (0, 1)]
    assert np.allclose(history, logs, rtol=1e-8)
    order = np.argsort(var)
    assert np.allclose(model.mean[0], np.array(mean)[order], atol=1e-9) and np.allclose(model.var[0], np.array(var)[order], rtol=1e-6)
    assert np.allclose(np.exp(model.move[0]), np.array(move)[order][:, order], atol=1e-7)
    told = {(x["symbol"], x["date"]): x["p"] for x in regimes.filtered(r, model).collect()}
    f, _, _, _ = one_round(seqs[0], np.exp(model.start[0]), np.exp(model.move[0]), model.mean[0], model.var[0])
    assert np.allclose([told["a", d] for s, d, _ in rows if s == "a"], [v[1] for v in f], atol=1e-8)
    with pytest.raises(ValueError):
        regimes.fit_pooled(r.where("false"))
