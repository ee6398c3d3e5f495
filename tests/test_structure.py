"""Legs of the market structure, bar by bar."""

import datetime as dt
import math

import numpy as np
import pytest

from panelforge.operators import paths


def by_hand(h, l, c, side):
    """Swings are known ``side`` bars later; the leg is kept and grown in place."""
    n, out = len(c), []
    top = bottom = last_h = last_l = old_h = old_l = None
    way = 0
    for i in range(n):
        j = i - side
        if i >= 2 * side:
            if h[j] == max(h[i - 2 * side : i + 1]):
                old_h, last_h = last_h, h[j]
                top, bottom = last_h, bottom if last_l is None else last_l
            if l[j] == min(l[i - 2 * side : i + 1]):
                old_l, last_l = last_l, l[j]
                bottom, top = last_l, top if last_h is None else last_h
        if None not in (last_h, old_h, last_l, old_l):
            if last_h > old_h and last_l > old_l:
                way = 1
            elif last_h < old_h and last_l < old_l:
                way = -1
        if way == 1 and None not in (last_h, last_l):
            if c[i] > last_h and not c[i - 1] > last_h:
                top = max(top, c[i])
            elif c[i] < last_l and not c[i - 1] < last_l:
                way = 0
        elif way == -1 and None not in (last_h, last_l):
            if c[i] < last_l and not c[i - 1] < last_l:
                bottom = min(bottom, c[i])
            elif c[i] > last_h and not c[i - 1] > last_h:
                way = 0
        imp = back = ext = None
        if way == 1:
            imp, back = top / bottom - 1, max(0.0, 1 - last_l / top)
        elif way == -1:
            imp, back = 1 - bottom / top, max(0.0, last_h / bottom - 1)
        if imp is not None:
            ext = min(10.0, max(0.0, imp / (back if back > 1e-6 else 0.05)))
        out.append((way, imp, back, ext))
    return out


@pytest.mark.parametrize("seed,side", [(0, 1), (1, 2), (2, 3), (3, 2)])
def test_ratios_equal_a_leg_kept_in_place(spark, seed, side):
    rng = np.random.default_rng(seed)
    c = 60 * np.exp(rng.normal(0, 0.03, 220).cumsum())
    h, l = c * (1 + rng.uniform(0, 0.02, 220)), c * (1 - rng.uniform(0, 0.02, 220))
    day = dt.date(2022, 1, 1)
    p = spark.createDataFrame([("x", day + dt.timedelta(days=i), float(h[i]), float(l[i]), float(c[i])) for i in range(220)], "symbol string, date date, high double, low double, close double").repartition(3)
    got = [(r["direction"], r["impulse"], r["pullback"], r["extension"]) for r in paths.structure_ratios(p, side).orderBy("date").collect()]
    want = by_hand(h.tolist(), l.tolist(), c.tolist(), side)
    assert [g[0] for g in got] == [w[0] for w in want] and {1, -1} <= {w[0] for w in want}
    for g, w in zip(got, want):
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in zip(g[1:], w[1:]))
