"""Registered queries run with the reference's parameters."""

import math

import numpy as np
import pytest

from panelforge import catalog
from panelforge.functions import stats
from panelforge.plans import panels

DIR = "/root/testdata/sf0.01"


def test_fractional_difference_spans_1458_days(spark):
    rows = panels.segment_prices(spark, DIR).select("symbol", "date", "close").orderBy("symbol", "date").collect()
    got = {(r["symbol"], r["date"]): r["ffd"] for r in catalog.fractional_difference(spark, DIR).collect()}
    weights = [1.0]
    while abs(x := -weights[-1] * (0.4 - len(weights) + 1) / len(weights)) >= 1e-5:
        weights.append(x)
    assert len(weights) == 1458
    for s in {r["symbol"] for r in rows}:
        own = [r for r in rows if r["symbol"] == s]
        logs = np.log([r["close"] for r in own])
        for i, r in enumerate(own):
            value = got[s, r["date"].isoformat()]
            assert value is None if i < 1457 else value == pytest.approx(float(logs[i - 1457 : i + 1][::-1] @ weights), abs=1e-5)
    assert any(v is not None for v in got.values())


@pytest.mark.parametrize("n", [60, 90])
def test_smooth_momentum_windows(spark, n):
    rows = panels.nation_flow(spark, DIR).select("symbol", "date", "close").orderBy("symbol", "date").collect()
    got = {(r["symbol"], r["date"]): r["score"] for r in catalog.QUERIES[f"smooth_momentum_{n}"](spark, DIR).collect()}
    s = rows[0]["symbol"]
    own = [r for r in rows if r["symbol"] == s]
    y = np.log([r["close"] for r in own])
    for i, r in enumerate(own):
        value = got[s, r["date"].isoformat()]
        if i < n - 1:
            assert value is None
        else:
            part, x = y[i - n + 1 : i + 1], np.arange(n)
            slope, r2 = np.polyfit(x, part, 1)[0], np.corrcoef(x, part)[0, 1] ** 2
            assert value == pytest.approx((math.exp(252 * slope) - 1) * r2, rel=1e-6, abs=2e-6)


def test_overfit_share_has_sixteen_chunks(spark, monkeypatch):
    seen = []
    table = stats.overfit_table
    monkeypatch.setattr(stats, "overfit_table", lambda r, chunks: seen.append(chunks) or table(r, chunks))
    assert catalog.QUERIES["overfit_share"](spark, DIR).count() == 1 and seen == [16]
