"""Small literal inputs and the outcomes they pin."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelforge.functions import stats
from panelforge.operators import folds, joins, labels, paths, windows

D0 = dt.date(2024, 1, 1)


def day(i):
    return D0 + dt.timedelta(days=i)


def bars(spark, closes, symbol="A"):
    return spark.createDataFrame([(symbol, day(i), c, c, c, c) for i, c in enumerate(closes)], "symbol string, date date, open double, high double, low double, close double")


def event(spark, *rows):
    return spark.createDataFrame(rows, "event_id string, symbol string, event_start date, t1 date, target double, side double")


def test_barriers(spark):
    b = bars(spark, [100.0, 101.0, 106.0, 97.0, 99.0])
    e = event(spark, ("up", "A", day(0), day(4), 0.05, None), ("down", "A", day(2), day(4), 0.05, None), ("flat", "A", day(0), day(1), 0.05, None), ("none", "A", day(9), day(12), 0.05, None), ("bad", "A", day(0), day(4), 0.0, None), ("meta", "A", day(2), day(4), 0.05, -1.0))
    got = {r["event_id"]: (r["touch_type"], r["bin"]) for r in labels.triple_barrier(e, b, 1, 1).collect()}
    assert got == {"up": ("upper", 1), "down": ("lower", -1), "flat": ("vertical", 0), "none": ("no_data", 0), "bad": ("invalid", 0), "meta": ("upper", 1)}


def test_concurrency_counts_closed_spans(spark):
    b = bars(spark, [1.0] * 20)
    spans = event(spark, ("a", "A", day(0), day(5), 1.0, None), ("b", "A", day(3), day(10), 1.0, None), ("c", "A", day(8), day(15), 1.0, None))
    got = [r["c"] for r in labels.concurrency(spans, b).orderBy("date").collect()]
    assert got == [1, 1, 1, 2, 2, 2, 1, 1, 2, 2, 2, 1, 1, 1, 1, 1, 0, 0, 0, 0]


def test_uniqueness_between_zero_and_one(spark):
    b = bars(spark, [float(i + 1) for i in range(20)])
    spans = event(spark, ("a", "A", day(0), day(5), 1.0, None), ("b", "A", day(3), day(10), 1.0, None))
    assert all(0 < r["uniqueness"] <= 1 for r in labels.uniqueness(spans, b).collect())


def test_swing_is_known_late(spark):
    p = bars(spark, [120.0 if i == 10 else 100.0 for i in range(20)])
    got = [r["s"] for r in p.select("date", windows.swing(F.col("high"), 3, True).alias("s")).orderBy("date").collect()]
    assert got[13] == 120.0 and got[12] != 120.0 and got[10] != 120.0


def test_supertrend_turns_down(spark):
    up = [10 + 6 * i / 24 for i in range(25)]
    down = [15.5 - 7.5 * i / 14 for i in range(15)]
    p = bars(spark, up + down).withColumn("high", F.col("close") + 0.15).withColumn("low", F.col("close") - 0.15)
    got = [r["direction"] for r in paths.supertrend(p).orderBy("date").collect()]
    assert got[-5:] == [-1] * 5


def test_cusum_resets_the_side_that_fires(spark):
    p = bars(spark, [100.0, 106.0, 112.0, 100.0])
    got = [r["date"] for r in paths.cusum_events(p, 0.05).orderBy("date").collect()]
    assert got == [day(1), day(2), day(3)]


def test_as_of_falls_through_nulls(spark):
    left = spark.createDataFrame([("A", day(5)), ("B", day(5))], "k string, t date")
    right = spark.createDataFrame([("A", day(1), 1.0), ("A", day(3), None), ("A", day(6), 9.0)], "k string, u date, v double")
    by = {r["k"]: r["v"] for r in joins.as_of(left, right, "k", "t", "u", ["v"]).collect()}
    assert by == {"A": 1.0, "B": None}
    assert {r["k"]: r["v"] for r in joins.as_of(left, right, "k", "t", "u", ["v"], skip_null=False).collect()}["A"] is None


def test_sessions_after(spark):
    cal = spark.createDataFrame([(day(i),) for i in (0, 1, 4)], "date date")
    e = spark.createDataFrame([(day(0),), (day(2),)], "date date")
    got = {r["date"]: r["n"] for r in joins.sessions_after(e, cal, "date", 1, "n").collect()}
    assert got == {day(0): day(1), day(2): day(4)}


def test_purge_leaves_no_overlap(spark):
    e = event(spark, *((str(i), "A", day(i), day(i + 2), 1.0, None) for i in range(8)))
    rows = folds.purged_folds(e, 4).collect()
    spans = {str(i): (i, i + 2) for i in range(8)}
    for fold in range(4):
        test = [spans[r["event_id"]] for r in rows if r["fold"] == fold and r["part"] == "test"]
        for r in rows:
            if r["fold"] == fold and r["part"] == "train":
                a, z = spans[r["event_id"]]
                assert all(z < x or a > y for x, y in test)


def test_fractional_weights_end_below_threshold():
    w = windows.fractional_weights(0.4)
    assert len(w) == 1458 and abs(w[1] + 0.4) < 1e-12


def test_parity_weights():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(200, 5))
    w = stats.hierarchical_parity(np.cov(x.T), np.corrcoef(x.T))
    assert abs(w.sum() - 1) < 1e-12 and (w >= 0).all()


def test_overfit_probability_is_a_share():
    rng = np.random.default_rng(0)
    assert 0 <= stats.overfit_probability(rng.normal(size=(8, 20)), np.full(8, 25.0)) <= 1


def test_sharpe_functions():
    assert stats.expected_max_sharpe(1) == 0
    assert stats.probabilistic_sharpe(100, 0.1, 0.0, 3.0) > 0.5
    assert math.isnan(stats.probabilistic_sharpe(3, 0.1, 0.0, 3.0))
    assert stats.bet_size(0.5, 1) == pytest.approx(0)


def test_discretise(spark):
    got = [r[0] for r in spark.createDataFrame([(0.11,), (0.49,), (-0.93,), (3.0,)], "x double").select(stats.discretise(F.col("x"), 0.1)).collect()]
    assert got == pytest.approx([0.1, 0.5, -0.9, 1.0])


def test_empty_panel(spark):
    e = bars(spark, [1.0]).where("false")
    assert paths.supertrend(e).count() == 0
    assert e.select(windows.mean(F.col("close"), 3)).count() == 0
