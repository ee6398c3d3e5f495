"""Stores, gates, schema checks and splits on small literal inputs."""

import datetime as dt
import math
from statistics import NormalDist

import numpy as np
import pytest

from panelforge.functions import stats
from panelforge.operators import bootstrap, folds, gates, paths, validation
from panelforge.sources import synthetic
from panelforge.sources.registry import TrialRegistry
from panelforge.sources.shards import ShardStore

D0 = dt.date(2024, 1, 30)


def prices(spark, *rows):
    return spark.createDataFrame([(s, D0 + dt.timedelta(days=i), c) for s, i, c in rows], "symbol string, date date, close double")


def test_shards_merge_and_keep_the_last_row(spark, tmp_path):
    store = ShardStore(spark, str(tmp_path), "bars", buckets=2)
    assert store.get(None, "2024-01-01", "2024-12-31") is None
    store.put(prices(spark, ("A", 0, 1.0), ("A", 5, 2.0), ("B", 0, 3.0)))
    store.put(prices(spark, ("A", 0, 9.0), ("A", 1, 4.0)))
    got = {(r["symbol"], r["date"].day): r["close"] for r in store.get(None, "2024-01-01", "2024-12-31").collect()}
    assert got == {("A", 30): 9.0, ("A", 31): 4.0, ("A", 4): 2.0, ("B", 30): 3.0}
    assert store.get(["A"], "2024-01-31", "2024-02-04").count() == 2
    both = prices(spark, ("A", 0, 0.0), ("B", 0, 0.0))
    assert sorted(tuple(r) for r in store.missing(both, "2024-01-01", "2024-02-29").collect()) == [("B", "2024-02")]
    store.invalidate(["A"])
    assert [r["symbol"] for r in store.get(None, "2024-01-01", "2024-12-31").collect()] == ["B"]


def test_registry(spark, tmp_path):
    r = TrialRegistry(spark, str(tmp_path))
    assert r.count("d") == 0
    r.record("d", {"a": 1}, {"sharpe_ratio": 1.5})
    r.record("d", {}, {"other": 1})
    r.record("e", {}, {"sharpe_ratio": 2.0})
    assert r.count("d") == 2 and [x["sharpe_ratio"] for x in r.sharpe_ratios("d").collect()] == [1.5]


def test_gates_union_of_rows(spark):
    a = spark.createDataFrame([("A", D0, True), ("B", D0, None)], "symbol string, date date, ok boolean")
    b = spark.createDataFrame([("A", D0, True), ("C", D0, True)], "symbol string, date date, ok boolean")
    assert {r["symbol"]: r["ok"] for r in gates.combine([a, b]).collect()} == {"A": True, "B": False, "C": False}
    assert {r["symbol"]: r["ok"] for r in gates.combine([a, b], "or").collect()} == {"A": True, "B": False, "C": True}
    with pytest.raises(ValueError):
        gates.tradable(a)


def test_validation(spark):
    good = synthetic.daily_bars(spark, 3, "2024-01-01", "2024-01-31", seed=1)
    assert validation.validate(good, validation.DAILY).count() == 3 * 23
    with pytest.raises(validation.SchemaViolation, match="key_repeats"):
        validation.validate(good.union(good.limit(1)), validation.DAILY)
    with pytest.raises(validation.SchemaViolation, match="no column open"):
        validation.validate(good.drop("open"), validation.DAILY)
    assert synthetic.daily_bars(spark, 3, "2024-01-01", "2024-01-31", seed=1).exceptAll(good).count() == 0


def test_combinatorial_paths_hold_every_event_once(spark):
    rows = [(f"e{i:02d}", D0 + dt.timedelta(days=i), D0 + dt.timedelta(days=i + 2)) for i in range(24)]
    e = spark.createDataFrame(rows, "event_id string, event_start date, t1 date")
    got = folds.combinatorial_folds(e, 6, 2).collect()
    assert folds.path_count(6, 2) == 5
    for path in range(5):
        assert sorted(r["event_id"] for r in got if r["path"] == path) == [r[0] for r in rows]
    for split in range(15):
        test = [r["event_id"] for r in got if r["split"] == split and r["part"] == "test"]
        train = [r["event_id"] for r in got if r["split"] == split and r["part"] == "train"]
        span = {r[0]: r[1:] for r in rows}
        assert all(span[a][0] > span[b][1] or span[a][1] < span[b][0] for a in train for b in test)


def test_bootstrap_prefers_unique_events():
    first, last = np.array([0, 0, 0, 20]), np.array([9, 9, 9, 29])
    got = np.bincount([bootstrap.draw(first, last, 2, np.random.default_rng(k))[1] for k in range(400)], minlength=4)
    assert got[3] > got[0]


def test_structure_turns_and_breaks(spark):
    closes = [1, 2, 3, 2, 1.5, 2.5, 4, 3, 2, 3, 5, 6, 1.0, 0.5]
    p = spark.createDataFrame([("A", D0 + dt.timedelta(days=i), float(c), float(c), float(c)) for i, c in enumerate(closes)], "symbol string, date date, high double, low double, close double")
    got = paths.structure(p, 1).orderBy("date").collect()
    # the row after a reversal takes its direction from the last two swings again
    assert [r["direction"] for r in got][9:] == [1, 1, 1, 0, 1]
    assert [r["breaks"] for r in got][9:12] == [0, 1, 1] and [r["reversal"] for r in got][12] == 1


def test_ranges_need_a_long_crooked_stay(spark):
    rows = [("A", D0 + dt.timedelta(days=i), 11.0, 9.0, 10.0 + (-1) ** i * 0.5, 0) for i in range(16)] + [("A", D0 + dt.timedelta(days=16), 12.0, 10.0, 11.0, 1)]
    p = spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double, direction long")
    got = [r["ok"] for r in paths.ranges(p).orderBy("date").collect()]
    assert got == [0.0] * 10 + [1.0] * 6 + [None]


def test_deflated_sharpe_against_its_formula(spark):
    n, s, skew, kurt, trials, var = 250, 0.1, -0.3, 4.0, 10, 0.02
    row = stats.deflate(spark.createDataFrame([(n, s, skew, kurt, trials, var)], "n long, sharpe double, skew double, kurt double, trials long, var double")).first()
    cdf, quantile = NormalDist().cdf, NormalDist().inv_cdf
    scale = math.sqrt((n - 1) / (1 - skew * s + (kurt - 1) / 4 * s * s))
    most = math.sqrt(var) * ((1 - 0.5772156649) * quantile(0.9) + 0.5772156649 * quantile(1 - 1 / (10 * math.e)))
    assert row["psr"] == pytest.approx(cdf(s * scale)) and row["dsr"] == pytest.approx(cdf((s - most) * scale))


def test_failure_probability_scales_by_the_variance(spark):
    row = stats.failure_probability(spark.createDataFrame([(0.01, -0.01, 0.6)], "up double, down double, p double"), 52.0, 2.0).first()
    # with payoffs of one size, (2p - 1)^2 * 52 = 4 * 4p(1 - p), whose larger root is this
    need = 0.5 * (1 + math.sqrt(1 - 52 / 56))
    assert row["failure"] == pytest.approx(NormalDist().cdf((need - 0.6) / 0.24))


def test_overfit_table_finds_a_trial_that_is_always_best(spark):
    rows = [(f"T{k}", D0 + dt.timedelta(days=i), 0.001 * k + 0.0001 * (i % 3)) for i in range(32) for k in range(5)]
    got = stats.overfit_table(spark.createDataFrame(rows, "symbol string, date date, r double"), 8).first()
    assert (got["trials"], got["chunks"], got["pbo"]) == (5, 8, 0.0)
