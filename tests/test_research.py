"""Registries, samples, sessions and sources on small inputs with literal results."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from panelforge.features.registry import Feature, Registry, attach, entry_of, fingerprint, matrix, shift_days
from panelforge.operators import labels, paths, samples, universe
from panelforge.plans import sessions
from panelforge.sources import contract
from panelforge.sources.layer import DataLayer, adjust
from panelforge.sources.market import MarketSource

D = [dt.date(2024, 1, d) for d in (2, 3, 4, 5, 8, 9)]


def bars(spark, closes=(10.0, 10.0, 11.0, 9.0, 12.0, 8.0), opens=None):
    opens = opens or closes
    return spark.createDataFrame([("a", d, float(o) if o is not None else None, c) for d, o, c in zip(D, opens, closes)], "symbol string, date date, open double, close double")


def test_registry():
    r = Registry([Feature("a", lambda: F.col("close")), Feature("b", lambda: F.col("a") * 2, needs=("a",)), Feature("c", lambda: F.col("b") + F.col("a"), needs=("b", "a"))])
    assert [[f.name for f in s] for s in r.stages(["c"])] == [["a"], ["b"], ["c"]]
    assert r.register(Feature("a", lambda: F.lit(0))).name == "a"
    with pytest.raises(ValueError, match="version"):
        r.register(Feature("a", lambda: F.lit(0), version="2"))
    with pytest.raises(KeyError, match="no feature"):
        r.get("z")
    with pytest.raises(ValueError, match="circular"):
        Registry([Feature("x", lambda: F.lit(0), needs=("y",)), Feature("y", lambda: F.lit(0), needs=("x",))]).stages(["x"])
    with pytest.raises(ValueError, match="known at"):
        Feature("q", lambda: F.lit(0), known="yesterday")
    assert fingerprint(r, ["a", "b"], "open", data="1") == fingerprint(r, ["b", "a"], "open", data="1") != fingerprint(r, ["a", "b"], "open", data="2")


def test_shift_by_entry():
    assert [shift_days(k, "open") for k in ("today_open", "today_close", "next_open")] == [0, 1, 1]
    assert [shift_days(k, "close") for k in ("today_open", "today_close", "next_open")] == [0, 0, 1]
    with pytest.raises(ValueError):
        shift_days("today_open", "noon")


def test_matrix_and_events(spark):
    r = Registry([Feature("c", lambda: F.col("close")), Feature("o", lambda: F.col("open"), known="today_open")])
    values = matrix(bars(spark), r, ["c", "o"], "open", F.col("close") < 12)
    got = {x["date"]: (x["c"], x["o"], x["trustworthy"]) for x in values.collect()}
    assert got[D[0]] == (None, 10.0, True) and got[D[3]] == (11.0, 9.0, True) and got[D[4]] == (9.0, 12.0, False)
    pairs = bars(spark).select("symbol", "date").where(F.col("date") == D[3])
    events = samples.to_events(pairs, bars(spark).select("date"), 0.1, 1)
    assert attach(events, values, "open", ["c"]).first()["c"] == 11.0
    with pytest.raises(ValueError, match="entry at the close"):
        attach(events, values, "close", ["c"])
    with pytest.raises(ValueError, match="one entry time"):
        entry_of(events.union(events.withColumn("entry", F.lit("close"))))


def test_events_are_cut_at_the_last_price(spark):
    pairs = bars(spark).select("symbol", "date")
    got = {r["event_start"]: r["t1"] for r in samples.to_events(pairs, pairs.select("date"), 0.1, 3, last="2024-01-08").collect()}
    assert got[D[0]] == D[3] and got[D[1]] == D[4] and got[D[2]] == D[4] and got[D[5]] is None
    ids = sorted(r[0] for r in samples.event_ids(pairs.limit(1).union(pairs.limit(1))).select("event_id").collect())
    assert ids == ["a|20240102", "a|20240102|1"]
    with pytest.raises(ValueError, match="no key"):
        samples.unique_key(pairs.select("symbol", F.col("date").alias("event_start")).union(pairs.select("symbol", "date")))
    with pytest.raises(ValueError):
        samples.Exit(up=-1)
    assert samples.Exit().name == "pt3_sl1_v20"


def test_an_entry_on_the_last_date_of_prices_is_no_sample(spark):
    p = bars(spark)
    spec = samples.SampleSpec(lambda panel: panel.where(F.col("date").isin(D[1], D[4])), samples.Exit(1, 1, 2), "open")
    events = spec.events(p, p.select("date"), 0.1)
    assert {r["event_start"]: r["t1"] for r in events.collect()} == {D[2]: D[4], D[5]: None}
    assert [r["event_start"] for r in spec.label(events, p).collect()] == [D[2]]
    assert spec.label(events, p, drop=False).count() == 2
    values = p.withColumn("c", F.col("close"))
    assert [r["event_start"] for r in samples.build(spec, p, p.select("date"), values, "open", ["c"], 0.1).collect()] == [D[2]]


@pytest.mark.parametrize("entry", ["open", "close"])
def test_barriers_by_entry(spark, entry):
    p = bars(spark, opens=(10.0, 8.0, None, 9.0, 12.0, 8.0))
    e = spark.createDataFrame([(str(i), "a", D[i], D[i + 2], 0.1, None) for i in range(4)] + [("n", "a", D[0], None, 0.5, None), ("z", "a", D[0], D[2], 0.0, None), ("x", "b", D[0], D[2], 0.1, None)], "event_id string, symbol string, event_start date, t1 date, target double, side double")
    got = {r["event_id"]: (r["touch_type"], r["touch_time"], r["bin"]) for r in labels.triple_barrier(e, p, 1, 1, entry).collect()}
    if entry == "close":
        assert got["0"] == ("upper", D[2], 1) and got["1"][0] == "upper" and got["x"][0] == "no_data"
    else:
        assert got["0"][:2] == ("upper", D[2]) and got["1"] == ("upper", D[1], 1) and got["2"][0] == "invalid" and got["x"][0] == "invalid"
    assert got["n"][1] is None and got["z"][0] == "invalid"
    kept = labels.triple_barrier(e, p, 1, 1, entry, drop=True)
    assert kept.where("ret is null").count() == 0
    sided = labels.with_side(e, spark.createDataFrame([("a", D[0], -1.0)], "symbol string, event_start date, side double"))
    meta = {r["event_id"]: r["bin"] for r in labels.triple_barrier(sided, p, 1, 1, entry, meta="any").collect()}
    assert meta["0"] == 0 and set(meta.values()) <= {0, 1}
    twice = spark.createDataFrame([("a", D[0], -1.0), ("a", D[0], 1.0)], "symbol string, event_start date, side double")
    with pytest.raises(Exception, match="several sides"):
        labels.with_side(e, twice).collect()


def test_weights_are_one_or_the_other(spark):
    with pytest.raises(ValueError):
        labels.sample_weights(None, None, "both")
    e = spark.createDataFrame([("1", "a", D[0], D[2]), ("2", "a", D[1], None)], "event_id string, symbol string, event_start date, t1 date")
    got = {r["event_id"]: (r["uniqueness"], r["weight"]) for r in labels.sample_weights(e, bars(spark)).collect()}
    assert got["1"][0] == pytest.approx(2 / 3) and got["2"][0] is None and sum(w for _, w in got.values()) == pytest.approx(2)


def test_steps_along_sessions(spark):
    days = spark.createDataFrame([(d,) for d in D], "date date")
    rows = spark.createDataFrame([(dt.date(2024, 1, 6),), (D[0],), (None,)], "date date")
    step = lambda n: {r["date"]: r["x"] for r in sessions.step(rows, days, "date", n, "x").collect()}
    assert step(1) == {dt.date(2024, 1, 6): D[4], D[0]: D[1], None: None}
    assert step(-1) == {dt.date(2024, 1, 6): D[3], D[0]: None, None: None}
    assert step(0)[dt.date(2024, 1, 6)] == dt.date(2024, 1, 6)


def test_boards_and_weights(spark):
    s = spark.createDataFrame([("430001.BJ",), ("688001.SH",), ("688001",), ("688001.SZ",), ("600000.sh",)], "symbol string")
    assert {r[0] for r in universe.filter_boards(s, growth=False).collect()} == {"688001.SZ", "600000.sh"}
    assert universe.broad("main_a:x") == (True, True) and universe.broad("csi300") is None
    u = spark.createDataFrame([("u", D[0], "a", 1.0), ("u", D[0], "b", 3.0), ("u", D[1], "a", 0.0)], "universe string, date date, symbol string, weight double")
    mask = spark.createDataFrame([("a", D[0], True), ("a", D[1], True)], "symbol string, date date, ok boolean")
    assert {(r["date"], r["weight"]) for r in universe.intersect(u, mask).collect()} == {(D[0], 1.0), (D[1], None)}


def test_landed_source_prunes(spark, tmp_path):
    m = MarketSource(spark, 20, "2020-01-01", "2020-03-31")
    contract.LandedSource.land(m, str(tmp_path))
    layer = DataLayer(contract.LandedSource(spark, str(tmp_path)))
    for name in contract.TIME:
        assert layer.rows(name).columns == m.table(name).columns
    plan = layer.rows("daily", ["600005.SH"], "2020-02-01", "2020-02-10")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull" in plan and "In(symbol" in plan.replace("EqualTo(symbol", "In(symbol")
    assert adjust(layer.rows("daily"), "none").where("not is_suspended and abs(vwap - close) > 1e-9").count() == 0
    with pytest.raises(ValueError):
        adjust(layer.rows("daily"), "sideways")


def test_supertrend_is_null_before_the_range_and_over_gaps(spark):
    rows = [("a", D[0] + dt.timedelta(days=i), 10.0 + i, 9.0 + i, 9.5 + i if i != 6 else None) for i in range(12)]
    got = paths.supertrend(spark.createDataFrame(rows, "symbol string, date date, high double, low double, close double"), 3, 1.0).orderBy("date").collect()
    assert [r["direction"] for r in got[:3]] == [None] * 3 and got[6]["direction"] is None and got[-1]["direction"] is not None


def test_gap_zones(spark):
    rows = [(10, 9, 9.5), (11, 10, 10.5), (13, 12, 12.5), (12.5, 11, 12.2), (11, 8, 8.5), (9, 8, 8.5)]
    frame = spark.createDataFrame([("a", D[0] + dt.timedelta(days=i), float(h), float(l), float(c)) for i, (h, l, c) in enumerate(rows)], "symbol string, date date, high double, low double, close double")
    got = [(r["imbalance"], r["retest"], r["broken"]) for r in paths.gap_zones(frame).orderBy("date").collect()]
    assert got[:4] == [(0, 0, 0), (0, 0, 0), (1, 0, 0), (1, 1, 0)] and got[4][2] == 1
