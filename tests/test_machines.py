"""Streamed state machines against the same machines over all bars at once."""

import datetime as dt
import math

import numpy as np
import pytest

from panelforge.streaming import machines

T0 = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
PARAMS = {"cusum": (0.03,), "hysteresis": (3,), "supertrend": (5, 1.5)}


def bars(seed=0, n=60):
    rng = np.random.default_rng(seed)
    rows = []
    for s in ("a", "b"):
        c = 50 * np.exp(rng.normal(0, 0.02, n).cumsum())
        rows += [(s, T0 + dt.timedelta(hours=i), float(c[i] * 1.01), float(c[i] * 0.99), float(c[i])) for i in range(n)]
    rows[7] = (*rows[7][:2], None, None, None)
    return rows


def told(df):
    return sorted((r["symbol"], r["ts"], r["late"], None if r["value"] is None or math.isnan(r["value"]) else round(r["value"], 9), r["fired"]) for r in df.collect())


def land(spark, rows, path):
    spark.createDataFrame(rows, machines.BAR).coalesce(1).write.mode("append").parquet(path)


@pytest.mark.parametrize("name", sorted(PARAMS))
def test_stream_equals_batch_whatever_the_cuts(spark, tmp_path, name):
    rng = np.random.default_rng(3)
    rows = bars()
    near = sorted(rows, key=lambda r: r[1] + dt.timedelta(hours=float(rng.uniform(0, 3))))  # out of order by up to three hours
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    closing = [(s, T0 + dt.timedelta(hours=500 + k), 1.0, 1.0, 1.0) for k in (0, 1) for s in ("a", "b")]
    for part in (near[:31], near[31:77], near[77:], closing[:2], closing[2:]):
        land(spark, part, source)
        got = machines.drain(spark.readStream.schema(machines.BAR).parquet(source), name, PARAMS[name], "5 hours", root)
    last = T0 + dt.timedelta(hours=100)
    want = told(machines.batch(spark.createDataFrame(rows, machines.BAR), name, PARAMS[name]))
    mine = [r for r in told(got) if r[1].replace(tzinfo=dt.timezone.utc) < last]
    assert mine == want and any(r[4] for r in want)


def test_bars_behind_the_watermark_come_out_marked(spark, tmp_path):
    rows = [(s, t, h, l, c) for s, t, h, l, c in bars(1) if s == "a"]
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    for part in (rows[:30] + rows[31:50], [rows[55]], [rows[30]], [rows[59]], [("a", T0 + dt.timedelta(hours=400), 1.0, 1.0, 1.0)], [("a", T0 + dt.timedelta(hours=401), 1.0, 1.0, 1.0)]):
        land(spark, part, source)
        got = machines.drain(spark.readStream.schema(machines.BAR).parquet(source), "cusum", (0.03,), "5 hours", root)
    rows_out = told(got)
    late = [r for r in rows_out if r[2]]
    assert len(late) <= 1 and len([r for r in rows_out if not r[2]]) >= 51
    want = told(machines.batch(spark.createDataFrame(rows[:30] + rows[31:50] + [rows[55], rows[59]], machines.BAR), "cusum", (0.03,)))
    assert [r for r in rows_out if not r[2]][: len(want)] == want


def test_machines_by_hand():
    price = [10.0, 10.2, 10.6, 10.1, 9.5, 9.6]
    b = [{"high": p, "low": p, "close": p} for p in price]
    fired = [f for _, f in machines.run("cusum", (0.05,), b)[1]]
    assert fired == [False, False, True, False, True, False]
    assert [v for v, _ in machines.run("hysteresis", (2,), b)[1]] == [0, 0, 1, 1, -1, -1]
