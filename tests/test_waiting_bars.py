"""Bars that wait for the watermark: a worker's memory, order and rest, by the processor alone with a state of dictionaries."""

import tracemalloc

import numpy as np
import pandas as pd
import pytest

from panelforge.streaming import machines

DAY = 86_400_000_000


class State:
    def __init__(self):
        self.one, self.many, self.timers = None, {}, set()

    def getValueState(self, *_):
        return self

    def getMapState(self, *_):
        return self

    def exists(self):
        return self.one is not None

    def get(self):
        return self.one

    def update(self, value):
        self.one = value

    def getValue(self, key):
        return self.many[key]

    def updateValue(self, key, value):
        self.many[key] = value

    def removeKey(self, key):
        del self.many[key]

    def listTimers(self):
        return iter([(t,) for t in self.timers])

    def registerTimer(self, t):
        self.timers.add(t)

    def deleteTimer(self, t):
        self.timers.discard(t)


class Mark:
    def __init__(self, us):
        self.us = us

    def getCurrentWatermarkInMs(self):
        return self.us // 1000


def processor(name="cusum", params=(0.03,)):
    p, state = machines._Processor(name, params), State()
    p.init(state)
    return p, state


def frame(ts, close):
    return pd.DataFrame({"ts": pd.to_datetime(ts, unit="us", utc=True), "high": close, "low": close, "close": close})


def many(n, days, seed=0):
    """Times in order of arrival (none) and prices by time."""
    rng = np.random.default_rng(seed)
    ts = rng.integers(0, days * DAY // 1000, n) * 1000 + 5 * DAY
    return ts, 50 * np.exp(rng.normal(0, 0.01, n))


def plain(ts, close, params=(0.03,)):
    order = np.lexsort([close, ts])
    told = machines.run("cusum", params, [{"high": c, "low": c, "close": c} for c in close[order].tolist()])[1]
    return ts[order], [v for v, _ in told], [f for _, f in told]


def rows(parts):
    parts = [x for x in parts if len(x)]
    out = pd.concat(parts) if parts else pd.DataFrame(columns=["ts", "late", "value", "fired"])
    return out


def same(out, ts, value, fired):
    got = pd.to_datetime(out["ts"], utc=True).astype("datetime64[us, UTC]").astype("int64").to_numpy()
    assert np.array_equal(got, ts) and np.allclose(out["value"].to_numpy(), value, equal_nan=True) and out["fired"].tolist() == fired and not out["late"].any()


def test_a_worker_does_not_hold_all_that_waits():
    n = 400_000
    ts, close = many(n, 30)
    batches = [frame(ts[i : i + 10_000], close[i : i + 10_000]) for i in range(0, n, 10_000)]
    p, _ = processor()
    tracemalloc.start()
    assert not list(p.handleInputRows(("a",), iter(batches), Mark(0)))
    got, fired = 0, 0
    for out in p.handleExpiredTimer(("a",), Mark(100 * DAY), None):
        got, fired = got + len(out), fired + int(out["fired"].sum())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == n and fired == sum(plain(ts, close)[2])
    assert peak < 100e6  # 13 MB of them are the bars themselves, in the state


@pytest.mark.parametrize("days", [0.001, 1, 40])
def test_waiting_bars_come_in_order_whatever_their_density(monkeypatch, days):
    """Slots of more bars than are held at a time, of one and of many pieces, bars of the same time, and the mark within a slot."""
    monkeypatch.setattr(machines, "HELD", 100)
    monkeypatch.setattr(machines, "PIECE", 16)
    monkeypatch.setattr(machines, "STEP", 7)
    ts, close = many(3000, days)
    ts[::5] = ts[0]
    p, state = processor()
    most = []
    ready = p._ready
    monkeypatch.setattr(p, "_ready", lambda *a: (most.append((len(x), len(set(x["ts"].tolist())))) or x for x in ready(*a)))
    out = list(p.handleInputRows(("a",), iter([frame(ts[i : i + 250], close[i : i + 250]) for i in range(0, 3000, 250)]), Mark(0)))
    assert not out and state.timers == {int(ts.min()) // 1000 + 1}
    for share in (0.1, 0.37, 0.371, 0.9):
        mark = int(5 * DAY + share * days * DAY) // 1000 * 1000
        out += list(p.handleExpiredTimer(("a",), Mark(mark), None))
        left = ts[ts > mark]
        assert sum(len(np.frombuffer(v[0], machines.KEPT)) for v in state.many.values()) == len(left) and state.timers == {int(left.min()) // 1000 + 1}
        assert sum(map(len, out)) == len(ts) - len(left)
    out += list(p.handleExpiredTimer(("a",), Mark(100 * DAY), None))
    assert not state.many and not state.timers
    same(rows(out), *plain(ts, close))
    assert all(n <= 100 or times == 1 or (ts == ts[0]).sum() <= n <= 100 + (ts == ts[0]).sum() for n, times in most)


def test_bars_behind_those_released_are_marked_and_absent_prices_kept():
    p, state = processor()
    first = frame(np.array([1, 2, 3]) * DAY, np.array([10.0, np.nan, 11.0]))
    out = rows(p.handleInputRows(("a",), iter([first]), Mark(2 * DAY)))
    assert len(out) == 2 and out["value"].isna().tolist() == [False, True]
    out = rows(p.handleInputRows(("a",), iter([frame(np.array([2, 4]) * DAY, np.array([5.0, 12.0]))]), Mark(3 * DAY)))
    assert out["late"].tolist() == [True, False] and out["fired"].tolist() == [False, True]
    assert state.timers == {4 * DAY // 1000 + 1}
