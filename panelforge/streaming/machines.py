"""State machines over bars that arrive as a stream: CUSUM events, hysteresis of a direction, and the super trend.

A symbol's state is its machine's numbers; bars that arrive wait in the state until the watermark has passed them and are
then taken in order of time, so a result does not depend on how arrivals were cut into batches, and equals the batch's row by
row.  A timer at the earliest waiting bar releases what the watermark frees where no further bar of the symbol comes.  Bars behind
what was released already cannot be taken any more: they come out marked ``late``, so that they are counted and can be mended.
Waiting bars lie in the state store by day and piece; a worker holds ``HELD`` of them at a time, however many wait (more only
where more have the very same time).  Bars of the same time are taken by close, high and low.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

#: Columns of bars and of results.
BAR = "symbol string, ts timestamp, high double, low double, close double"
OUT = "symbol string, ts timestamp, late boolean, value double, fired boolean"
PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


# ---- machines: (state or None, bar) -> (state, value, fired) -----------------------------------------------------


def cusum(threshold: float) -> Callable:
    """Sums of log changes above and below; the lower side is tested first and only the side that fires resets.  The value is the greater of both sums."""

    def step(state, bar):
        last, up, down = state or (None, 0.0, 0.0)
        if not bar["close"] or not bar["close"] > 0:
            return (last, up, down), None, False
        move = np.log(bar["close"] / last) if last else 0.0
        up, down = max(0.0, up + move), min(0.0, down + move)
        value = max(up, -down)
        fired = down < -threshold or up > threshold
        if down < -threshold:
            down = 0.0
        elif up > threshold:
            up = 0.0
        return (bar["close"], up, down), value, fired

    return step


def hysteresis(hold: int) -> Callable:
    """The sign of close against its last: it changes after ``hold`` bars of another sign in a row; fired where it changes."""

    def step(state, bar):
        last, now, other, run = state or (None, 0, 0, 0)
        if not bar["close"]:
            return (last, now, other, run), float(now), False
        raw = int(np.sign(bar["close"] - last)) if last is not None else 0
        other, run = (raw, run + 1 if raw == other else 1) if raw != now else (raw, 0)
        fired = run >= hold
        if fired:
            now, run = raw, 0
        return (bar["close"], now, other, run), float(now), fired

    return step


def supertrend(window: int, multiple: float) -> Callable:
    """Direction by bands about the middle of a bar, an average true range (1/window) wide; fired where it turns.  No value before ``window`` bars."""

    def step(state, bar):
        last, atr, n, top0, bottom0, way = state or (None, 0.0, 0, None, None, -1)
        h, l, c = bar["high"], bar["low"], bar["close"]
        if h is None or l is None or c is None:
            return (last, atr, n, top0, bottom0, way), None, False
        true = h - l if last is None else max(h - l, abs(h - last), abs(l - last))
        atr, n = (true if n == 0 else atr + (true - atr) / window), n + 1
        if n < window:
            return (c, atr, n, top0, bottom0, way), None, False
        top, bottom = (h + l) / 2 + multiple * atr, (h + l) / 2 - multiple * atr
        if top0 is not None:
            if last <= top0:
                top = min(top, top0)
            if last >= bottom0:
                bottom = max(bottom, bottom0)
        before = way
        if top0 is not None:
            way = 1 if c > top0 else -1 if c < bottom0 else way
        return (c, atr, n, top, bottom, way), float(way), top0 is not None and way != before

    return step


MACHINES = {"cusum": cusum, "hysteresis": hysteresis, "supertrend": supertrend}


def run(name: str, params: tuple, bars: list[dict], state=None):
    """The machine over bars in order: its last state and (value, fired) of each bar."""
    step, out = MACHINES[name](*params), []
    for bar in bars:
        state, value, fired = step(state, bar)
        out.append((value, bool(fired)))
    return state, out


# ---- the stream --------------------------------------------------------------------------------------------------


#: A bar as it waits: microseconds and prices, absent ones NaN.
KEPT = np.dtype([("ts", "i8"), ("high", "f8"), ("low", "f8"), ("close", "f8")])
#: Bars that a worker holds at a time, bars to a piece, bars that a machine is given at a time, and microseconds to a slot.
HELD, PIECE, STEP, SLOT = 1 << 19, 1 << 16, 10_000, 86_400_000_000


def _packed(pdf: pd.DataFrame) -> np.ndarray:
    out = np.empty(len(pdf), KEPT)
    out["ts"] = pd.to_datetime(pdf["ts"], utc=True).astype("datetime64[us, UTC]").astype("int64")
    for c in ("high", "low", "close"):
        out[c] = pd.to_numeric(pdf[c]).astype(float)
    return out


def _in_order(bars: np.ndarray) -> np.ndarray:
    return bars[np.lexsort([bars[c] for c in ("low", "high", "close", "ts")])]


def _told(name: str, params: tuple, symbol: str, bars: np.ndarray, state) -> Iterator[tuple]:
    """(state, rows of OUT) of bars in order, a step of them at a time."""
    for i in range(0, len(bars), STEP):
        some = bars[i : i + STEP]
        prices = ([None if v != v else v for v in some[c].tolist()] for c in ("high", "low", "close"))
        state, told = run(name, params, [{"high": h, "low": l, "close": c} for h, l, c in zip(*prices)], state)
        yield state, _out(symbol, some["ts"], False, [v for v, _ in told], [f for _, f in told])


def _out(symbol: str, ts: np.ndarray, late: bool, value, fired) -> pd.DataFrame:
    out = pd.DataFrame({"ts": pd.to_datetime(ts, unit="us", utc=True), "late": late, "value": value, "fired": fired}).astype({"value": float})
    out.insert(0, "symbol", symbol)
    return out


class _Processor(StatefulProcessor):
    """Keeps the machine's state, the time of the last bar released and, by slot, how many pieces and bars wait and the earliest one's time; the waiting bars lie beside it, a piece a key."""

    def __init__(self, name: str, params: tuple):
        self.name, self.params = name, params

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.kept = handle.getValueState("kept", "state string, slots string, released long")
        self.waiting = handle.getMapState("waiting", "slot long, piece long", "bars binary")

    def _load(self):
        got = self.kept.get() if self.kept.exists() else None
        if got is None:
            return None, {}, -(1 << 62)
        return json.loads(got[0]), {int(k): v for k, v in json.loads(got[1]).items()}, int(got[2])

    def _piece(self, slot: int, k: int) -> np.ndarray:
        return np.frombuffer(bytes(self.waiting.getValue((slot, k))[0]), KEPT)

    def _keep(self, slots: dict, bars: np.ndarray) -> None:
        """Adds bars to their slots, in pieces."""
        bars = bars[np.argsort(bars["ts"], kind="stable")]
        of = bars["ts"] // SLOT
        for part in np.split(bars, np.flatnonzero(np.diff(of)) + 1):
            for i in range(0, len(part), PIECE):
                piece, slot = part[i : i + PIECE], int(part["ts"][0] // SLOT)
                pieces, n, first = slots.get(slot, (0, 0, int(piece["ts"][0])))
                self.waiting.updateValue((slot, pieces), (piece.tobytes(),))
                slots[slot] = (pieces + 1, n + len(piece), min(first, int(piece["ts"][0])))

    def _drop(self, slots: dict, slot: int, mark: int) -> None:
        """Takes a slot's bars up to the mark out of it."""
        pieces, left, n, first = slots.pop(slot)[0], 0, 0, None
        if (slot + 1) * SLOT > mark + 1:
            for k in range(pieces):
                piece = self._piece(slot, k)
                piece = piece[piece["ts"] > mark]
                if len(piece):
                    self.waiting.updateValue((slot, left), (piece.tobytes(),))
                    left, n, least = left + 1, n + len(piece), int(piece["ts"].min())
                    first = least if first is None else min(first, least)
        for k in range(left, pieces):
            self.waiting.removeKey((slot, k))
        if left:
            slots[slot] = (left, n, first)

    def _ready(self, slots: dict, mark: int) -> Iterator[np.ndarray]:
        """Bars up to the mark in order; a slot of too many is read a stretch of time at a time."""
        for slot in sorted(slots):
            pieces, n, first = slots[slot]
            if first > mark:
                return
            cuts = [(slot * SLOT, (slot + 1) * SLOT, n)]
            while cuts:
                low, high, n = cuts.pop()
                if n > HELD and high - low > 1:
                    parts, wide = min(-(-n // HELD) * 2, high - low), high - low
                    inside = ((p["ts"][(p["ts"] >= low) & (p["ts"] < high)] - low) * parts // wide for p in (self._piece(slot, k) for k in range(pieces)))
                    count = sum(np.bincount(x, minlength=parts) for x in inside)
                    cuts += [(low - -i * wide // parts, low - -(i + 1) * wide // parts, int(c)) for i, c in enumerate(count) if c][::-1]
                    continue
                got = [p[(p["ts"] >= low) & (p["ts"] < high) & (p["ts"] <= mark)] for p in (self._piece(slot, k) for k in range(pieces))]
                bars = _in_order(np.concatenate(got))
                if len(bars):
                    yield bars
            self._drop(slots, slot, mark)

    def _release(self, symbol: str, state, slots: dict, released: int, mark: int) -> Iterator[pd.DataFrame]:
        for bars in self._ready(slots, mark):
            for state, out in _told(self.name, self.params, symbol, bars, state):  # noqa: B020
                yield out
            released = int(bars["ts"][-1])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t[0] if isinstance(t, tuple) else t)
        if slots:
            self.handle.registerTimer(slots[min(slots)][2] // 1000 + 1)
        self.kept.update((json.dumps(state), json.dumps(slots), released))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        state, slots, released = self._load()
        held, n = [], 0
        for batch in rows:
            bars = _packed(batch)
            late = bars["ts"] <= released
            if late.any():
                yield _out(key[0], bars["ts"][late], True, None, False)
            held, n = [*held, bars[~late]], n + len(bars)
            if n >= HELD:
                self._keep(slots, np.concatenate(held))
                held, n = [], 0
        if sum(map(len, held)):
            self._keep(slots, np.concatenate(held))
        yield from self._release(key[0], state, slots, released, timerValues.getCurrentWatermarkInMs() * 1000)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        state, slots, released = self._load()
        yield from self._release(key[0], state, slots, released, timerValues.getCurrentWatermarkInMs() * 1000)

    def close(self) -> None:
        pass


def stream(bars: DataFrame, name: str, params: tuple, late: str | None) -> DataFrame:
    """(symbol, ts, late, value, fired) of streamed bars (BAR): each bar once the watermark, ``late`` behind the newest, has passed it; None where the bars have a watermark."""
    spark = bars.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    marked = bars.withWatermark("ts", late) if late else bars
    return marked.groupBy("symbol").transformWithStateInPandas(_Processor(name, params), outputStructType=OUT, outputMode="append", timeMode="eventTime")


def batch(bars: DataFrame, name: str, params: tuple) -> DataFrame:
    """The same over bars that are all there."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.concat([out for _, out in _told(name, params, pdf["symbol"].iloc[0], _in_order(_packed(pdf)), None)])

    return bars.select("symbol", "ts", "high", "low", "close").groupBy("symbol").applyInPandas(one, OUT)


def drain(bars: DataFrame, name: str, params: tuple, late: str | None, root: str) -> DataFrame:
    """Runs the stream over what is there and returns all it has given out, this time and before; bars that the watermark has not passed wait in the checkpoint."""
    spark: SparkSession = bars.sparkSession
    query = stream(bars, name, params, late).writeStream.outputMode("append").format("parquet").option("checkpointLocation", f"{root}/checkpoint").option("path", f"{root}/out").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception():
        raise query.exception()
    return spark.read.schema(OUT).parquet(f"{root}/out").withColumn("value", F.nanvl("value", F.lit(None)))
