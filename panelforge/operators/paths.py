"""Path-dependent operators: one symbol's history is a group.  State machines that no window expresses run as numpy loops over Arrow batches of a symbol."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def _by_symbol(panel: DataFrame, columns: list[str], run, schema: str) -> DataFrame:
    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        return run(pdf.sort_values("date", kind="stable").reset_index(drop=True))

    return panel.select("symbol", "date", *columns).groupBy("symbol").applyInPandas(one, schema)


def ewm_std(panel: DataFrame, span: int, least: int = 10) -> DataFrame:
    """(symbol, date, ewm_vol): exponentially weighted standard deviation of log returns, weights adjusted for the start."""

    def run(p):
        r = np.log(p["close"].where(p["close"] > 0)).diff()
        return p[["symbol", "date"]].assign(ewm_vol=r.ewm(span=span, min_periods=least).std())

    return _by_symbol(panel, ["close"], run, "symbol string, date date, ewm_vol double")


def _true_range(p: pd.DataFrame) -> np.ndarray:
    h, l, c = (p[k].to_numpy(float) for k in ("high", "low", "close"))
    before = np.concatenate(([np.nan], c[:-1]))
    return np.maximum(np.maximum(np.abs(h - l), np.abs(h - before)), np.abs(l - before))


def _atr(p: pd.DataFrame, window: int) -> np.ndarray:
    return pd.Series(_true_range(p)).ewm(alpha=1 / window, adjust=False, min_periods=window).mean().to_numpy()


def atr(panel: DataFrame, window: int = 14, lookback: int = 10) -> DataFrame:
    """(symbol, date, atr, velocity): average true range and the price change over it."""

    def run(p):
        a = _atr(p, window)
        c = p["close"]
        return p[["symbol", "date"]].assign(atr=a, velocity=(c - c.shift(lookback)) / np.where(a == 0, np.nan, a))

    return _by_symbol(panel, ["high", "low", "close"], run, "symbol string, date date, atr double, velocity double")


def _supertrend(h: np.ndarray, l: np.ndarray, c: np.ndarray, a: np.ndarray, multiple: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Direction, line and age of one symbol; bars without a range or a price hold nothing and are passed over."""
    n = len(c)
    direction, line, age = np.full(n, np.nan), np.full(n, np.nan), np.full(n, np.nan)
    state = None  # upper band, lower band, close, direction and age of the last bar that counted
    for i in np.flatnonzero(np.isfinite(a) & np.isfinite(h) & np.isfinite(l) & np.isfinite(c)).tolist():
        top, bottom = (h[i] + l[i]) / 2 + multiple * a[i], (h[i] + l[i]) / 2 - multiple * a[i]
        way, held = -1, 0
        if state:
            up, down, before, way, held = state
            if before <= up:
                top = min(top, up)
            if before >= down:
                bottom = max(bottom, down)
            now = (1 if c[i] >= bottom else -1) if way == 1 else (1 if c[i] > top else -1)
            way, held = now, held + 1 if now == way else 0
        state = top, bottom, c[i], way, held
        direction[i], line[i], age[i] = way, bottom if way == 1 else top, held
    return direction, line, age


def supertrend(panel: DataFrame, window: int = 10, multiple: float = 3.0) -> DataFrame:
    """(symbol, date, direction, line, age): bands around the mid price that only tighten until a close breaks them; null before the range is known."""
    return supertrends(panel, window, {"": multiple})


def supertrends(panel: DataFrame, window: int = 10, multiples: dict[str, float] | None = None) -> DataFrame:
    """Directions, lines and ages for several widths over one range, their names with each width's prefix ("slow_" 3 and "fast_" 2 by default)."""
    multiples = multiples or {"slow_": 3.0, "fast_": 2.0}

    def run(p):
        a = _atr(p, window)
        h, l, c = (p[k].to_numpy(float) for k in ("high", "low", "close"))
        out = p[["symbol", "date"]].copy()
        for name, multiple in multiples.items():
            way, out[f"{name}line"], held = _supertrend(h, l, c, a, multiple)
            out[f"{name}direction"], out[f"{name}age"] = pd.array(way, dtype="Int64"), pd.array(held, dtype="Int64")
        return out

    columns = ", ".join(f"{k}direction long, {k}line double, {k}age long" for k in multiples)
    return _by_symbol(panel, ["high", "low", "close"], run, f"symbol string, date date, {columns}")


def trend_direction(panel: DataFrame, window: int = 10, slow: float = 3.0, fast: float = 2.0, hold: int = 2) -> DataFrame:
    """(symbol, date, direction): where the slow and the fast supertrend agree, else 0; a change counts after ``hold`` equal sessions."""
    both = supertrends(panel, window, {"slow_": slow, "fast_": fast})
    raw = both.selectExpr("symbol", "date", "case when slow_direction = fast_direction then slow_direction else 0 end as raw")
    return hysteresis(raw, "raw", hold).withColumnRenamed("held", "direction")


def gap_zones(panel: DataFrame) -> DataFrame:
    """(symbol, date, imbalance, retest, broken): the side of the open price gap left by three bars, whether today came back into it, and whether a close went through it.

    A gap is known at its third bar and replaces an older one; a bar that fills it wholly without a close beyond ends it.
    """

    def run(p):
        h, l, c = (p[k].to_numpy(float) for k in ("high", "low", "close"))
        n = len(c)
        out = np.zeros((3, n), np.int64)
        side, low, high = 0, np.nan, np.nan
        for i in range(n):
            if side:
                near, far, close = (l[i], low, c[i]) if side > 0 else (-h[i], -high, -c[i])
                edge = high if side > 0 else -low
                if close < far:
                    out[2, i], side = 1, 0
                elif near <= edge and close >= far:
                    out[1, i] = 1
                elif near <= far:
                    side = 0
            if i > 1 and h[i - 2] < l[i]:
                side, low, high = 1, h[i - 2], l[i]
            elif i > 1 and l[i - 2] > h[i]:
                side, low, high = -1, h[i], l[i - 2]
            out[0, i] = side
        return p[["symbol", "date"]].assign(imbalance=out[0], retest=out[1], broken=out[2])

    return _by_symbol(panel, ["high", "low", "close"], run, "symbol string, date date, imbalance long, retest long, broken long")


def cusum_events(panel: DataFrame, threshold: float, column: str = "close") -> DataFrame:
    """(symbol, date): symmetric CUSUM filter on log changes; the lower side is tested first and only the side that fires resets."""

    def run(p):
        x = p.dropna(subset=[column])
        x = x[x[column] > 0]
        up = down = 0.0
        keep = []
        for step in np.log(x[column]).diff().fillna(0.0):
            up, down = max(0.0, up + step), min(0.0, down + step)
            fired = down < -threshold or up > threshold
            if down < -threshold:
                down = 0.0
            elif up > threshold:
                up = 0.0
            keep.append(fired)
        return x.loc[keep, ["symbol", "date"]]

    return _by_symbol(panel, [column], run, "symbol string, date date")


def breakouts(panel: DataFrame, window: int = 20, cooldown: int = 5) -> DataFrame:
    """(symbol, date): first touches of a rolling high, none within the cooldown of the last."""

    def run(p):
        c = p["close"]
        at = (c >= c.rolling(window).max()) & c.notna()
        first = at & ~at.shift(1, fill_value=False)
        keep, last = [], -(10**9)
        for i in np.flatnonzero(first):
            if i - last > cooldown:
                keep.append(i)
                last = i
        return p.loc[keep, ["symbol", "date"]]

    return _by_symbol(panel, ["close"], run, "symbol string, date date")


def entropy_events(panel: DataFrame, window: int = 10, bins: int = 5, threshold: float = 0.3) -> DataFrame:
    """(symbol, date): jumps of the Shannon entropy of the previous returns' histogram."""

    def run(p):
        r = np.log(p["close"].where(p["close"] > 0)).diff().to_numpy()
        keep, before = [], None
        for i in range(window, len(r)):
            past = r[i - window : i]
            past = past[np.isfinite(past)]
            if not len(past):
                continue
            share = np.histogram(past, bins=bins)[0] / len(past)
            h = float(-(share[share > 0] * np.log2(share[share > 0])).sum())
            if before is not None and abs(h - before) >= threshold:
                keep.append(i)
            before = h
        return p.loc[keep, ["symbol", "date"]]

    return _by_symbol(panel, ["close"], run, "symbol string, date date")


def hysteresis(panel: DataFrame, column: str, hold: int = 3) -> DataFrame:
    """(symbol, date, held): a direction that changes only after ``hold`` equal values in a row."""

    def run(p):
        out, now, candidate, count = [], None, None, 0
        for x in p[column]:
            if now is None:
                now = x
            if x == now:
                candidate, count = None, 0
            else:
                count = count + 1 if x == candidate else 1
                candidate = x
                if count >= hold:
                    now, candidate, count = x, None, 0
            out.append(now)
        return p[["symbol", "date"]].assign(held=out)

    return _by_symbol(panel, [column], run, "symbol string, date date, held long")


def structure(panel: DataFrame, side: int = 3) -> DataFrame:
    """(symbol, date, direction, breaks, reversal, swing_high, swing_low, age, broke): market structure from confirmed swings.

    Higher highs with higher lows set direction 1, lower ones with lower ones -1.  A close that newly passes the last swing in
    the direction is a break; one that newly passes the opposite swing is a reversal and ends the direction.
    """

    def run(p):
        n, c = len(p), p["close"].to_numpy(float)
        span = 2 * side + 1
        marks = {}
        for key, how in (("high", "max"), ("low", "min")):
            x = p[key]
            mid = x.shift(side)
            edge = getattr(x.rolling(span, min_periods=1), how)()
            marks[key] = mid.where((mid == edge) & (np.arange(n) >= 2 * side)).to_numpy(float)
        rows = []
        tops, bottoms = [np.nan, np.nan], [np.nan, np.nan]
        way = breaks = 0
        seen = None
        for i in range(n):
            for mark, past in ((marks["high"][i], tops), (marks["low"][i], bottoms)):
                if mark == mark:
                    past[:] = [past[1], mark]
                    seen = i
            rise = (np.sign(tops[1] - tops[0]), np.sign(bottoms[1] - bottoms[0]))
            if rise[0] == rise[1] and rise[0] in (1, -1) and way != rise[0]:
                way, breaks = int(rise[0]), 0
            reversal = broke = 0
            if way and tops[1] == tops[1] and bottoms[1] == bottoms[1] and c[i] == c[i]:
                ahead, behind = (tops[1], bottoms[1]) if way == 1 else (bottoms[1], tops[1])
                before = c[i - 1] if i else np.nan
                if way * (c[i] - ahead) > 0 and not way * (before - ahead) > 0:
                    breaks, broke = breaks + 1, way
                elif way * (c[i] - behind) < 0 and not way * (before - behind) < 0:
                    way, breaks, reversal = 0, 0, 1
            rows.append((way, breaks, reversal, tops[1], bottoms[1], np.nan if seen is None else i - seen, broke))
        out = pd.DataFrame(rows, columns=["direction", "breaks", "reversal", "swing_high", "swing_low", "age", "broke"])
        return pd.concat([p[["symbol", "date"]], out], axis=1)

    return _by_symbol(panel, ["high", "low", "close"], run, "symbol string, date date, direction long, breaks long, reversal long, swing_high double, swing_low double, age double, broke long")


def structure_ratios(panel: DataFrame, side: int = 3) -> DataFrame:
    """(symbol, date, direction, impulse, pullback, extension): how far the present leg has gone, what its last swing gave back, and the one over the other.

    A leg runs between the last two swings and grows by closes that break out of it, until the next swing is known.  The ratio lies between 0
    and 10; a leg that gave nothing back is measured against five hundredths.  All are null where the structure has no direction.
    """
    number = lambda c: F.nanvl(c, F.lit(None))
    order = W.partitionBy("symbol").orderBy("date")
    st = structure(panel, side).join(panel.select("symbol", "date", "close"), ["symbol", "date"])
    st = st.withColumn("_leg", F.count_if(F.col("age") == 0).over(order.rowsBetween(W.unboundedPreceding, 0)))
    inside = W.partitionBy("symbol", "_leg").orderBy("date").rowsBetween(W.unboundedPreceding, 0)
    swing_high, swing_low = number(F.col("swing_high")), number(F.col("swing_low"))
    top = F.greatest(swing_high, F.max(F.when(F.col("broke") == 1, F.col("close"))).over(inside))
    bottom = F.least(swing_low, F.min(F.when(F.col("broke") == -1, F.col("close"))).over(inside))
    st = st.withColumns({"top": F.when(swing_low.isNotNull() & swing_high.isNotNull(), top), "bottom": F.when(swing_low.isNotNull() & swing_high.isNotNull(), bottom), "_high": swing_high, "_low": swing_low})
    up, down = (F.col("direction") == 1) & (F.col("bottom") > 0), (F.col("direction") == -1) & (F.col("top") > 0)
    gone = F.when(up, F.col("top") / F.col("bottom") - 1).when(down, 1 - F.col("bottom") / F.col("top"))
    back = F.when(up & (F.col("top") > 0), 1 - F.col("_low") / F.col("top")).when(down & (F.col("bottom") > 0), F.col("_high") / F.col("bottom") - 1)
    st = st.withColumn("impulse", gone).withColumn("pullback", F.when(back.isNotNull(), F.greatest(back, F.lit(0.0))))
    ratio = F.col("impulse") / F.when(F.col("pullback") > 1e-6, F.col("pullback")).otherwise(0.05)
    bounded = F.greatest(F.lit(0.0), F.least(F.lit(10.0), ratio))
    return st.select("symbol", "date", "direction", "impulse", "pullback", F.when(F.col("impulse").isNotNull(), bounded).alias("extension"))


def ranges(panel: DataFrame, least: int = 10, most: int = 40) -> DataFrame:
    """(symbol, date, ok, edge, width): boxes of the rows whose ``direction`` is 0; null elsewhere.

    ``width`` is the box over the average true range, ``edge`` the third in which the close stands, ``ok`` 1 where the stay is
    at least ``least`` rows long, moved half of its path or less, and closes inside.
    """

    def run(p):
        n, a = len(p), _atr(p, 14)
        h, l, c, d = (p[k].to_numpy(float) for k in ("high", "low", "close", "direction"))
        out, stay = np.full((n, 3), np.nan), -1
        for i in range(n):
            stay = stay + 1 if d[i] == 0 else -1
            if stay < 0:
                continue
            box = slice(i - min(stay + 1, most) + 1, i + 1)
            top, bottom = np.nanmax(h[box]), np.nanmin(l[box])
            path = np.nansum(np.abs(np.diff(c[box])))
            straight = (abs(c[i] - c[box][0]) / path if path > 1e-12 else 0.0) if stay else np.nan
            size = top - bottom
            if size > 0 and a[i] > 0:
                out[i, 2] = size / a[i]
            if size > 1e-12 and np.isfinite(c[i]):
                third = 3 * (c[i] - bottom) / size
                out[i, 1] = 1.0 if third >= 2 else -1.0 if third <= 1 else 0.0
            out[i, 0] = float(stay >= least and straight <= 0.5 and bottom <= c[i] <= top)
        return p[["symbol", "date"]].assign(ok=out[:, 0], edge=out[:, 1], width=out[:, 2])

    return _by_symbol(panel, ["high", "low", "close", "direction"], run, "symbol string, date date, ok double, edge double, width double")
