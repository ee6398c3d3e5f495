"""Hidden Markov regimes of returns: a model pooled over symbols, filtered states, and a sampler of entries into the trending state.

Everything a date shows is known at that date: states are filtered, not smoothed, and windows end at their date.  A pooled fit
keeps symbols as groups and adds up the states' sufficient statistics over all of them in each round of Baum-Welch.  The
sampler fits a small model to the window of each date; windows do not depend on each other, so a symbol's dates are dealt in
chunks that carry the rows before them, and a chunk's windows are fitted together in numpy.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..session import written

#: Least variance of a state: this share of the variance of all its returns, and an absolute floor.
FLOOR, LEAST = 1e-6, 1e-14


def log_returns(panel: DataFrame, column: str = "close") -> DataFrame:
    """(symbol, date, r): log changes between a symbol's bars that have a positive price."""
    by = W.partitionBy("symbol").orderBy("date")
    priced = panel.where(F.col(column) > 0)
    return priced.select("symbol", "date", (F.ln(column) - F.ln(F.lag(column).over(by))).alias("r")).where("r is not null")


# ---- Baum-Welch over a batch of sequences --------------------------------------------------------------------------


def _emissions(x: np.ndarray, mean: np.ndarray, var: np.ndarray) -> np.ndarray:
    """Log densities (sequence, time, state)."""
    return -0.5 * (np.log(2 * np.pi * var)[:, None, :] + (x[:, :, None] - mean[:, None, :]) ** 2 / var[:, None, :])


def forward(start: np.ndarray, move: np.ndarray, emit: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log of the joint probability of what was seen up to each time and the state there; past a sequence's length its last values stand."""
    out = np.empty_like(emit)
    out[:, 0] = start + emit[:, 0]
    for t in range(1, emit.shape[1]):
        step = np.logaddexp.reduce(out[:, t - 1, :, None] + move, axis=1) + emit[:, t]
        out[:, t] = np.where((t < length)[:, None], step, out[:, t - 1])
    return out


def backward(move: np.ndarray, emit: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Log of the probability of what is seen after each time, given the state there."""
    out = np.zeros_like(emit)
    for t in range(emit.shape[1] - 2, -1, -1):
        step = np.logaddexp.reduce(move + (emit[:, t + 1] + out[:, t + 1])[:, None, :], axis=2)
        out[:, t] = np.where((t + 1 < length)[:, None], step, 0.0)
    return out


@dataclass
class Regimes:
    """Parameters of a batch of models (first axis): start, move (from, to) as logs, mean and variance of each state."""

    start: np.ndarray
    move: np.ndarray
    mean: np.ndarray
    var: np.ndarray

    @classmethod
    def begun(cls, mean: np.ndarray, calm: np.ndarray, wild: np.ndarray) -> Regimes:
        """Two states of the same mean, calm and wild, that last ten bars on average."""
        n = len(mean)
        move = np.log(np.array([[0.9, 0.1], [0.1, 0.9]]))
        return cls(np.full((n, 2), np.log(0.5)), np.tile(move, (n, 1, 1)), np.stack((mean, mean), 1), np.stack((calm, wild), 1))

    def statistics(self, x: np.ndarray, length: np.ndarray) -> dict[str, np.ndarray]:
        """Expected counts of each sequence under its model: starts, moves, weights and moments of states; and the log-likelihood."""
        live = np.arange(x.shape[1]) < length[:, None]
        emit = _emissions(np.where(live, x, 0.0), self.mean, self.var)
        a, b = forward(self.start, self.move, emit, length), backward(self.move, emit, length)
        total = np.logaddexp.reduce(a[:, -1], axis=1)
        gamma = np.where(live[:, :, None], np.exp(a + b - total[:, None, None]), 0.0)
        pair = a[:, :-1, :, None] + self.move[:, None] + (emit + b)[:, 1:, None, :] - total[:, None, None, None]
        moves = np.where(live[:, 1:, None, None], np.exp(pair), 0.0).sum(axis=1)
        v = np.where(live, x, 0.0)[:, :, None]
        return {"start": gamma[:, 0], "moves": moves, "weight": gamma.sum(1), "first": (gamma * v).sum(1), "second": (gamma * v * v).sum(1), "loglik": total}

    def improved(self, s: dict[str, np.ndarray], floor: np.ndarray) -> Regimes:
        """The model that the expected counts make likeliest."""
        tiny = 1e-300
        start = np.log(np.maximum(s["start"] / s["start"].sum(axis=1, keepdims=True), tiny))
        rows = s["moves"].sum(axis=2, keepdims=True)
        move = np.where(rows > 0, np.log(np.maximum(s["moves"] / np.maximum(rows, tiny), tiny)), self.move)
        w = np.maximum(s["weight"], tiny)
        mean = np.where(s["weight"] > 1e-12, s["first"] / w, self.mean)
        var = np.where(s["weight"] > 1e-12, s["second"] / w - mean**2, self.var)
        return Regimes(start, move, mean, np.maximum(var, floor[:, None]))


def _begin(x: np.ndarray, live: np.ndarray) -> tuple[Regimes, np.ndarray]:
    """First models from the calmer and the wilder half of each sequence, and the floors of their variances."""
    v = np.where(live, x, np.nan)
    mean = np.nanmean(v, axis=1)
    off = (v - mean[:, None]) ** 2
    middle = np.nanmedian(off, axis=1)[:, None]
    whole = np.nanmean(off, axis=1)
    floor = FLOOR * whole + LEAST
    calm, wild = (np.nan_to_num(np.nanmean(np.where(m, off, np.nan), axis=1)) for m in (off <= middle, off >= middle))
    return Regimes.begun(mean, np.maximum(calm, floor), np.maximum(wild, floor)), floor


# ---- pooled over symbols -------------------------------------------------------------------------------------------

_SUMS = ("start", "moves", "weight", "first", "second")


def fit_pooled(returns: DataFrame, rounds: int = 25, tolerance: float = 1e-6) -> tuple[Regimes, list[float]]:
    """One model of two states for all symbols of (symbol, date, r), and the log-likelihood of each round.

    A round is one pass over symbols as groups; eleven sums reach the driver.  States are ordered by variance, the calm one first.
    """
    returns = written(returns.select("symbol", "date", "r"))  # every round reads it
    moments = returns.agg(F.count("r").alias("n"), F.avg("r").alias("m"), F.var_pop("r").alias("v"), F.percentile_approx(F.abs("r"), 0.5, 100_000).alias("middle")).first()
    if not moments["n"]:
        raise ValueError("no returns")
    m, floor = float(moments["m"]), np.array([FLOOR * float(moments["v"]) + LEAST])
    halves = returns.agg(*(F.avg(F.when(c, (F.col("r") - m) ** 2)).alias(k) for k, c in (("calm", F.abs("r") <= moments["middle"]), ("wild", F.abs("r") >= moments["middle"])))).first()
    model = Regimes.begun(np.array([m]), np.maximum([float(halves["calm"])], floor), np.maximum([float(halves["wild"])], floor))
    history: list[float] = []
    for _ in range(rounds):
        held = model

        def expect(key, t: pa.Table, held=held) -> pa.Table:
            t = t.sort_by("date")
            x = t.column("r").to_numpy()[None, :]
            s = held.statistics(x, np.array([x.shape[1]]))
            return pa.table({"s": pa.array([np.concatenate([s[k].ravel() for k in _SUMS] + [s["loglik"]])], pa.list_(pa.float64()))})

        parts = returns.groupBy("symbol").applyInArrow(lambda key, t: expect(key, t), "s array<double>")
        got = np.array([r[0] for r in parts.select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).orderBy("i").select("v").collect()])
        sums = {"start": got[:2][None], "moves": got[2:6].reshape(1, 2, 2), "weight": got[6:8][None], "first": got[8:10][None], "second": got[10:12][None]}
        history.append(float(got[12]))
        model = model.improved(sums, floor)
        if len(history) > 1 and history[-1] - history[-2] <= tolerance * abs(history[-2]):
            break
    order = np.argsort(model.var[0], kind="stable")
    return Regimes(model.start[:, order], model.move[:, order][:, :, order], model.mean[:, order], model.var[:, order]), history


def filtered(returns: DataFrame, model: Regimes) -> DataFrame:
    """(symbol, date, p): the probability of the wilder state given all returns up to the date."""

    def run(key, t: pa.Table) -> pa.Table:
        t = t.sort_by("date")
        x = t.column("r").to_numpy()[None, :]
        a = forward(model.start, model.move, _emissions(x, model.mean, model.var), np.array([x.shape[1]]))[0]
        p = np.exp(a[:, 1] - np.logaddexp(a[:, 0], a[:, 1]))
        return pa.table({"symbol": t.column("symbol"), "date": t.column("date"), "p": pa.array(p)})

    return returns.groupBy("symbol").applyInArrow(lambda key, t: run(key, t), "symbol string, date date, p double")


# ---- a window for each date ----------------------------------------------------------------------------------------


def trending(windows: np.ndarray, length: np.ndarray, rounds: int) -> np.ndarray:
    """For each window (left-aligned returns of ``length``) the filtered probability, at its last return, of the state of the greater mean absolute return under a model fitted to the window alone."""
    live = np.arange(windows.shape[1]) < length[:, None]
    x = np.where(live, windows, 0.0)
    model, floor = _begin(x, live)
    for _ in range(rounds):
        model = model.improved(model.statistics(x, length), floor)
    emit = _emissions(x, model.mean, model.var)
    a, b = forward(model.start, model.move, emit, length), backward(model.move, emit, length)
    total = np.logaddexp.reduce(a[:, -1], axis=1)
    gamma = np.where(live[:, :, None], np.exp(a + b - total[:, None, None]), 0.0)
    size = (gamma * np.abs(x)[:, :, None]).sum(1) / np.maximum(gamma.sum(1), 1e-300)
    last = np.exp(a[:, -1] - total[:, None])
    return last[np.arange(len(x)), size.argmax(axis=1)]


def trend_probabilities(returns: DataFrame, window: int = 60, least: int = 30, rounds: int = 25, chunk: int = 512) -> DataFrame:
    """(symbol, date, i, n, p): ``trending`` for each date with more than ``least`` returns before it; i is the return's place and n the symbol's number of returns."""
    by = W.partitionBy("symbol")
    placed = returns.withColumn("i", F.row_number().over(by.orderBy("date")) - 1).withColumn("n", F.count("*").over(by))
    own = F.floor(F.col("i") / chunk)
    # a chunk has its own rows and the window before them
    dealt = placed.withColumn("chunk", F.explode(F.sequence(own, F.floor((F.col("i") + (window - 1)) / chunk))))

    def run(key, t: pa.Table) -> pa.Table:
        t = t.sort_by("i")
        first = key[1].as_py() * chunk
        i, r = t.column("i").to_numpy(), t.column("r").to_numpy()
        want = np.flatnonzero((i >= max(first, least)) & (i < first + chunk))
        length = np.minimum(i[want] + 1, window)
        place = np.minimum((want - length + 1)[:, None] + np.arange(window), len(r) - 1)
        p = trending(r[place], length, rounds) if len(want) else np.zeros(0)
        picked = t.take(pa.array(want))
        return pa.table({"symbol": picked.column("symbol"), "date": picked.column("date"), "i": picked.column("i"), "n": picked.column("n"), "p": pa.array(p)})

    return dealt.groupBy("symbol", "chunk").applyInArrow(lambda key, t: run(key, t), "symbol string, date date, i int, n long, p double")


def trend_entries(panel: DataFrame, window: int = 60, threshold: float = 0.7, least: int = 30, cooldown: int = 10, rounds: int = 25, column: str = "close") -> DataFrame:
    """(symbol, date): dates whose trending probability reaches the threshold from below.

    The first date of a symbol only sets the level; after an entry ``cooldown`` returns are passed over, and the level stays that of the
    entry.  Symbols of fewer than ``window + least`` prices have none.
    """
    if window < 10 or not 0 < threshold < 1:
        raise ValueError((window, threshold))
    known = trend_probabilities(log_returns(panel, column), window, least, rounds).where(F.col("n") + 1 >= window + least)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("i").reset_index(drop=True)
        keep, level, after = [], None, -1
        for k, (i, p) in enumerate(zip(pdf["i"].to_numpy(), pdf["p"].to_numpy())):
            if i <= after:
                continue
            if level is not None and level < threshold <= p:
                keep.append(k)
                after = i + cooldown
            level = p
        return pdf.loc[keep, ["symbol", "date"]]

    return known.groupBy("symbol").applyInPandas(scan, "symbol string, date date")
