"""Sequential bootstrap of overlapping events."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .labels import held_bars


def indicator_matrix(events: DataFrame, bars: DataFrame) -> DataFrame:
    """(event_id, symbol, date): a row for each bar that an event (event_id, symbol, event_start, t1) spans, ends included."""
    return held_bars(events.where("t1 is not null"), bars.select("symbol", "date")).select("event_id", "symbol", "date")


def draw(first: np.ndarray, last: np.ndarray, size: int, rng: np.random.Generator) -> list[int]:
    """Indices of ``size`` events that hold bars first..last, each drawn by its mean uniqueness beside those drawn before.

    With c the bars' counts of drawn events, a candidate's uniqueness is the mean of 1/(c + 1) over its bars: one prefix sum
    answers all candidates of a step.
    """
    held = np.zeros(int(last.max()) + 1 if len(last) else 0)
    out: list[int] = []
    length = last - first + 1
    while len(out) < size:
        prefix = np.concatenate(([0.0], np.cumsum(1 / (held + 1))))
        u = np.where(length > 0, (prefix[last + 1] - prefix[first]) / np.maximum(length, 1), 0.0)
        p = u / u.sum() if u.sum() > 0 else np.full(len(u), 1 / len(u))
        k = int(rng.choice(len(u), p=p))
        out.append(k)
        held[first[k] : last[k] + 1] += 1
    return out


def sequential_bootstrap(events: DataFrame, bars: DataFrame, size: int | None = None, seed: int = 0) -> DataFrame:
    """(symbol, draw, event_id): draws with replacement for each symbol, as many as it has events unless told otherwise.

    The draws of a symbol depend on each other, so a symbol is one group; symbols run apart, each from its own seed.
    """
    seq = bars.select("symbol", "date").groupBy("symbol").agg(F.array_sort(F.collect_set("date")).alias("days"))
    placed = events.join(seq, "symbol").select("event_id", "symbol", F.size(F.filter("days", lambda d: d < F.col("event_start"))).alias("first"), (F.size(F.filter("days", lambda d: d <= F.col("t1"))) - 1).alias("last"), F.abs(F.hash("symbol")).alias("own"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf[pdf["last"] >= pdf["first"]].sort_values("event_id", kind="stable").reset_index(drop=True)
        if pdf.empty:
            return pd.DataFrame({"symbol": [], "draw": [], "event_id": []})
        rng = np.random.default_rng([seed, int(pdf["own"].iloc[0])])
        got = draw(pdf["first"].to_numpy(), pdf["last"].to_numpy(), size or len(pdf), rng)
        return pd.DataFrame({"symbol": pdf["symbol"].iloc[0], "draw": np.arange(len(got)), "event_id": pdf["event_id"].to_numpy()[got]})

    return placed.groupBy("symbol").applyInPandas(run, "symbol string, draw long, event_id string")


def bags(placed: DataFrame, trees: int, share: float | None = None, seed: int = 0, block: int = 256) -> DataFrame:
    """(event_id, copies array<int>): how often each of ``trees`` bags holds an event of placed(event_id, symbol, first, last).

    Bags are drawn sequentially by uniqueness inside blocks of ``block`` consecutive events of a symbol, so that a group is bounded
    whatever a symbol's history; events of two blocks overlap at their edge only.  A bag takes ``share`` of a block's events, or the block's
    mean uniqueness if not told.
    """
    # places in a symbol come from its bars, whose number is known on the row: a block is a span of bars with no more events than bars
    blocked = placed.withColumn("block", F.floor(F.col("first") / block).cast("long"))

    def run(key, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["first", "event_id"], kind="stable").reset_index(drop=True)
        low = pdf["first"].to_numpy() - pdf["first"].min()
        high = pdf["last"].to_numpy() - pdf["first"].min()
        held = np.bincount(np.concatenate([np.arange(a, b + 1) for a, b in zip(low, high)]), minlength=int(high.max()) + 1)
        total = np.concatenate(([0.0], np.cumsum(1 / np.maximum(held, 1))))
        unique = ((total[high + 1] - total[low]) / (high - low + 1)).mean()
        size = max(1, int(round((share if share is not None else unique) * len(pdf))))
        rng = np.random.default_rng([seed, int(pdf["own"].iloc[0]), int(key[1])])
        copies = np.stack([np.bincount(draw(low, high, size, rng), minlength=len(pdf)) for _ in range(trees)], axis=1)
        return pd.DataFrame({"event_id": pdf["event_id"], "copies": list(copies.astype(np.int32))})

    rows = blocked.withColumn("own", F.abs(F.hash("symbol")))
    return rows.groupBy("symbol", "block").applyInPandas(lambda key, pdf: run(key, pdf), "event_id string, copies array<int>")
