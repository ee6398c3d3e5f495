"""Toxicity by maximum-scoring segments of token log-odds.

Tokens are lower-case words and their first 4, 5 and 6 letters, so that inflected forms share evidence; a word weighs as
its heaviest token.  A token counts once for each different text that has it, so that neither a thousand copies nor one
long text weigh as many.  Its log-odds between toxic and other texts have Dirichlet priors (half a count, and more in
proportion to the sample).  Tokens whose z-score or log-odds fall below thresholds weigh as the common drift, which is
negative.  A linear scan (Ruzzo and Tompa, 1999) finds all maximal scoring segments of a text, each a passage (first and
last word, score).  Scores become extreme values: lambda solves sum p e^(lambda s) = 1 under the other documents, a
segment of score S among n words has the normalised score lambda S - ln n, and it is significant above ``SIGNIFICANT``.
Their maximum and sum are calibrated by a logistic curve.  The z-threshold and the curve are chosen inside the training
rows: ``FOLDS`` folds of different texts, each measured with the weights of the others; the least log-loss decides.

Learned from at most ``sample`` labelled rows whose crc32(doc_id) mod 5 is not 0.  Defined cases: null and empty texts
score as texts without any segment; with no toxic training rows every score is 0.  Conflicting labels of one doc_id
count as toxic.  A null doc_id is never held out and never trains.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .memory import slices
from .sampling import bounded, bucket_of

SAMPLE, PRIOR, DRIFT, SIGNIFICANT, ODDS = 20_000, 500.0, 0.05, 0.0, 2.0
#: Thresholds of the z-score, one of which the folds of the training rows choose, and those folds.
Z, FOLDS = (1.5, 2.0, 2.5, 3.0, 4.0), 3
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"
#: Words whose weights a worker keeps, which the tables of all trials share, and counts that a task holds before it passes them on.
CACHED, COUNTS = 200_000, 1 << 17
WORD = re.compile(r"\w+")


def forms(word: str) -> list[str]:
    """The tokens of a word: itself and its beginnings."""
    return [word, *(word[:k] + "*" for k in (4, 5, 6) if len(word) > k)]


class Weights(dict):
    """Weights of words, from those of their tokens; a bounded table."""

    def __init__(self, tokens: dict[str, float], cached: int = CACHED):
        self.tokens, self.cached = tokens, cached

    def __missing__(self, word: str) -> float:
        if len(self) >= self.cached:
            self.clear()
        got = max(self.tokens.get(t, 0.0) for t in forms(word))
        if len(word) < 64:
            self[word] = got
        return got

    def __reduce__(self):
        return Weights, (self.tokens, self.cached)


def segments(scores: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, score) of a text whose words score ``-drift`` but where ``scores`` is positive; linear in the number of positive words."""
    at = np.flatnonzero(scores > 0)
    out: list[list] = []  # first, last, total before it, total at its end
    total = 0.0
    before = -1
    for i, s in zip(at.tolist(), scores[at].tolist()):
        total -= drift * (i - before - 1)
        new = [i, i, total, total + s]
        total += s
        before = i
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j -= 1
            if j < 0 or out[j][3] >= new[3]:
                out.append(new)
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(a, z, hi - lo) for a, z, lo, hi in out]


class Scorer:
    def __init__(self, weights: dict[str, float], rate: float, drift: float = DRIFT, curve=(0.0, 0.0, 0.0), cached: int = CACHED):
        self.weights, self.rate, self.drift, self.curve = Weights(weights, cached), rate, drift, curve

    def passages(self, text: str | None) -> list[tuple[int, int, float]]:
        """Significant passages: first word, last word, normalised score."""
        words = WORD.findall((text or "").lower())
        s = np.fromiter(map(self.weights.__getitem__, words), float, len(words))
        n = math.log(max(2, len(words)))
        return [(a, z, x) for a, z, x in ((a, z, self.rate * s - n) for a, z, s in segments(s, self.drift)) if x > SIGNIFICANT]

    def features(self, text: str | None) -> tuple[float, float]:
        got = [x for _, _, x in self.passages(text)]
        return (math.log1p(max(got, default=0.0)), math.log1p(sum(got)))

    def score(self, text: str | None) -> float:
        a, b, c = self.curve
        x, y = self.features(text)
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * x + c * y))))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Weights by Newton's method with a small ridge."""
    x = np.column_stack((np.ones(len(x)), x))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - 1e-2 * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return tuple(map(float, w))


def _scorer(words: list[str], n1: np.ndarray, n0: np.ndarray, z: float, cached: int = CACHED) -> Scorer:
    """Weights and the scale of extreme values, from the tokens' counts in toxic and other texts."""
    t1, t0 = float(n1.sum()), float(n0.sum())
    prior = 0.5 + PRIOR * (n1 + n0) / max(1.0, t1 + t0)
    a, b = n1 + prior, n0 + prior
    odds = np.log(a / (t1 + PRIOR + 0.5 * len(words) - a)) - np.log(b / (t0 + PRIOR + 0.5 * len(words) - b))
    keep = np.flatnonzero((odds / np.sqrt(1 / a + 1 / b) >= z) & (odds >= ODDS) & (n1 > 2))
    s, p = odds[keep], b[keep] / (t0 + PRIOR + 0.5 * len(words))
    lo, hi = 1e-3, 20.0
    for _ in range(60):  # the root of a convex function above 0
        mid = (lo + hi) / 2
        over = len(s) == 0 or (p * np.exp(mid * s)).sum() + (1 - p.sum()) * math.exp(-mid * DRIFT) > 1
        lo, hi = (lo, mid) if over else (mid, hi)
    return Scorer({words[i]: float(x) for i, x in zip(keep.tolist(), s)}, hi, cached=cached)


def _trials(words: list[str], n: np.ndarray) -> list[list[Scorer]]:
    """For each fold the scorers of the others' counts, one for each threshold; a worker holds all of them."""
    cached = CACHED // (FOLDS * len(Z))
    return [[_scorer(words, n[1::2].sum(0) - n[2 * f + 1], n[::2].sum(0) - n[2 * f], z, cached) for z in Z] for f in range(FOLDS)]


def _loss(x: np.ndarray, y: np.ndarray, w: tuple[float, ...]) -> float:
    p = np.clip(1 / (1 + np.exp(-np.clip(w[0] + x @ np.array(w[1:]), -30, 30))), 1e-9, 1 - 1e-9)
    return float(-(y * np.log(p) + (1 - y) * np.log(1 - p)).mean())


def _count(batches):
    """Texts that have a token, by fold and label; a token may come several times, to be added up."""

    def rows() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k[0] for k in held]), pa.array([k[1] for k in held], pa.int32()), pa.array(held.values(), pa.int64())], ["word", "c", "n"])

    held: dict[tuple[str, int], int] = {}
    for batch in slices(batches):
        for y, fold, text in zip(*batch.columns):
            column = 2 * fold.as_py() + (y.as_py() > 0)
            for token in {t for w in set(WORD.findall(text.as_py().lower())) for t in forms(w)}:
                held[token, column] = held.get((token, column), 0) + 1
            if len(held) >= COUNTS:
                yield rows()
                held.clear()
    if held:
        yield rows()


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, id_col: str = "doc_id", text_col: str = "text") -> Scorer:
    from .components import written

    known = labels.select(F.col(id_col).alias("id"), F.col("toxic").cast("int").alias("y")).where(F.col("y").isNotNull() & F.col("id").isNotNull()).groupBy("id").agg(F.max("y").alias("y"))
    known = bounded(known.where(bucket_of("id", 5) != 0), "id", sample)
    pairs = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where("text is not null").join(F.broadcast(known), "id")  # at most ``sample`` ids
    rows = pairs.groupBy("id").agg(F.min("text").alias("text"), F.max("y").alias("y"))
    texts = written(rows.groupBy("text").agg(F.max("y").alias("y")).withColumn("fold", F.pmod(F.xxhash64("text"), F.lit(FOLDS)).cast("int")))

    counted = texts.select("y", "fold", "text").mapInArrow(_count, "word string, c int, n long").groupBy("word").agg(*(F.sum(F.when(F.col("c") == c, F.col("n")).otherwise(0)).alias(f"n{c}") for c in range(2 * FOLDS)))
    table = counted.orderBy("word").toArrow()  # the vocabulary of a bounded number of texts
    words = table["word"].to_pylist()
    n = np.stack([table[f"n{c}"].to_numpy() for c in range(2 * FOLDS)]).astype(float) if words else np.zeros((2 * FOLDS, 0))
    if not n[1::2].sum() or not n[::2].sum():
        return Scorer({}, 1.0, curve=(30.0 if n[1::2].sum() else -30.0, 0.0, 0.0))
    trial = _trials(words, n)
    held = docs.sparkSession.sparkContext.broadcast(trial)

    def measure(batches):
        for batch in slices(batches):
            f = [[x for scorer in held.value[fold] for x in scorer.features(t)] for fold, t in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(f, pa.list_(pa.float64()))], ["y", "x"])

    got = texts.select("y", "fold", "text").mapInArrow(measure, "y int, x array<double>").toArrow()  # at most ``sample`` rows of numbers
    y = (got["y"].to_numpy() > 0).astype(float)
    x = np.array(got["x"].to_pylist(), float).reshape(len(y), len(Z), 2)
    curves = [_logistic(x[:, i], y) for i in range(len(Z))]
    best = min(range(len(Z)), key=lambda i: _loss(x[:, i], y, curves[i]))
    scorer = _scorer(words, n[1::2].sum(0), n[::2].sum(0), Z[best])
    scorer.curve = curves[best]
    return scorer


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, score, predicted) for each row."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)

    def run(batches):
        for batch in slices(batches):
            s = [held.value.score(t) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(s, pa.float64()), pa.array([int(x >= 0.5) for x in s], pa.int32())], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(bucket_of(id_col, 5) == 0, F.lit(False)).alias("held_out"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)


def flag_rows(docs: DataFrame, scorer: Scorer, text_col: str = "text") -> DataFrame:
    """The rows of a table that are not predicted toxic, with all their columns."""
    held = docs.sparkSession.sparkContext.broadcast(scorer)
    place = docs.columns.index(text_col)

    def run(batches):
        for batch in slices(batches):
            yield batch.filter(pa.array([held.value.score(t) < 0.5 for t in batch.column(place).to_pylist()], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
