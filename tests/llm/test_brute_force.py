"""Language filters against plain sets, and toxic segments against all pairs of places, through the whole scorers."""

import math
import random
import re

import numpy as np
import pytest

pytest.importorskip("panelforge.llm.queries")

from panelforge.llm import language_id, toxicity  # noqa: E402

DIR = "/root/testdata/sf0.001"


def grams_of(text):
    line = (" " + " ".join(re.findall(r"[^\W\d_]+", (text or "").lower())) + " ").encode()
    return [line[i : i + k] for k in (3, 4) for i in range(len(line) - k + 1)] if line.strip() else []


def test_rates_equal_dictionary_counts(spark):
    """The filters' hits are those of the sets and the false positives that their own cells give; with none the rates are exact."""
    rows = spark.read.parquet(f"{DIR}/documents.parquet").collect()
    rng = random.Random(1)
    sets = {}
    for lang in ("de", "en", "fr"):
        own = [r["text"] for r in rows if r["lang"] == lang][:8]
        sets[lang] = set(rng.sample(sorted({g for t in own for g in grams_of(t)}), 400))
    number = lambda g: int.from_bytes(g, "little")
    filters = language_id.Filters({k: np.array([number(g) for g in v], np.uint32) for k, v in sets.items()})
    assert (filters.false < 1e-6).all()
    for r in rows[:60]:
        got = filters.rates(language_id.letters(r["text"]))
        grams = grams_of(r["text"])
        if got is None or not grams:
            assert language_id.letters(r["text"]).strip() == b"" or len(grams) == 0
            continue
        for name, rate in zip(filters.names, got):
            want = sum(g in sets[name] for g in grams) / len(grams)
            assert abs(rate - want) < 1e-3
        best = max(filters.names, key=lambda n: (sum(g in sets[n] for g in grams), -filters.names.index(n)))
        named, score = filters.predict(r["text"])
        assert abs(sum(g in sets[named] for g in grams) - sum(g in sets[best] for g in grams)) <= 1e-3 * len(grams) and 0 <= score <= 1


def test_many_languages_in_rows_of_cells():
    rng = np.random.default_rng(2)
    sets = {f"l{i:03d}": rng.choice(1 << 24, 50, replace=False).astype(np.uint32) for i in range(130)}
    filters = language_id.Filters(sets)
    for i in (0, 63, 64, 129):
        name = f"l{i:03d}"
        line = b"".join(int(g).to_bytes(3, "little") for g in sets[name])
        grams = set(language_id.grams(line).tolist())
        rates = filters.rates(line)
        for j in (0, 63, 64, 129):
            want = sum(g in grams for g in sets[f"l{j:03d}"].tolist()) / len(language_id.grams(line))
            assert rates[j] >= want - 1e-9 and abs(rates[j] - want) < 0.05


def maximal(scores):
    """All maximal scoring segments by their definition: the best of all pairs of places, then the same to its left and right."""
    best = None
    for a in range(len(scores)):
        total = 0.0
        for z in range(a, len(scores)):
            total += scores[z]
            if total > 1e-12 and (best is None or total > best[2] + 1e-9 or (abs(total - best[2]) <= 1e-9 and z - a < best[1] - best[0])):
                best = (a, z, total)
    if best is None:
        return []
    a, z, s = best
    return maximal(scores[:a]) + [(a, z, s)] + [(x + z + 1, y + z + 1, t) for x, y, t in maximal(scores[z + 1 :])]


def test_segments_equal_a_search_over_all_pairs():
    rng = np.random.default_rng(3)
    for _ in range(200):
        n = int(rng.integers(0, 40))
        weights = np.where(rng.random(n) < 0.35, rng.uniform(0.2, 4, n), 0.0)
        drift = float(rng.uniform(0.05, 1.5))
        got = toxicity.segments(weights, drift)
        want = maximal([w if w > 0 else -drift for w in weights.tolist()])
        assert [(a, z) for a, z, _ in got] == [(a, z) for a, z, _ in want]
        assert np.allclose([s for _, _, s in got], [s for _, _, s in want])


def test_scores_equal_a_scorer_over_all_pairs(spark):
    docs, labels = spark.read.parquet(f"{DIR}/documents.parquet"), spark.read.parquet(f"{DIR}/labels.parquet")
    scorer = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, scorer).collect()}
    short = [r for r in docs.collect() if len((r["text"] or "").split()) < 120]
    assert len(short) > 20
    for r in short:
        words = re.findall(r"\w+", (r["text"] or "").lower())
        s = [max(scorer.weights.tokens.get(t, 0.0) for t in [w, *(w[:k] + "*" for k in (4, 5, 6) if len(w) > k)]) for w in words]
        found = [scorer.rate * t - math.log(max(2, len(words))) for _, _, t in maximal([x if x > 0 else -scorer.drift for x in s])]
        found = [x for x in found if x > 0]
        a, b, c = scorer.curve
        z = a + b * math.log1p(max(found, default=0.0)) + c * math.log1p(sum(found))
        assert abs(got[r["doc_id"]] - 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))) < 1e-9
