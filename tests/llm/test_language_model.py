"""The hashed maximum-entropy model against a word by word version, and its probabilities' sum."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

pytest.importorskip("panelforge.llm.queries")

from panelforge.llm import language_model as lm  # noqa: E402

DIR = "/root/testdata/sf0.001"
CLASH = ", word string, n long, row string, rare int, k int, own double, part int, score string"
FILL = ("x", 1, "y", 2, 3, 4.0, 5, "z")


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [w.decode() for w in re.findall(rb"[^\x20\x09-\x0D]+", low)] + [lm.END]


def fold(i):
    return None if i is None else zlib.crc32(str(i).encode()) % 10


def trained(docs, known=1 << 18):
    counts = lm.written(lm.word_counts(lm.training(docs, "doc_id")))
    vocab = lm.vocabulary(counts, known)
    encoded = lm.written(lm.encode(docs, vocab))
    return counts, vocab, encoded, lm.train(encoded, vocab, bits=10)


def by_hand(rows, model, v):
    """The contract's columns, and the model's score word by word from its table."""
    counts = Counter(t for i, text in rows if fold(i) not in (None, 0) for t in tokens(text))
    total = sum(counts.values())
    assert (v.total, v.distinct) == (total, len(counts))
    single = {w: k for k, w in enumerate(v.words[: lm.SINGLE])}
    unit = lambda w: single.get(w, lm.bucket(w.encode()))
    mass = Counter()
    for w, n in counts.items():
        mass[unit(w)] += n + lm.SMOOTH
    for u in range(lm.SINGLE, lm.UNITS):
        mass[u] += lm.SMOOTH
    mass.setdefault(0, lm.SMOOTH)
    out = []
    for i, text in rows:
        base = own = 0.0
        back = [0, 0]
        for t in tokens(text):
            c = counts[t]
            base += math.log10((c + 0.1) / (total + 0.1 * (len(counts) + 1)))
            u = unit(t)
            keys = np.array([[back[0]], [back[1] + lm.UNITS], [back[0] * lm.UNITS + back[1] + 2 * lm.UNITS]], np.uint64)
            for rows_, bias, y in ((lm.rows_of(keys, None, model.bits), model.class_bias, u // lm.WIDTH), (lm.rows_of(keys, np.array([u // lm.WIDTH]), model.bits), model.unit_bias[u // lm.WIDTH], u % lm.WIDTH)):
                z = bias.astype(float) + model.table[rows_[:, 0]].astype(float).sum(axis=0)
                own += (z[y] - np.log(np.exp(z - z.max()).sum()) - z.max()) / math.log(10)
            own += math.log10((c + 0.1) / mass[u])
            back = [u, back[0] if u else 0]
        out.append((i, fold(i) == 0, len(tokens(text)), sum(counts[t] > 0 for t in tokens(text)), total, base, own))
    return out


def odd_rows():
    rng = random.Random(3)
    vocabulary = [a + b for a in ("ba", "Ko", "ré", "x", "日") for b in ("ti", "NA", "ß", "", "one,")]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    rows = [(i, say(rng.randint(0, 50)) + (f" once{i}" if i % 3 else "")) for i in range(120)]
    return rows + [(None, say(30) + " never-trained"), (500, None), (501, ""), (502, " \t\n"), (503, say(4000)), (7, rows[7][1]), (7, "another text"), (600, "a\x00b \x1c    x")]


@pytest.mark.parametrize("known,piece", [(1 << 18, 1 << 24), (20, 1 << 24), (1 << 18, 64), (0, 1)])
def test_scores_equal_a_word_by_word_version(spark, monkeypatch, known, piece):
    monkeypatch.setattr(lm, "PIECE", piece)
    rows = odd_rows()
    docs = spark.createDataFrame([(i, t, *FILL) for i, t in rows], f"doc_id long, text string{CLASH}").repartition(3)
    counts, vocab, encoded, model = trained(docs, known)
    assert len(vocab.words) <= known + 1 and np.abs(model.table).max() > 0
    key = lambda r: (str(r[:5]), round(r[5], 4))
    got = sorted(map(tuple, lm.score(encoded, model, counts).collect()), key=key)
    want = sorted(by_hand(rows, model, vocab), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert abs(g[5] - w[5]) < 1e-8 * max(1, abs(w[5])) and abs(g[6] - w[6]) < 1e-4 * max(1, abs(w[6]))


def test_probabilities_of_a_history_add_up_to_one(spark):
    docs = spark.createDataFrame([(i, t) for i, t in odd_rows()], "doc_id long, text string")
    counts, vocab, _, model = trained(docs)
    rng = np.random.default_rng(0)
    for before in ([0, 0], [5, 3], [3, 0], *rng.integers(0, lm.UNITS, (5, 2)).tolist()):
        every = np.array([model.log10(np.array([u]), np.array(before))[0] for u in range(lm.UNITS)])
        assert abs((10**every).sum() - 1) < 1e-5
    share = Counter()
    for r in counts.collect():
        single = vocab.words.index(r["word"]) < lm.SINGLE
        u = vocab.words.index(r["word"]) if single else lm.bucket(r["word"].encode())
        share[u] += (r["n"] + lm.SMOOTH) / vocab.mass[u]
    for u in range(lm.SINGLE, lm.UNITS):
        share[u] += lm.SMOOTH / vocab.mass[u]
    assert all(abs(x - 1) < 1e-9 for x in share.values())


def test_the_step_is_the_gradient_of_the_log_likelihood():
    """The mean of the drawn steps of one token against the difference quotient of its log-probability."""
    counts = {"\n": 40, **{f"w{i}": 100 - i for i in range(90)}}
    mass, types = np.zeros(lm.UNITS, np.int64), np.zeros(lm.UNITS, np.int64)
    for w, n in counts.items():
        if w != "\n":
            mass[lm.bucket(w.encode())] += n
            types[lm.bucket(w.encode())] += 1
    vocab = lm.Vocabulary(sum(counts.values()), len(counts), list(counts), list(counts.values()), mass, types)
    model = lm.Model(vocab, 8)
    rng = np.random.default_rng(1)
    model.table[:] = rng.normal(0, 0.5, model.table.shape)
    start, units, before = model.table.copy(), np.array([37]), np.array([4, 9])
    total, n = np.zeros_like(start, float), 4000
    for _ in range(n):
        model.table, model.seen = start.copy(), np.full(1 << 8, 1e6 - 8 - 1, np.float32)
        model.learn(units, before, rng, 1000.0)  # a step of about 1
        total += (model.table - start) / n
    model.table = start
    rows = np.unique(np.concatenate([r.ravel() for r, _, _ in model.levels(units, lm.histories(units, before))]))
    for row in rows:
        for k in range(0, lm.WIDTH, 5):
            at = start.astype(np.float32).copy()
            at[row, k] += 0.05
            model.table = at
            up = model.log10(units, before)[0]
            at[row, k] -= 0.1
            slope = (up - model.log10(units, before)[0]) / 0.1 * math.log(10)
            model.table = start
            assert abs(slope - total[row, k]) < 0.05
    assert not np.delete(total, rows, axis=0).any()


def test_merging_is_a_mean_by_tokens():
    rng = np.random.default_rng(2)
    parts = [(np.sort(rng.choice(lm.BLOCK, 40, False)), rng.integers(1, 9, 40).astype(float), rng.normal(0, 1, (40, lm.WIDTH))) for _ in range(6)]
    bodies = [lm._pack(*p) for p in parts]
    rows, seen, change = lm._unpack(lm._merge([lm._merge(bodies[:2]), lm._merge(bodies[2:])]))
    for r, n, c in zip(rows, seen, change):
        own = [(p[1][p[0] == r][0], p[2][p[0] == r][0]) for p in parts if r in p[0]]
        assert n == sum(k for k, _ in own)
        assert np.abs(c - sum(k * d for k, d in own) / n).max() < 0.01


def test_held_out_texts_gain_and_tables_may_be_empty(spark):
    from panelforge.llm import queries

    got = queries.QUERIES["op12_lm_scoring"](spark, DIR).collect()
    docs = spark.read.parquet(f"{DIR}/documents.parquet").select("doc_id", "text")
    assert len(got) == docs.count()
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert lm.log_probabilities(docs.where("false")).collect() == []
    untrained = lm.log_probabilities(docs.where("doc_id < 3").selectExpr("cast(null as long) as doc_id", "text")).collect()
    assert len(untrained) == 3 and all(r["base_score"] == 0 and r["n_known"] == 0 and r["train_tokens"] == 0 and not r["held_out"] and math.isfinite(r["score"]) for r in untrained)


def test_buckets_of_spark_and_python(spark):
    words = ["a", "ab", "abc", "été", "日", "日本語", "x" * 50, ""]
    rows = spark.createDataFrame([(w,) for w in words], "word string")
    assert [(r[0], r[1]) for r in rows.select("word", lm.bucket_column(rows.word)).collect()] == [(w, lm.bucket(w.encode())) for w in words]
