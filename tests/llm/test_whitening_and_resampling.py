"""Embedding whitening and importance resampling against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest

pytest.importorskip("panelforge.llm.queries")

from panelforge.llm import embedding_whitening, importance_sampling, queries  # noqa: E402

DIR = "/root/testdata/sf0.001"
#: Columns whose names the operators use inside.
CLASH = ", dim int, n long, emb string, part int, w double, m string, row string, rank long, weight string, at long"
FILL = (1, 2, "x", 3, 4.0, "y", "z", 5, "v", 6)


def whitened_by_hand(rows, most=8):
    """(vec_id, component) to the contract's numbers, by numpy's own eigenvectors and Python's integers."""
    out = []
    for dim in sorted({len(v) for _, v in rows if v}):
        own = [(i, v) for i, v in rows if len(v) == dim]
        x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in own], object)
        n, s = len(own), sum(x)
        z = n * x - s
        value, vector = np.linalg.eigh(((z.T @ z) / n**3).astype(float))
        value, vector = value[::-1], vector[:, ::-1]
        for (i, _), row in zip(own, z):
            for k in range(min(most, dim)):
                live = value[k] > 1e-12 * value[0]
                w = abs(float((row / n).astype(float) @ vector[:, k] / math.sqrt(value[k]))) if live else None
                out.append((i, k + 1, n, sum(int(v) ** 2 for v in row), w, value[k] / value.sum() if value.sum() else None))
    return sorted(out, key=str)


def check_whitening(spark, rows, kind="float"):
    kept = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    frame = spark.createDataFrame([(i, v, *FILL) for i, v in rows], f"vec_id long, embedding array<{kind}>{CLASH}")
    got = embedding_whitening.by_component(embedding_whitening.whiten(frame.repartition(7))).collect()
    want = whitened_by_hand(kept)
    mine = sorted([(r["vec_id"], r["component"], r["n"], int(r["deviation_wide"]), None if r["whitened"] is None else abs(r["whitened"]), r["explained"]) for r in got], key=str)
    assert [r[:3] for r in mine] == [r[:3] for r in want]
    groups = {}
    for a in mine:
        groups.setdefault(a[:4], []).append(a)
    theirs = {}
    for b in want:
        theirs.setdefault(b[:4], []).append(b)
    assert groups.keys() == theirs.keys()
    for key, own in groups.items():
        for a, b in zip(own, theirs[key]):
            assert (a[4] is None) == (b[4] is None) and (a[4] is None or abs(a[4] - b[4]) < 1e-7)
            assert (a[5] is None) == (b[5] is None) and (a[5] is None or abs(a[5] - b[5]) < 1e-9)
    for r in got:
        assert r["deviation"] == (int(r["deviation_wide"]) if r["deviation_wide"] < 1 << 63 else None)
        assert r["identity_error"] is None or r["identity_error"] < 1e-9
    return got


def test_whitening_equals_eigenvectors(spark):
    rng = np.random.default_rng(1)
    shape = rng.standard_normal((12, 12)) * np.linspace(1, 3, 12)
    rows = [(i, [float(np.float32(c)) for c in rng.standard_normal(12) @ shape]) for i in range(80)]
    rows += [(None, rows[3][1]), (3, rows[3][1]), (900, None), (901, [float("nan")] * 12), (902, [1.0] * 11 + [None]), (903, [float("inf")] + [0.0] * 11), (904, [])]
    assert len(check_whitening(spark, rows)) == 82 * 8


def test_whitening_of_odd_tables(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [float(c) for c in rng.standard_normal(3)]) for i in range(20)] + [(100 + i, [float(c) for c in rng.standard_normal(10)]) for i in range(30)]
    check_whitening(spark, rows, "double")  # two lengths, one of fewer components than asked for
    got = check_whitening(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.75]), (3, [0.5, 0.0])])  # a constant dimension
    assert sum(r["whitened"] is None for r in got) == 3
    assert all(r["whitened"] is None and r["explained"] is None and r["deviation"] == 0 for r in check_whitening(spark, [(1, [0.5, 0.25])]))
    check_whitening(spark, [(i, [1e9 * float(c) for c in rng.standard_normal(4)]) for i in range(40)], "double")  # beyond one limb, and beyond a long
    assert check_whitening(spark, []) == []
    far = spark.createDataFrame([(1, [1e300, 0.0]), (2, [-1e300, 1.0])], "vec_id long, embedding array<double>")
    assert embedding_whitening.whiten(far).count() == 2


def test_divide_and_conquer_of_hard_spectra():
    rng = np.random.default_rng(3)
    for values in ([5, 5, 5, 1, 1, 0], [1] * 6, [0] * 5, [1e8, 1, 1 + 1e-9, 1e-3], list(np.logspace(6, -6, 40)), [1e-12 * k for k in range(9)]):
        n = len(values)
        q, _ = np.linalg.qr(rng.standard_normal((n, n)))
        a = (q * np.array(values, float)) @ q.T
        a = (a + a.T) / 2
        got, v = embedding_whitening.leading(a, 8)
        scale = max(np.linalg.norm(a), 1e-300)
        assert np.abs(got - np.sort(values)[::-1][:8]).max() <= 1e-13 * scale
        assert np.abs(v.T @ v - np.eye(len(got))).max() < 1e-13
        assert np.linalg.norm(a @ v - v * got) <= 1e-13 * scale
    a = rng.standard_normal((30, 30))
    a = (a + a.T) / 2
    u = embedding_whitening.polar(a)
    value, vector = np.linalg.eigh(a)
    assert np.abs(u - (vector * np.sign(value)) @ vector.T).max() < 1e-12


def test_gram_is_exact():
    rng = np.random.default_rng(4)
    for most in (100, 1 << 21, 1 << 45, 1 << 61):
        y = rng.integers(-most, most, (300, 5))
        assert (embedding_whitening.exact_gram(y) == y.astype(object).T @ y.astype(object)).all()


def resampled_by_hand(docs, target, order, buckets, percent, least, seed):
    def runs(text):
        low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
        words = re.findall(rb"[0-9a-z\x80-\xff]+", low)
        return words, [zlib.crc32(b" ".join(words[i : i + k])) % buckets for k in range(1, order + 1) for i in range(len(words) - k + 1)]

    s, t = [0] * buckets, [0] * buckets
    for table, into in ((docs, s), (target, t)):
        for _, text in table:
            for b in runs(text)[1]:
                into[b] += 1
    gain = [math.floor(1000 * math.log((float(b) + 1) * (sum(s) + buckets) / ((float(a) + 1) * (sum(t) + buckets)))) for a, b in zip(s, t)]
    out = []
    for i, text in docs:
        words, own = runs(text)
        weight = sum(gain[b] for b in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words)])
    fit = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0))
    for k, r in enumerate(fit[: percent * len(fit) // 100], 1):
        r[4] = k
    return sorted(map(tuple, out), key=str)


@pytest.mark.parametrize("order,block", [(1, 1 << 17), (1, 3), (3, 1 << 17), (3, 4), (2, 1)])
def test_resampling_equals_brute_force(spark, monkeypatch, order, block):
    rng = random.Random(5)
    vocabulary = ["a", "B", "ÉTÉ", "été", "x-y", "3,14", "foo_bar", "straße", "日本", "\x00", "ﬁ", "don't"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(0, 60))) for i in range(70)] + [(200, None), (201, ""), (202, "  \n"), (203, text(9000))]
    target = [(i, text(12)) for i in range(5)] + [(9, None)]
    monkeypatch.setattr(importance_sampling, "BLOCK", block)
    frame = lambda rows: spark.createDataFrame([(i, t, *FILL) for i, t in rows], f"doc_id long, text string{CLASH}")
    got = importance_sampling.resample(frame(docs).repartition(5), frame(target), order, 50, 30, 10, 7)
    assert sorted(map(tuple, got.collect()), key=str) == resampled_by_hand(docs, target, order, 50, 30, 10, 7)


def test_blocks_within_a_batch():
    import pyarrow as pa

    texts = ["one two three", None, "four", "", "five six seven eight nine"]
    old, parts = importance_sampling.BLOCK, {}
    try:
        for block in (1, 2, 3, 100):
            importance_sampling.BLOCK = block
            parts[block] = sorted((int(d), int(b)) for _, doc, code in importance_sampling.features(pa.array(texts), 3, 10**6) for d, b in zip(doc, code))
    finally:
        importance_sampling.BLOCK = old
    want = sorted((d, zlib.crc32(" ".join(w[i : i + k]).encode()) % 10**6) for d, t in enumerate(texts) for w in [(t or "").split()] for k in (1, 2, 3) for i in range(len(w) - k + 1))
    assert all(p == want for p in parts.values())


def test_resampling_of_ties_and_empty_tables(spark):
    words = " ".join(["word"] * 25)
    docs = [(None, words), (None, words), (7, words), (7, words), (7, words + " other"), (3, words)] * 5
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    got = importance_sampling.resample(frame, frame.where("false"), percent=50).collect()
    assert sorted(r["rank"] for r in got if r["rank"]) == list(range(1, 16))
    order = sorted((r for r in got if r["rank"]), key=lambda r: r["rank"])
    assert [(-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in order] == sorted((-r["score"], r["doc_id"] is None, r["doc_id"] or 0) for r in got)[:15]
    assert importance_sampling.resample(frame.where("false"), frame).collect() == []


def test_queries_equal_their_sql(spark):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.sql(f"create view {t} as select * from '{DIR}/{t}.parquet'")
    got = sorted(map(tuple, queries.QUERIES["op13_importance_resampling"](spark, DIR).collect()), key=str)
    assert got == sorted(con.sql(queries.ORACLES["op13_importance_resampling"]).fetchall(), key=str)
    rows = [(r["vec_id"], r["embedding"]) for r in spark.read.parquet(f"{DIR}/embeddings.parquet").collect()]
    assert len(check_whitening(spark, rows)) == 8 * len(rows) == queries.QUERIES["op11_embedding_whitening"](spark, DIR).count()
