"""What tasks hold at once is bounded, whatever the corpus."""

from __future__ import annotations

import pickle
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import memory, pieces, suffix_dedup, toxicity
from panelforge.llm.queries import tokenizer_path


def peak(f) -> tuple[object, int]:
    tracemalloc.start()
    try:
        return f(), tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()


def test_trials_of_a_worker_keep_few_words():
    words = ["word7*", "other", "word1"]
    n = np.array([[200, 300, 90_000], [40_000, 30_000, 200]] * toxicity.FOLDS, float)
    trials = [s for part in pickle.loads(pickle.dumps(toxicity._trials(words, n))) for s in part]
    texts = [" ".join(f"word{i}" for i in range(a, a + 5_000)) for a in range(0, 60_000, 5_000)]
    got = [[s.features(t) for t in texts] for s in trials]
    assert len(trials) == 15 and sum(len(s.weights) for s in trials) <= 200_000
    for s, own in zip(trials, got):
        assert own == [toxicity.Scorer(s.weights.tokens, s.rate, cached=10**9).features(t) for t in texts]
    assert any(x > 0 for x, _ in got[0])


def test_counts_are_passed_on_in_bounded_pieces(monkeypatch):
    monkeypatch.setattr(toxicity, "COUNTS", 500)
    rng = np.random.default_rng(1)
    rows = [(int(y), int(f), " ".join(f"w{i}" for i in rng.integers(0, 3_000, 40))) for y, f in zip(rng.integers(0, 2, 200), rng.integers(0, 3, 200))]
    batches = [pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), (pa.int32(), pa.int32(), pa.string()))], ["y", "fold", "text"]) for part in (rows[:150], rows[150:])]
    out = list(toxicity._count(iter(batches)))
    assert len(out) > 2 and max(b.num_rows for b in out) < 500 + 4 * 40
    got, want = Counter(), Counter()
    for b in out:
        for word, c, n in zip(*(x.to_pylist() for x in b.columns)):
            got[word, c] += n
    for y, fold, text in rows:
        want.update((t, 2 * fold + y) for t in {t for w in text.split() for t in toxicity.forms(w)})
    assert got == want
    assert not list(toxicity._count(iter([])))


@pytest.mark.parametrize("shards", [64, None])
def test_messages_of_segments_take_little_more_than_their_bytes(shards):
    n, m = suffix_dedup.LENGTH, 12_000
    rng = np.random.default_rng(2)
    data = rng.integers(97, 123, 40 * m + 2 * n).astype(np.uint8)
    rows = np.zeros(m, suffix_dedup._SEGMENT)
    rows["h"], rows["at"], rows["windows"] = rng.integers(0, 1 << 63, m), 40 * np.arange(m), 40
    got, most = peak(lambda: suffix_dedup._bytes(3, rows, rows["at"].astype(np.int64), data, n, shards))
    assert sum(int(np.frombuffer(body, np.uint32, 1)[0]) for *_, body in got) == m
    for *_, body in got[:5]:
        k = int(np.frombuffer(body, np.uint32, 1)[0])
        part = np.frombuffer(body, suffix_dedup._SEGMENT, k, 4)
        whole = b"".join(data[r["at"] : r["at"] + 40 + n - 1].tobytes() for r in part)
        assert body[4 + part.nbytes + k :] == whole
    if shards:
        assert most < 4 * sum(len(body) for *_, body in got)


@pytest.mark.parametrize("piece", [1, 7, 1 << 12])
def test_late_windows_are_the_same_in_any_pieces(monkeypatch, piece):
    rng = np.random.default_rng(3)
    n, q = 20, 4
    data = np.tile(rng.integers(97, 100, 300).astype(np.uint8), 3)
    data[[310, 700]] = 122
    rows = np.zeros(90, suffix_dedup._SEGMENT)
    rows["key"], rows["at"], rows["windows"] = np.arange(90) // 30, 9 * np.arange(90), 9
    rows["off"], rows["inner"], rows["h"] = rows["at"] % 300, 8, 5
    monkeypatch.setattr(suffix_dedup, "_alone", lambda rows, *a: np.zeros(len(rows), bool))
    monkeypatch.setattr(suffix_dedup, "PIECE", piece)
    got = suffix_dedup._late(rows, rows["at"].astype(np.int64), data, n, q)
    first, want = {}, []
    for r in rows:
        for i in range(9):
            first[data[r["at"] + i : r["at"] + i + n].tobytes()] = min(first.get(data[r["at"] + i : r["at"] + i + n].tobytes(), (9, 0)), (int(r["key"]), int(r["off"]) + i))
    for r in rows:
        want += [(int(r["key"]), int(r["off"]) + i) > first[data[r["at"] + i : r["at"] + i + n].tobytes()] for i in range(9)]
    assert got.tolist() == want and any(want) and not all(want)


def test_a_transducer_goes_with_its_query(spark):
    """Workers outlive a query, and its tables of words must not stay in them for the next one."""
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string").repartition(16)
    assert pieces.encode(docs, tokenizer_path("piece_bpe_32k.model")).where("round_trip").count() == 64

    def held(batches):
        import gc
        import time

        time.sleep(0.05)  # so that each worker gets a task
        for batch in batches:
            n = sum(type(x).__name__ == "Transducer" for x in gc.get_objects())
            yield pa.RecordBatch.from_arrays([pa.array([n] * batch.num_rows, pa.int64())], ["n"])

    assert spark.range(0, 64, 1, 64).mapInArrow(held, "n long").agg({"n": "max"}).first()[0] == 0


def test_batches_go_by_slices():
    """All rows in their order, whatever their sizes; a batch of 40 MB never as a whole."""
    batch = pa.RecordBatch.from_pydict({"i": list(range(10_000)), "text": ["x" * 4_000] * 10_000})
    got = list(memory.slices([batch, batch.slice(0, 0), batch.slice(9_990)]))
    assert [x for b in got for x in b.column(0).to_pylist()] == [*range(10_000), *range(9_990, 10_000)]
    assert max(b.nbytes for b in got) <= memory.SLICE_BYTES + 10_000
    one = pa.RecordBatch.from_pydict({"i": [0, 1], "text": ["x" * (memory.SLICE_BYTES * 3), None]})  # a row larger than a slice
    assert [b.num_rows for b in memory.slices([one])] == [1, 1]
