"""Quick paths against plain definitions."""

import re
import time

import numpy as np
import pyarrow as pa
import pytest

from panelforge.llm import decontaminate, flat, language_model, suffix_dedup
from panelforge.llm.buckets import Bucket

ITEM = "the quick brown fox jumps over the lazy dog while seven wizards mix a very odd potion"


def _edits(item, text, centre, half):
    """Fewest edits of the item against a stretch of the text on the diagonals of a band, by a plain table."""
    far, best = 10**6, {}
    for d in range(centre - half, centre + half + 1):
        best[0, d] = 0 if 0 <= d <= len(text) else far
    for i in range(1, len(item) + 1):
        for d in range(centre - half, centre + half + 1):
            j = d + i
            if not 0 <= j <= len(text):
                best[i, d] = far
                continue
            same = j > 0 and item[i - 1] == text[j - 1]
            best[i, d] = min(best[i - 1, d] + (not same), best.get((i - 1, d + 1), far) + 1, best.get((i, d - 1), far) + 1)
    return min(best[len(item), d] for d in range(centre - half, centre + half + 1))


def test_banded_and_verbatim_against_a_plain_table():
    draw = np.random.default_rng(5)
    for k in range(300):
        item = draw.integers(97, 100, int(draw.integers(2, 12))).astype(np.uint8)
        text = draw.integers(97, 100, int(draw.integers(0, 30))).astype(np.uint8 if k % 2 else np.uint32)
        centre, half = int(draw.integers(-8, 30)), int(draw.integers(0, 6))
        want, budget = _edits(item, text, centre, half), 2
        got, whole = decontaminate.banded(item, text, centre, half, budget), decontaminate.verbatim(item, text, centre, half)
        assert (got[0] if got else want > budget) == (want if got else True)
        assert whole == (got if want == 0 else None)


def test_an_item_word_for_word_needs_no_alignment(monkeypatch):
    def refuse(*_):
        raise AssertionError("aligned")

    monkeypatch.setattr(decontaminate, "banded", refuse)
    got = decontaminate.Items([(7, ITEM)]).find([f"Before that, {ITEM}! And more.", "nothing of it"])
    assert got == [(0, 7, 12, 12 + len(ITEM), 0, int(len(ITEM) * decontaminate.RATE))]


@pytest.mark.parametrize("text", ["", " ", "A_b  C\t\nd", "x\x1cy\x00z\x7f", "né É_中 文", *(f"q{chr(i)}r" for i in range(128))])
def test_normalise(text):
    assert decontaminate.normalise(text) == re.sub(" {2,}", " ", re.sub(r"[^\w ]|_", " ", text.lower())).strip()


@pytest.mark.parametrize("n, w", [(5, 9), (100, 100), (70_000, 1), (65_541, 81), (98_304, 64), (40_000, 33_000)])
def test_leftmost_least_by_high_bits(n, w):
    values = np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64)
    values[::3] = values[0]
    values[1::7] = values[0] + np.uint64(1)  # the same high bits
    assert flat.sliding_argmin_high(values, w).tolist() == flat.sliding_argmin(values >> np.uint64(16), w).tolist()


def test_gram_hashes_by_pieces(monkeypatch):
    data = np.random.default_rng(2).integers(0, 256, 3 * flat.PIECE + 5).astype(np.uint8)
    got = flat.gram_hashes(data, 20)
    monkeypatch.setattr(flat, "PIECE", 1 << 40)
    assert (got == flat.gram_hashes(data, 20)).all()


def _segments(texts, n, q):
    bucket = Bucket(pa.table({"doc_id": list(range(len(texts))), "text": texts}))
    rows = suffix_dedup._segments(bucket, n, q)
    return bucket, rows, rows["at"].astype(np.int64)


@pytest.mark.parametrize("n, q", [(10, 3), (11, 4), (12, 12), (9, 1)])
def test_late_windows_against_a_dictionary(n, q):
    draw = np.random.default_rng(n * q)
    for _ in range(40):
        stock = ["".join(draw.choice(list("abc"), int(draw.integers(3, 30)))) for _ in range(6)]
        texts = ["".join(stock[i] for i in draw.integers(0, 6, int(draw.integers(0, 5)))) for _ in range(12)]
        bucket, rows, place = _segments(texts, n, q)
        if not len(rows):
            continue
        seen, want = {}, []
        for key, off in sorted((int(r["key"]), int(r["off"]) + i) for r in rows for i in range(r["windows"])):
            seen.setdefault(texts[key][off : off + n], (key, off))
        for r in rows:
            want += [seen[texts[r["key"]][o : o + n]] != (r["key"], o) for o in range(int(r["off"]), int(r["off"]) + int(r["windows"]))]
        late = suffix_dedup._late(rows, place, bucket.data, n, q)
        assert late.tolist() == want
        stay, whose = suffix_dedup._cut(rows, late, False)
        moved = stay["off"].astype(np.int64) - rows["off"][whose]
        assert not suffix_dedup._late(stay, place[whose] + moved, bucket.data, n, q).any()


def test_segments_that_share_an_anchor_alone_need_no_suffix_array(monkeypatch):
    def refuse(*_):
        raise AssertionError("sorted")

    letters = np.random.default_rng(4)
    own = ["".join(letters.choice(list("abcdefghij"), 200)) for _ in range(4)]
    same = "".join(letters.choice(list("abcdefghij"), 59))  # shorter than a half with its anchor
    bucket, rows, place = _segments([own[0] + same + own[1], own[2] + same + own[3]], 100, 20)
    assert len(np.unique(rows["h"])) < len(rows)
    monkeypatch.setattr(suffix_dedup, "suffix_array", refuse)
    assert not suffix_dedup._late(rows, place, bucket.data, 100, 20).any()


@pytest.mark.parametrize("n", [0, 1, 255, 256, 257, 8_192, 8_200])
def test_products_by_tiles(n):
    z = np.random.default_rng(n).random((n, language_model.WIDTH), np.float32)
    for m in (language_model._ONE, language_model._UPPER):
        assert np.allclose(language_model._times(z, m), z @ m, rtol=1e-5)


def test_products_stay_in_the_calling_thread():
    """Threads of the library spin against those of other tasks, so a task takes up several times its own work."""
    z = np.random.default_rng(1).random((language_model.BATCH, language_model.WIDTH), np.float32)
    at = np.full(len(z), 3, np.float32)
    language_model._drawn(z, at)
    time.sleep(1)  # threads of tests before come to rest
    own, every = time.thread_time(), time.process_time()
    for _ in range(300):
        language_model._drawn(z, at)
    time.sleep(1)  # threads of tests before come to rest
    own, every = time.thread_time() - own, time.process_time() - every
    assert every < 1.3 * own + 0.02
