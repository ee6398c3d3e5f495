"""Removal of repeated byte strings by sharded suffix arrays.

Removed is each byte covered by an ``n``-byte string of a document that also starts earlier: in a document with a
smaller id, or earlier in the same one.  Passes over bucketed documents (see buckets.py):

1. anchors: the leftmost least q-gram hash of each n-byte window.  Equal windows have equal anchors at equal places, so a
   window whose anchor counts once in the whole corpus occurs once; shards count anchors in a sketch that never
   underestimates;
2. segments: the windows of one anchor's place, for anchors that count two or more.  A bucket sends them to the shard of
   their anchor, the bytes of equal ones once;
3. shards build suffix arrays by induced sorting (suffix_array.py), up a tree of groups, so that no group hears an anchor
   from more than a bounded number of buckets, and of segments that share neither half around the anchor with another
   none: places of neighbours whose permuted common prefix is ``n`` or more hold the
   same window, and the earliest stays;
4. buckets cover the bytes of the windows that lost and hash the rest.

Every removed window comes out of a suffix array: anchors only say which segments need one, and segments with the same
bytes are one entry of its text with all their places, so that a thousand copies are sorted once.

Defined cases: null and empty texts have no bytes and no spans.  Rows that share a doc_id count as one document: earlier
is the smaller start, and windows alike in both share their fate.  So do rows without a doc_id, which come last.  Extra
columns are ignored; an empty table gives an empty result.  Rows equal in both doc_id and text share a bucket.
"""

from __future__ import annotations

import hashlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import buckets as B
from . import flat
from .suffix_array import permuted_lcp, suffix_array

U64 = np.uint64
LENGTH, GRAM = 100, 20
#: Bytes in one suffix array; more only where one anchor has more.
ARRAY_BYTES = 1 << 21
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
#: Segments whose windows are looked up at once.
PIECE = 1 << 12
#: A segment: its anchor, the document's id, its start in the document and in the bucket, its windows, and its anchor's place in it.
_SEGMENT = np.dtype([("h", "<u8"), ("key", "<i8"), ("off", "<u4"), ("at", "<u4"), ("windows", "<u4"), ("inner", "<u4")])
#: Kinds of messages: segments with their bytes, and windows that lost (starts and lengths of runs).
BYTES, LOST = 0, 1


def _segments(bucket: B.Bucket, n: int, q: int) -> np.ndarray:
    out = [np.zeros(0, _SEGMENT)]
    for a, z, at, data in bucket.runs():
        if len(data) < n:
            continue
        grams = flat.gram_hashes(data, q)
        least = flat.sliding_argmin_high(grams, n - q + 1)
        offset = bucket.offset[a : z + 1] - at
        doc = np.repeat(np.arange(z - a), np.diff(offset))[: len(least)]
        inside = np.arange(len(least)) + n <= offset[doc + 1]
        new = np.ones(len(least), bool)
        new[1:] = (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])
        first = np.flatnonzero(new & inside)
        edge = np.flatnonzero(new)
        # windows of one anchor: up to the next anchor or the last window inside the document
        end = np.append(edge[1:], len(least))[np.searchsorted(edge, first)]
        end = np.minimum(end, offset[doc[first] + 1] - n + 1)
        rows = np.empty(len(first), _SEGMENT)
        rows["h"], rows["key"], rows["off"], rows["at"], rows["windows"], rows["inner"] = grams[least[first]], bucket.key[doc[first] + a], first - offset[doc[first]], first + at, end - first, least[first] - first
        out.append(rows)
    return np.concatenate(out)


def _ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """start[0], start[0] + 1, ... for each run of ``count`` numbers."""
    return np.repeat(start - (np.cumsum(count) - count), count) + np.arange(count.sum())


def _kinds(rows: np.ndarray, place: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Segments with the same bytes are one kind.  Returns an order of the segments by anchor, kind and rank (document's id, start), where kinds begin in it, and where anchors do."""
    view, length = memoryview(data), rows["windows"].astype(np.int64) + n - 1
    digest = np.frombuffer(b"".join([blake2b(view[x:y], digest_size=16).digest() for x, y in zip(place.tolist(), (place + length).tolist())]), np.uint64).reshape(-1, 2)
    order = np.lexsort((rows["off"], rows["key"], digest[:, 1], digest[:, 0], rows["h"]))
    h, d = rows["h"][order], digest[order]
    anchor = np.ones(len(order), bool)
    anchor[1:] = h[1:] != h[:-1]
    kind = anchor.copy()
    kind[1:] |= (d[1:] != d[:-1]).any(axis=1)
    return order, kind, anchor


def _alone(rows: np.ndarray, place: np.ndarray, data: np.ndarray, n: int, q: int, order: np.ndarray, kind: np.ndarray) -> np.ndarray:
    """Segments none of whose windows occurs elsewhere among ``rows``.

    Equal windows have their anchor at the same place, and each holds the anchor with the half of the rest to its left or the
    half to its right.  So a kind of one segment, both of whose halves no other kind of the anchor has, shares no window.
    """
    lead = order[kind]
    copies = np.diff(np.append(np.flatnonzero(kind), len(order)))
    half, part = (n - q) // 2, rows[lead]
    inner, size = part["inner"].astype(np.int64), part["windows"].astype(np.int64) + n - 1
    power = flat.powers(flat.BASE_B, half + q)
    lone = copies == 1
    for begin in (inner - half, inner):
        there = (begin >= 0) & (begin + half + q <= size)
        at = place[lead[there]] + begin[there]
        with np.errstate(over="ignore"):
            value = flat.mix(part["h"][there] * flat.BASE_A)
            for i in range(half + q):
                value += flat.CODES_B[data[at + i]] * power[i]
        _, which, count = np.unique(value, return_inverse=True, return_counts=True)
        lone[np.flatnonzero(there)[count[which] > 1]] = False
    out = np.zeros(len(rows), bool)
    out[lead[lone]] = True
    return out


def _classes(part: np.ndarray, place: np.ndarray, data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The windows of the segments ``part`` in the order of their suffix array, and where a window begins that differs from the one before."""
    windows = part["windows"].astype(np.int64)
    length = windows + n - 1
    head = np.cumsum(length + 1) - length - 1
    text = np.full(int((length + 1).sum()), 255, np.uint8)
    inner = _ranges(head, length)
    text[inner] = data[_ranges(place, length)]
    t = np.zeros(len(text), np.uint16)
    t[inner] = text[inner].astype(np.uint16) + 1
    del inner
    sa = suffix_array(t, 257)
    lcp = permuted_lcp(text, sa)
    room = np.repeat((head + length).astype(np.int32), length + 1) - np.arange(len(t), dtype=np.int32)
    here = room[sa]
    alike = np.minimum(np.minimum(lcp[sa], here), np.concatenate(([0], here[:-1]))) >= n
    mine = np.flatnonzero(here >= n)  # suffixes that begin a window; suffixes without one lie between classes
    number = np.full(len(t), -1, np.int64)
    number[_ranges(head, windows)] = np.arange(windows.sum())
    return number[sa[mine]], ~alike[mine]


def _late(rows: np.ndarray, place: np.ndarray, data: np.ndarray, n: int, q: int) -> np.ndarray:
    """Of each window of the segments, in their order, whether an equal window starts earlier; ``place``: where a segment's bytes begin in ``data``.

    The suffix arrays hold each kind of segment once; a class of equal windows takes its earliest start from all
    segments of its kinds.
    """
    windows = rows["windows"].astype(np.int64)
    first = np.cumsum(windows) - windows
    late = np.zeros(int(windows.sum()), bool)
    h, count = np.unique(rows["h"], return_counts=True)
    many = np.flatnonzero(count[np.searchsorted(h, rows["h"])] > 1)  # an anchor met once cannot repeat
    if not len(many):
        return late
    own, place = rows[many], place[many]
    order, kind, anchor = _kinds(own, place, data, n)
    stay = ~_alone(own, place, data, n, q, order, kind)
    if not stay.any():
        return late
    if not stay.all():
        held = stay[order]
        order, kind = (np.cumsum(stay) - 1)[order[held]], kind[held]
        many, own, place = many[stay], own[stay], place[stay]
        h = own["h"][order]
        anchor = np.append(True, h[1:] != h[:-1])
    lead = order[kind]  # of each kind its earliest segment
    whose = np.empty(len(own), np.int64)
    whose[order] = np.cumsum(kind) - 1
    size = np.cumsum(own["windows"][lead] + np.int64(n))
    begin = np.append(np.flatnonzero(anchor[kind]), len(lead))  # kinds of an anchor
    end = np.concatenate(([0], size))[begin]  # bytes before each anchor, and in all
    width = own["windows"][lead].astype(np.int64)
    window = np.cumsum(width) - width  # windows of kinds, end to end
    key, start = np.zeros(int(width.sum()), np.int64), np.zeros(int(width.sum()), np.int64)
    a = 0
    while a < len(begin) - 1:
        z = max(a + 1, int(np.searchsorted(end, end[a] + ARRAY_BYTES, "right")) - 1)
        x, y = begin[a], begin[z]
        a = z
        part = own[lead[x:y]]
        which, new = _classes(part, place[lead[x:y]], data, n)
        k = np.repeat(part["key"], width[x:y])[which]
        at = (np.repeat(part["off"], width[x:y]).astype(np.int64) + _ranges(np.zeros(y - x, np.int64), width[x:y]))[which]
        opens = np.flatnonzero(new)
        least = np.minimum.reduceat(k, opens)
        group = np.cumsum(new) - 1
        soonest = np.minimum.reduceat(np.where(k == least[group], at, np.iinfo(np.int64).max), opens)
        key[window[x] + which], start[window[x] + which] = least[group], soonest[group]
    for x in range(0, len(many), PIECE):
        part, part_of = own[x : x + PIECE], many[x : x + PIECE]
        w = windows[part_of]
        at = _ranges(window[whose[x : x + PIECE]], w)
        mine, here = np.repeat(part["key"], w), _ranges(part["off"].astype(np.int64), w)
        late[_ranges(first[part_of], w)] = (mine > key[at]) | ((mine == key[at]) & (here > start[at]))
    return late


def _cut(rows: np.ndarray, late: np.ndarray, want: bool) -> tuple[np.ndarray, np.ndarray]:
    """Runs of windows that are late or not: as segments of their own, and the segment that each comes from."""
    windows = rows["windows"].astype(np.int64)
    seg = np.repeat(np.arange(len(rows)), windows)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(windows) - windows, windows)
    mine = late == want
    opens = mine.copy()
    opens[1:] &= ~mine[:-1] | (seg[1:] != seg[:-1])
    start = np.flatnonzero(opens)
    count = np.diff(np.append(start, len(seg))) if not len(start) else np.add.reduceat(mine & (seg == seg[start][np.cumsum(opens) - 1]), start, dtype=np.int64)
    out = rows[seg[start]].copy()
    out["off"] += off[start].astype(np.uint32)
    out["at"] += off[start].astype(np.uint32)
    out["inner"] -= off[start].astype(np.uint32)
    out["windows"] = count
    return out, seg[start]


def _lost(s: int, b: int, rows: np.ndarray, late: np.ndarray) -> list:
    runs, _ = _cut(rows, late, True)
    return [(s, b, LOST, np.stack([runs["at"], runs["windows"]]).astype(np.uint32).tobytes())] if len(runs) else []


def _bytes(b: int, rows: np.ndarray, place: np.ndarray, data: np.ndarray, n: int, shards: int | None, s: int = 0) -> list:
    """Segments to their shards (or all to one), the bytes of each kind once: number of segments, segments in the order of kinds, a mark where a kind begins, bytes."""
    if not len(rows):
        return []
    order, kind, _ = _kinds(rows, place, data, n)
    rows, place = rows[order], place[order]
    shard = ((rows["h"] >> U64(34)) % U64(shards)).astype(np.int64) if shards else np.full(len(rows), s)
    by = np.argsort(shard, kind="stable")  # kinds stay together: their anchors are equal
    rows, place, kind, shard = rows[by], place[by], kind[by], shard[by]
    length = (rows["windows"].astype(np.int64) + n - 1) * kind
    edge = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(rows)]
    # places are made a shard at a time: those of a whole bucket are eight times its segments' bytes
    return [(int(shard[x]), b, BYTES, np.uint32(y - x).tobytes() + rows[x:y].tobytes() + kind[x:y].tobytes() + data[_ranges(place[x:y][kind[x:y]], length[x:y][kind[x:y]])].tobytes()) for x, y in zip(edge, edge[1:])]


def remove_repeats(docs: DataFrame, n: int = LENGTH, q: int = GRAM, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = B.BUCKET_BYTES, with_text: bool = False, row_col: str | None = None, fan: int = B.FAN) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of each document, and the kept text (broken characters at cuts left out) and the row's name, as ``row``, if asked for."""
    count = B.bucket_count(docs, bucket_bytes, text_col)
    shards = max(32, count // 2)
    dealt = B.bucketed(docs, count, id_col, text_col, row_col)

    def anchors(b: int, bucket: B.Bucket) -> list:
        return B.sketch_messages(b, _segments(bucket, n, q)["h"], shards)

    def segments(b: int, bucket: B.Bucket, told: list) -> list:
        rows = _segments(bucket, n, q)
        rows = rows[B.suspects(rows["h"], shards, told)]
        return _bytes(b, rows, rows["at"].astype(np.int64), bucket.data, n, shards)

    def arrays(s: int, told: list, root: bool) -> list:
        out = [(s, b, LOST, body) for _, b, kind, body in told if kind == LOST]
        rows, home, place, data, total = [], [], [], [], 0
        for _, b, kind, body in told:
            if kind == BYTES:
                m = int(np.frombuffer(body, np.uint32, 1)[0])
                part = np.frombuffer(body, _SEGMENT, m, 4)
                kind = np.frombuffer(body, bool, m, 4 + part.nbytes)
                length = (part["windows"].astype(np.int64) + n - 1) * kind
                raw = np.frombuffer(body, np.uint8, offset=4 + part.nbytes + m)
                rows.append(part)
                home.append(np.full(m, b))
                place.append((np.cumsum(length) - length)[np.flatnonzero(kind)][np.cumsum(kind) - 1] + total)
                data.append(raw)
                total += len(raw)
        if not rows:
            return out
        rows, home, place, data = map(np.concatenate, (rows, home, place, data))
        late = _late(rows, place, data, n, q)
        edge = np.flatnonzero(np.diff(home, prepend=-1)).tolist() + [len(home)]
        window = np.concatenate(([0], np.cumsum(rows["windows"], dtype=np.int64)))
        for x, y in zip(edge, edge[1:]):
            b, mine = int(home[x]), late[window[x] : window[y]]
            out += _lost(s, b, rows[x:y], mine)
            if not root:
                stay, whose = _cut(rows[x:y], mine, False)
                moved = stay["off"].astype(np.int64) - rows["off"][x:y][whose]
                out += _bytes(b, stay, place[x:y][whose] + moved, data, n, None, s)
        return out

    def last(bucket: B.Bucket, told: list) -> pa.Table:
        edge = np.zeros(len(bucket.data) + n + 1, np.int32)
        for _, _, kind, body in told:
            if kind == LOST:
                at, w = np.frombuffer(body, np.uint32).reshape(2, -1).astype(np.int64)
                np.add.at(edge, at, 1)
                np.subtract.at(edge, at + w + n - 1, 1)
        gone = np.cumsum(edge, out=edge)[: len(bucket.data)] > 0
        del edge
        inner = bucket.offset[:-1]
        begins = gone.copy()
        begins[1:] &= ~gone[:-1]
        filled = inner[inner < len(gone)]
        begins[filled] = gone[filled]
        total = np.concatenate(([0], np.cumsum(gone, dtype=np.int64)))
        runs = np.concatenate(([0], np.cumsum(begins, dtype=np.int64)))
        lo, hi = bucket.offset[:-1], bucket.offset[1:]
        sha, texts = [], []
        for x, y, r in zip(lo.tolist(), hi.tolist(), (total[hi] - total[lo]).tolist()):
            kept = bucket.data[x:y].tobytes() if not r else b"" if r == y - x else bucket.data[x:y][~gone[x:y]].tobytes()
            sha.append(hashlib.sha256(kept).hexdigest())
            if with_text:
                texts.append(kept.decode("utf-8", "ignore" if r else "replace"))
        cols = {"doc_id": bucket.ids.cast(pa.int64()), "n_bytes": pa.array(hi - lo, pa.int64()), "n_removed": pa.array(total[hi] - total[lo], pa.int64()), "n_spans": pa.array(runs[hi] - runs[lo], pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"text": pa.array(texts, pa.string())} if with_text else {}) | ({"row": bucket.rows} if row_col else {}))

    often = B.answer(B.ask(dealt, anchors), B.merge_sketches)
    lost = B.climb(B.ask(dealt, segments, often), count, arrays, fan)
    return B.finish(dealt, lost, last, SCHEMA + (", text string" if with_text else "") + (f", row {dict(dealt.dtypes)['row']}" if row_col else ""))
