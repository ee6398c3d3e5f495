"""Removal of repeated word windows, with a count-min prefilter before exact grouping.

A window is ``k`` consecutive words of one document.  Passes over bucketed documents:

1. every bucket counts its windows in a count-min sketch of several rows and sends each shard of the cell space its
   part; shards add the partition sketches up and answer which cells count two or more.  A cell never counts less than
   any of its windows, so no repeated window is lost.  Widths follow the size of the input (shards times cells);
2. windows whose cells count two or more in every row, and only they, are grouped exactly by a 128-bit BLAKE2 digest of
   their words: first inside the bucket, then the bucket's first of each kind up a tree of groups in the shard of its
   digest, where the smallest doc_id wins;
3. buckets cover the words of windows that lost and hash what is left.

Defined cases: null and empty texts have no words; ``kept_sha256`` is then that of the empty string.  Rows with the
same doc_id never count as earlier than each other (only a smaller doc_id does); nor do rows without one, which come
after all others.  Other columns of the input are ignored.  An empty table gives an empty result.  Rows equal in both
doc_id and text share a bucket.
"""

from __future__ import annotations

import hashlib
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import buckets as B
from . import flat

WINDOW = 13
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def _words(bucket: B.Bucket, a: int, z: int, at: int, data: np.ndarray):
    """Words of a run of documents; a word never crosses from one document to the next."""
    start, end = flat.words(data)
    cuts = bucket.offset[a + 1 : z] - at
    inside = np.searchsorted(start, cuts, "left") - 1  # the word that begins before each cut
    split = np.flatnonzero((inside >= 0) & (cuts > start[np.maximum(inside, 0)]) & (cuts < end[np.maximum(inside, 0)])) if len(start) else np.zeros(0, np.int64)
    if len(split):
        extra = np.unique(cuts[split])
        start, end = np.sort(np.concatenate((start, extra))), np.sort(np.concatenate((end, extra)))
    doc = np.searchsorted(bucket.offset[a : z + 1] - at, start, "right") - 1 + a
    return start, end, doc


def _windows(bucket: B.Bucket, k: int):
    """Runs of a bucket: bytes, words, and of each window its hash, first word and document."""
    before = 0
    for a, z, at, data in bucket.runs():
        start, end, doc = _words(bucket, a, z, at, data)
        n = len(start) - k + 1
        if n > 0:
            whole = np.flatnonzero(doc[:n] == doc[k - 1 :])
            hashes = flat.window_hashes(flat.word_hashes(data, start, end, flat.CODES_A, flat.BASE_A), k, flat.BASE_B)[whole]
            yield data, start, end, hashes, whole, before, doc[whole]
        before += len(start)


def _digests(data: np.ndarray, start: np.ndarray, end: np.ndarray, windows: np.ndarray, k: int) -> np.ndarray:
    """A 128-bit BLAKE2 digest of each window's words, joined by single spaces."""
    space = flat.IS_SPACE[data]
    keep = ~space
    keep[1:] |= ~space[:-1]  # a word's bytes and the separator after it
    line = np.where(space, np.uint8(32), data)[keep].tobytes()
    at = np.cumsum(keep)
    a, z = (at[start[windows]] - 1).tolist(), at[end[windows + k - 1] - 1].tolist()
    return np.frombuffer(b"".join([blake2b(line[x:y], digest_size=16).digest() for x, y in zip(a, z)]), np.uint64).reshape(-1, 2)


def _groups(digest: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Group equal digests.  Returns for each row whether its rank is above its group's least, an order of the rows by group and rank, and where groups begin in it."""
    order = np.lexsort((rank, digest[:, 1], digest[:, 0]))
    d, r = digest[order], rank[order]
    new = np.ones(len(order), bool)
    new[1:] = (d[1:] != d[:-1]).any(axis=1)
    least = r[np.flatnonzero(new)][np.cumsum(new) - 1] if len(r) else r
    late = np.zeros(len(order), bool)
    late[order] = r > least
    return late, order, new


_ENTRY = [np.dtype([("d", "<u8", 2), ("key", t), ("at", "<u4")]) for t in ("<u4", "<i8")]


def _pack(b: int, shards: int, rows: np.ndarray) -> list:
    """A bucket's windows, dealt to shards; narrow rows where keys allow."""
    kind = int(len(rows) and not (0 <= rows["key"].min() and rows["key"].max() < 1 << 32))
    shard = ((rows["d"][:, 0] >> np.uint64(34)) % np.uint64(shards)).astype(np.int64)
    order = np.argsort(shard, kind="stable")
    rows, shard = rows[order].astype(_ENTRY[kind]), shard[order]
    edge = np.flatnonzero(np.diff(shard, prepend=-1)).tolist() + [len(shard)]
    return [(int(shard[x]), b, kind, rows[x:y].tobytes()) for x, y in zip(edge, edge[1:])]


#: Kinds of messages: windows in narrow and wide rows; to a bucket itself, runs of late windows and pairs of a window and one that shares its fate; late windows.
RUNS, PAIRS, LATE = 2, 3, 4


def remove_repeats(docs: DataFrame, k: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = B.BUCKET_BYTES, with_text: bool = False, fan: int = B.FAN) -> DataFrame:
    """Remove each word covered by a ``k``-word window that also starts in a document with a smaller id.

    Returns doc_id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), and that text itself as
    ``text`` if asked for.
    """
    n = B.bucket_count(docs, bucket_bytes, text_col)
    shards = max(32, n // 4)
    dealt = B.bucketed(docs, n, id_col, text_col)

    def sketch(b: int, bucket: B.Bucket) -> list:
        hashes = [w[3] for w in _windows(bucket, k)]
        return B.sketch_messages(b, np.concatenate(hashes), shards) if hashes else []

    def group(b: int, bucket: B.Bucket, told: list) -> list:
        runs = list(_windows(bucket, k))
        if not runs:
            return []
        again = B.suspects(np.concatenate([r[3] for r in runs]), shards, told)
        edge = np.cumsum([0, *(len(r[3]) for r in runs)])
        rows = []
        for (data, start, end, _, window, before, doc), x, y in zip(runs, edge, edge[1:]):
            mine = np.flatnonzero(again[x:y])
            got = np.empty(len(mine), _ENTRY[1])
            got["d"], got["key"], got["at"] = _digests(data, start, end, window[mine], k), bucket.key[doc[mine]], window[mine] + before
            rows.append(got)
        rows = np.concatenate(rows)
        late, order, new = _groups(rows["d"], rows["key"])
        first = order[new]
        out = _pack(b, shards, rows[first])
        if late.any():
            out.append((b % shards, b, RUNS, np.concatenate(flat.spans(np.bincount(rows["at"][late]) > 0)).astype(np.uint32).tobytes()))
        tied = order[~new & ~late[order]]
        if len(tied):  # rows of one doc_id: as their first
            head = first[np.cumsum(new) - 1]
            whose = np.empty(len(rows), np.int64)
            whose[order] = head
            out.append((b % shards, b, PAIRS, np.stack([rows["at"][whose[tied]], rows["at"][tied]]).tobytes()))
        return out

    def settle(s: int, told: list, root: bool) -> list:
        out = [(s, b, kind, body) for _, b, kind, body in told if kind > 1]
        parts = [(b, np.frombuffer(body, _ENTRY[kind])) for _, b, kind, body in told if kind < 2]
        if not parts:
            return out
        rows = np.concatenate([p.astype(_ENTRY[1]) for _, p in parts])
        home = np.repeat([b for b, _ in parts], [len(p) for _, p in parts])
        late, _, _ = _groups(rows["d"], rows["key"])
        by = np.argsort(home, kind="stable")
        edge = np.flatnonzero(np.diff(home[by], prepend=-1)).tolist() + [len(by)]
        for x, y in zip(edge, edge[1:]):
            mine = by[x:y]
            b, lost = int(home[mine[0]]), mine[late[mine]]
            if len(lost):
                out.append((s, b, LATE, rows["at"][lost].tobytes()))
            if not root:
                out += [(s, *m[1:]) for m in _pack(b, 1, rows[mine[~late[mine]]])]
        return out

    def last(bucket: B.Bucket, told: list) -> pa.Table:
        lost, pairs = [np.zeros(0, np.int64)], []
        for _, _, kind, body in told:
            x = np.frombuffer(body, np.uint32).astype(np.int64)
            if kind == RUNS:
                a, z = np.split(x, 2)
                lost.append(np.repeat(a - np.concatenate(([0], np.cumsum(z - a)[:-1])), z - a) + np.arange((z - a).sum()))
            elif kind == PAIRS:
                pairs.append(x.reshape(2, -1))
            elif kind == LATE:
                lost.append(x)
        lost = np.sort(np.concatenate(lost))
        for head, tied in pairs:
            lost = np.sort(np.concatenate((lost, tied[np.isin(head, lost)])))
        n_words, n_removed, sha, texts, before = [], [], [], [], 0
        for a, z, at, data in bucket.runs():
            start, end, doc = _words(bucket, a, z, at, data)
            mine = lost[np.searchsorted(lost, before) : np.searchsorted(lost, before + len(start))] - before
            gone = flat.covered(mine, k, len(start))
            before += len(start)
            keep = np.flatnonzero(~gone)
            count = np.bincount(doc - a, minlength=z - a)
            left = np.bincount(doc[keep] - a, minlength=z - a)
            n_words += count.tolist()
            n_removed += (count - left).tolist()
            raw, ks, ke = data.tobytes(), start[keep].tolist(), end[keep].tolist()
            edge = np.concatenate(([0], np.cumsum(left))).tolist()
            for x, y in zip(edge, edge[1:]):
                kept = b" ".join([raw[p:q] for p, q in zip(ks[x:y], ke[x:y])])
                sha.append(hashlib.sha256(kept).hexdigest())
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
        cols = {"doc_id": bucket.ids.cast(pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_removed": pa.array(n_removed, pa.int64()), "kept_sha256": pa.array(sha, pa.string())}
        return pa.table(cols | ({"text": pa.array(texts, pa.string())} if with_text else {}))

    often = B.answer(B.ask(dealt, sketch), B.merge_sketches)
    lost = B.climb(B.ask(dealt, group, often), n, settle, fan)
    return B.finish(dealt, lost, last, SCHEMA + (", text string" if with_text else ""))
