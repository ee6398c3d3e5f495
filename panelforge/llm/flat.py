"""Vectorised primitives over documents laid end to end in one byte buffer."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
#: Odd multipliers of the polynomial hashes (fixed values; any odd 64-bit numbers do).
BASE_A, BASE_B = U64(0x9E3779B97F4A7C15), U64(0xD6E8FEB86659FD93)
_GAMMA = 0x9E3779B97F4A7C15
#: Values worked on at once, so that what is between two steps stays in a core's cache.
PIECE = 1 << 15
#: ASCII space and 0x09 to 0x0D, the separators of words.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser, so that every bit of a polynomial hash counts."""
    x = x ^ (x >> U64(30))
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, 257, dtype=U64) * U64(_GAMMA) + U64(seed))


CODES_A, CODES_B = byte_codes(1), byte_codes(0x5851F42D4C957F2D)


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(max(n, 1), base, U64)
    out[0] = 1
    return np.multiply.accumulate(out)


def inverse(odd: np.uint64) -> np.uint64:
    return U64(pow(int(odd), -1, 1 << 64))


def gram_hashes(data: np.ndarray, q: int, codes: np.ndarray = CODES_A, base: np.uint64 = BASE_A) -> np.ndarray:
    """The hash of each of the ``len(data) - q + 1`` q-grams of bytes."""
    n = len(data) - q + 1
    if n <= 0:
        return np.zeros(0, U64)
    if n > 2 * PIECE > 4 * q:
        whole = np.empty(n, U64)
        for a in range(0, n, PIECE):
            whole[a : a + PIECE] = gram_hashes(data[a : a + PIECE + q - 1], q, codes, base)
        return whole
    with np.errstate(over="ignore"):
        c = codes[data]
        # doubling: hash of length 2k from two hashes of length k
        out, have, pw = None, 0, base
        block, size, bits = c, 1, q
        while bits:
            if bits & 1:
                if out is None:
                    out, have = block, size
                else:
                    keep = len(data) - have - size + 1
                    out = out[:keep] * U64(pow(int(base), size, 1 << 64)) + block[have : have + keep]
                    have += size
            bits >>= 1
            if bits:
                keep = len(block) - size
                block = block[:keep] * pw + block[size : size + keep]
                size *= 2
                pw = U64(pow(int(base), size, 1 << 64))
        return mix(out[:n].copy())


def sliding_argmin(values: np.ndarray, w: int) -> np.ndarray:
    """The index of the leftmost least value in each window of ``w`` values."""
    n = len(values) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    size = -(-len(values) // w) * w  # van Herk: least values of the prefixes and suffixes of blocks of w
    padded = np.full(size, np.iinfo(values.dtype).max, values.dtype)
    padded[: len(values)] = values
    blocks, at = padded.reshape(-1, w), np.arange(size).reshape(-1, w)
    left = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1]
    right = np.minimum.accumulate(blocks, axis=1)
    first = np.minimum.accumulate(np.where(blocks == left, at, size)[:, ::-1], axis=1)[:, ::-1].ravel()
    fresh = np.ones(blocks.shape, bool)
    fresh[:, 1:] = blocks[:, 1:] < right[:, :-1]
    last = np.maximum.accumulate(np.where(fresh, at, 0), axis=1).ravel()
    return np.where(left.ravel()[:n] <= right.ravel()[w - 1 : w - 1 + n], first[:n], last[w - 1 : w - 1 + n])


def sliding_argmin_high(values: np.ndarray, w: int) -> np.ndarray:
    """The index of the leftmost value that is least in its high 48 bits, in each window of ``w`` values."""
    n = len(values) - w + 1
    if n <= 0 or w > PIECE:
        return sliding_argmin(values >> U64(16), w)
    out = np.empty(n, np.int64)
    for a in range(0, n, PIECE):
        part = values[a : a + PIECE + w - 1]
        least = (part & U64(0xFFFFFFFFFFFF0000)) | np.arange(len(part), dtype=U64)  # the place below: ties go to the left
        size = 1
        while 2 * size <= w:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        if size < w:
            least = np.minimum(least[: size - w], least[w - size :])
        out[a : a + PIECE] = (least & U64(0xFFFF)).astype(np.int64) + a
    return out


def words(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each maximal run of bytes that are no separators."""
    solid = np.zeros(len(data) + 2, np.int8)
    solid[1:-1] = ~IS_SPACE[data]
    step = np.diff(solid)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def word_hashes(data: np.ndarray, start: np.ndarray, end: np.ndarray, codes: np.ndarray, base: np.uint64) -> np.ndarray:
    """The hash of each word, from prefix sums of a polynomial modulo 2**64."""
    if not len(start):
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, U64)
        np.add.accumulate(codes[data] * powers(base, len(data)), out=total[1:])
        back = powers(inverse(base), len(data) + 1)
        return mix((total[end] - total[start]) * back[start] + (end - start).astype(U64) * U64(_GAMMA))


def window_hashes(tokens: np.ndarray, k: int, base: np.uint64) -> np.ndarray:
    """The hash of each run of ``k`` consecutive tokens."""
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, U64)
    with np.errstate(over="ignore"):
        out = tokens[:n].copy()
        for i in range(1, k):
            out *= base
            out += tokens[i : i + n]
        return mix(out)


def order_of(keys: np.ndarray) -> np.ndarray:
    """A stable order of 64-bit keys.  One sort of packed values instead of an indirect sort: high bits of the key with the index below; keys alike in those bits are put right afterwards."""
    n = len(keys)
    if n < 2:
        return np.arange(n)
    bits = int(n - 1).bit_length()
    if int(keys.max()).bit_length() + bits <= 64:  # the whole key fits above the index
        return (np.sort(keys << U64(bits) | np.arange(n, dtype=U64)) & U64((1 << bits) - 1)).astype(np.int64)
    packed = np.sort((keys >> U64(bits) << U64(bits)) | np.arange(n, dtype=U64))
    order = (packed & U64((1 << bits) - 1)).astype(np.int64)
    high = packed >> U64(bits)
    got = keys[order]
    wrong = np.flatnonzero((high[1:] == high[:-1]) & (got[1:] != got[:-1]))
    if len(wrong):  # rare: sort each run of like high bits by the whole key
        edges = np.flatnonzero(np.concatenate(([True], high[1:] != high[:-1], [True])))
        for r in np.unique(np.searchsorted(edges, wrong, "right") - 1):
            a, b = edges[r], edges[r + 1]
            order[a:b] = order[a:b][np.argsort(keys[order[a:b]], kind="stable")]
    return order


def spans(mask: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of the maximal true runs of a mask."""
    step = np.diff(np.concatenate(([0], mask.astype(np.int8), [0])))
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def covered(starts: np.ndarray, length: int, n: int) -> np.ndarray:
    """Mask of the ``n`` places covered by runs of ``length`` from each start."""
    if not len(starts):
        return np.zeros(n, bool)
    edge = np.bincount(starts, minlength=n + length + 1).astype(np.int32)
    np.subtract.at(edge, starts + length, 1) if len(starts) < 64 else edge.__isub__(np.bincount(starts + length, minlength=len(edge)).astype(np.int32)[: len(edge)])
    return np.cumsum(edge)[:n] > 0
