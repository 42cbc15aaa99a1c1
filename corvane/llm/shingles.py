"""Sets of word shingles of many texts at once, as sorted 64-bit hashes, by array operations over their bytes."""

from __future__ import annotations

import numpy as np

#: Bytes hashed at once. A word's hash doesn't depend on where the bytes are cut.
CHUNK = 1 << 18
A, B, C = (np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * C
    return x ^ (x >> np.uint64(29))


#: A value for each byte, the same for a letter of A-Z and its small form, and powers of B with their inverses modulo 2^64.
VALUE = mix(mix((np.arange(256, dtype=np.uint64) + np.uint64(1)) * A) + B)
VALUE[65:91] = VALUE[97:123]
_powers: list[np.ndarray] = []


def powers() -> tuple[np.ndarray, np.ndarray]:
    if not _powers:
        for base in (int(B), pow(int(B), -1, 1 << 64)):
            p = np.full(CHUNK, np.uint64(base))
            p[0] = 1
            _powers.append(np.multiply.accumulate(p))
    return _powers[0], _powers[1]


def word_hashes(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word of the texts in `data`, in order, and how many words each text has. `ends`: 0, then where each text ends."""
    solid = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[ends] = True
    first, last = solid.copy(), solid.copy()
    first[1:] &= ~solid[:-1] | edge[1:-1]
    last[:-1] &= ~solid[1:] | edge[1:-1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    up, down = powers()
    total = np.zeros(len(start), np.uint64)
    for lo in range(0, len(data), CHUNK):
        hi = min(len(data), lo + CHUNK)
        i, j = np.searchsorted(end, lo, "right"), np.searchsorted(start, hi, "left")  # words with a byte in [lo, hi)
        if i < j:
            run = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(VALUE[data[lo:hi]] * up[: hi - lo], out=run[1:])
            a, b = np.maximum(start[i:j], lo), np.minimum(end[i:j], hi)
            part = (run[b - lo] - run[a - lo]) * down[a - lo]  # sum of value * B^(place in the chunk's part of the word)
            for k in np.flatnonzero(start[i:j] < lo):  # one word at most goes on from the chunk before
                part[k : k + 1] *= np.uint64(pow(int(B), int(lo - start[i + k]), 1 << 64))
            total[i:j] += part
    n = np.diff(np.searchsorted(start, ends))
    return mix(mix(total ^ ((end - start).astype(np.uint64) * A)) + B), n


def shingle_sets(data: np.ndarray, ends: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The sorted distinct hashes of the k-word shingles of each text, one text's after the other's, and 0 with where each text's end.
    Words are runs of bytes other than ASCII white space, A-Z lower-cased; fewer than k of them are one shingle."""
    h, n = word_hashes(data, ends)
    at = np.concatenate([[0], np.cumsum(n)])
    if not len(h):
        return np.zeros(0, np.uint64), np.zeros(len(n) + 1, np.int64)
    width = np.minimum(n, k)
    out = np.full(len(h), np.uint64(k))
    for j in range(min(k, len(h))):
        out[: len(h) - j] = out[: len(h) - j] * A + h[j:]
    for i in np.flatnonzero((n > 0) & (n < k)).tolist():
        x = np.uint64(width[i])
        with np.errstate(over="ignore"):
            for w in h[at[i] : at[i + 1]]:
                x = x * A + w
        out[at[i]] = x
    count = np.where(n > 0, n - width + 1, 0)
    keep = np.arange(len(h)) - np.repeat(at[:-1], n) < np.repeat(count, n)
    return distinct(mix(out[keep]), np.concatenate([[0], np.cumsum(count)]))


def distinct(x: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each segment sorted and without repeats; and the new ends."""
    for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
        x[a:b].sort()
    keep = np.ones(len(x), bool)
    keep[1:] = x[1:] != x[:-1]
    keep[ends[:-1][ends[:-1] < len(x)]] = True
    # an empty segment's start is that of the next one, which is kept anyway
    return x[keep], np.concatenate([[0], np.cumsum(keep)])[ends]
