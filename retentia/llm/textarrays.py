"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A block is (buf, offs): the concatenated bytes and the row offsets. Words never
cross rows. Hashes are 64-bit polynomial hashes over random byte values; they
stand for the strings they were made from (the chance that any two of 10^8
different strings collide is below 0.001).
"""

from __future__ import annotations

import numpy as np

_rng = np.random.Generator(np.random.PCG64(20240229))
BYTE_VALUE = _rng.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INV = np.uint64(pow(int(BASE), -1, 2**64))
MIX = [np.uint64(x) for x in (0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53)]

SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A word byte of ``[^\x20\x09-\x0D]+``.
WORD = ~SPACE
#: Byte values with A-Z read as a-z.
_lower = np.arange(256)
_lower[0x41:0x5B] += 32
LOWER_VALUE = BYTE_VALUE[_lower]

_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i for i < n, mod 2**64; kept for the next block."""
    if len(_powers[0]) < n:
        n2 = 1 << (n - 1).bit_length()
        for k, base in enumerate((BASE, BASE_INV)):
            p = np.full(n2, base, np.uint64)
            p[0] = 1
            _powers[k] = np.multiply.accumulate(p)
    return _powers[0][:n], _powers[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * MIX[2]
    return h ^ (h >> np.uint64(29))


def word_spans(buf: np.ndarray, offs: np.ndarray, inside: np.ndarray = WORD) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and for each row the index of its first word (one more entry than rows)."""
    m = inside[buf]
    n = len(buf)
    if not n:
        z = np.empty(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    first = np.zeros(n + 1, bool)
    first[offs] = True
    prev = np.empty(n, bool)
    prev[0], prev[1:] = False, m[:-1]
    starts = np.flatnonzero(m & (~prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1], nxt[:-1] = False, m[1:]
    ends = np.flatnonzero(m & (~nxt | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offs)


def span_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, value: np.ndarray = BYTE_VALUE) -> np.ndarray:
    """64-bit hash of each span; equal bytes give equal hashes wherever they stand."""
    p, inv = powers(len(buf) + 1)
    total = np.zeros(len(buf) + 1, np.uint64)
    np.cumsum(value[buf] * p[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * inv[starts])


def pair_hash(a: np.ndarray, b: np.ndarray, level: int = 0) -> np.ndarray:
    """Hash of an ordered pair of hashes."""
    return mix(a * MIX[0] + b * BASE + MIX[1] + np.uint64(level))


def row_of(first: np.ndarray, n: int) -> np.ndarray:
    """Row number of each of ``n`` items, from the first item of each row."""
    return np.repeat(np.arange(len(first) - 1), np.diff(np.append(first[:-1], n)))


def ngram_hashes(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word windows that stay in their row, and their start words."""
    if len(h) < n:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    if n == 3:
        g = pair_hash(pair_hash(h[:-2], h[1:-1]), h[2:], 3)
    elif n & n - 1:  # word by word
        g = h[:len(h) - n + 1]
        for k in range(1, n):
            g = pair_hash(g, h[k:len(h) - n + 1 + k], 64 + k)
    else:
        g, k = h, 1
        while k < n:
            g = pair_hash(g[:-k], g[k:], k)
            k *= 2
    row = row_of(first, len(h))
    at = np.flatnonzero(row[:len(g)] == row[n - 1:])
    return g[at], at
