"""Simple-8b word-aligned coding of unsigned integers, encoded and decoded in numpy.

A 64-bit word is a 4-bit selector and 60 bits of payload; the selector says how
many values of how many bits the payload holds. A value of more than 60 bits is
an *escape*: a word of selector 0 stands for it, and the value itself follows in
the block's escape area. Values are coded in blocks of ``BLOCK``; a stream keeps
the place of each block's first word and first escape, so any block is decoded on
its own, all its words at once.

Stream layout, little-endian: ``b"S8B1"``, uint32 values per block, uint64 number
of values, uint32 first word of each block and the total, uint32 first escape of
each block and the total, the words, the escapes.
"""

from __future__ import annotations

import numpy as np

# Values per word and their bits, by selector; selector 0 is the escape.
COUNT = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1], np.int64)
WIDTH = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60], np.int64)

MAGIC = b"S8B1"
BLOCK = 1024
ESCAPE = 0
_LIMITS = np.uint64(1) << WIDTH[1:].astype(np.uint64)
_SMALL = np.searchsorted(_LIMITS, np.arange(1 << 16, dtype=np.uint64), "right").astype(np.uint8)
_PAYLOAD = np.uint64((1 << 60) - 1)


def _choices(narrow: np.ndarray) -> np.ndarray:
    """Selector of a word that starts at each place: the one with most values that all fit.

    ``narrow`` holds the smallest selector class (an index into WIDTH[1:]) of each value. The widest
    class among the next c values comes from two overlapping windows of the count before c.
    """
    keep = narrow.shape[1] - int(COUNT.max())
    # where many values fit few bits, fewer values fit more: the feasible selectors are the last ones
    feasible = np.zeros((len(narrow), keep), np.int8)
    widest, held = narrow, 1
    for s in range(len(COUNT) - 1, 0, -1):
        step = int(COUNT[s]) - held
        if step:
            widest, held = np.maximum(widest[:, :-step], widest[:, step:]), int(COUNT[s])
        feasible += widest[:, :keep] < s
    return np.where(feasible, len(COUNT) - feasible, ESCAPE)


def _classes(values: np.ndarray) -> np.ndarray:
    if len(values) and values.max() < len(_SMALL):
        return _SMALL[values.astype(np.int64)]
    return np.searchsorted(_LIMITS, values.ravel(), "right").astype(np.uint8).reshape(values.shape)


def encode(values: np.ndarray, block: int = BLOCK) -> bytes:
    """The stream of ``values`` (unsigned 64-bit)."""
    values = np.ascontiguousarray(values, np.uint64)
    n, pad = len(values), int(COUNT.max())
    rows = -(-n // block)
    lengths = np.full(rows, block, np.int64)
    if rows:
        lengths[-1] = n - (rows - 1) * block
    table = np.zeros((rows, block + pad), np.uint64)  # behind a block's end any value fits
    full = np.zeros(rows * block, np.uint64)
    full[:n] = values
    table[:, :block] = full.reshape(rows, block)
    chosen = _choices(_classes(table))
    # one word of every block per step
    starts = np.zeros((rows, block), bool)
    lane, at = np.arange(rows), np.zeros(rows, np.int64)
    while len(lane):
        starts[lane, at] = True
        at = at + COUNT[chosen[lane, at]]
        more = at < lengths[lane]
        lane, at = lane[more], at[more]
    row, place = np.nonzero(starts)
    selector = chosen[row, place].astype(np.int64)
    words = selector.astype(np.uint64) << np.uint64(60)
    flat, first = table.ravel(), row * (block + pad) + place
    for s in range(1, len(COUNT)):
        which = np.flatnonzero(selector == s)
        if len(which):
            shifts = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64)
            parts = flat[first[which, None] + np.arange(COUNT[s])] << shifts
            words[which] |= np.bitwise_or.reduce(parts, axis=1)
    escaped = selector == ESCAPE
    at_word = np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype("<u4")
    at_escape = np.append(0, np.cumsum(np.bincount(row[escaped], minlength=rows))).astype("<u4")
    return b"".join([MAGIC, np.uint32(block).astype("<u4").tobytes(), np.uint64(n).astype("<u8").tobytes(), at_word.tobytes(),
                     at_escape.tobytes(), words.astype("<u8").tobytes(), flat[first[escaped]].astype("<u8").tobytes()])


def size(stream: bytes) -> int:
    """Number of values of a stream."""
    return int(np.frombuffer(stream, "<u8", 1, 8)[0])


def decode(stream: bytes, first: int = 0, count: int | None = None) -> np.ndarray:
    """Values first .. first + count - 1 of a stream; only the blocks that hold them are decoded."""
    if stream[:4] != MAGIC:
        raise ValueError("not a Simple-8b stream")
    block, n = int(np.frombuffer(stream, "<u4", 1, 4)[0]), size(stream)
    count = n - first if count is None else count
    if first < 0 or count < 0 or first + count > n:
        raise IndexError(f"values {first} to {first + count} of {n}")
    if not count:
        return np.empty(0, np.uint64)
    rows, head = -(-n // block), 16
    at_word = np.frombuffer(stream, "<u4", rows + 1, head).astype(np.int64)
    at_escape = np.frombuffer(stream, "<u4", rows + 1, head + 4 * (rows + 1)).astype(np.int64)
    body = head + 8 * (rows + 1)
    b0, b1 = first // block, -(-(first + count) // block)
    words = np.frombuffer(stream, "<u8", int(at_word[b1] - at_word[b0]), body + 8 * int(at_word[b0]))
    escapes = np.frombuffer(stream, "<u8", int(at_escape[b1] - at_escape[b0]), body + 8 * int(at_word[-1] + at_escape[b0]))
    selector = (words >> np.uint64(60)).astype(np.int64)
    counts = COUNT[selector]
    row = np.repeat(np.arange(b1 - b0), np.diff(at_word[b0:b1 + 1]))
    before = np.cumsum(counts) - counts
    place = before - before[at_word[b0:b1] - at_word[b0]][row]
    wide = block + int(COUNT.max())  # the last word of a block may hold more values than are left
    out = np.zeros((b1 - b0) * wide, np.uint64)
    target = row * wide + place
    payload = words & _PAYLOAD
    for s in range(1, len(COUNT)):
        which = np.flatnonzero(selector == s)
        if len(which):
            shifts = (np.arange(COUNT[s]) * WIDTH[s]).astype(np.uint64)
            mask = np.uint64((1 << int(WIDTH[s])) - 1)
            out[target[which, None] + np.arange(COUNT[s])] = payload[which, None] >> shifts & mask
    out[target[selector == ESCAPE]] = escapes
    return out.reshape(-1, wide)[:, :block].ravel()[first - b0 * block:first - b0 * block + count]
