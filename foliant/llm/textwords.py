"""Words of many texts as numpy arrays: boundaries and 64-bit hashes without a loop over words."""

from __future__ import annotations

import numpy as np

_BASE = 0x9E3779B97F4A7C15
#: Masks of the lowest 0 to 8 bytes.
_BELOW = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)

#: ASCII white space: 0x20 and 0x09-0x0D.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
#: A-Z to a-z, every other byte unchanged.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    return np.cumprod(out, dtype=np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser: every input bit reaches every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bounds(raw: np.ndarray, space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Start and end (exclusive) of the runs of bytes that are not in ``space``."""
    inside = np.zeros(len(raw) + 2, np.int8)
    inside[1:-1] = ~space[raw]
    step = np.diff(inside)
    return np.flatnonzero(step == 1), np.flatnonzero(step == -1)


def range_hashes(raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of each byte range; equal ranges have equal hashes wherever they stand.

    Eight bytes at a time are mixed into the state by a bijection that is not linear, so that ranges
    that differ in a regular way do not meet as they would under a polynomial.
    """
    size = (end - start).astype(np.int64)
    out = mix(size.astype(np.uint64) + np.uint64(_BASE))
    padded = np.zeros(len(raw) + 8, np.uint8)
    padded[: len(raw)] = raw
    eight = np.ndarray((len(raw) + 1,), "<u8", padded, strides=(1,))
    at, left, rows = start.astype(np.int64), size, np.arange(len(start))
    while True:
        some = left > 0
        if not some.all():
            at, left, rows = at[some], left[some], rows[some]
        if not len(rows):
            return out
        part = eight[at]
        part &= _BELOW[np.minimum(left, 8)]
        out[rows] = mix(out[rows] ^ part)
        at, left = at + 8, left - 8


class Words:
    """Words of a list of texts. ``doc`` is each word's text number, ``hash`` its 64-bit hash."""

    def __init__(self, texts: list[str], lower: bool = False, space: np.ndarray = SPACE) -> None:
        data = [t.encode("utf-8", "surrogatepass") for t in texts]
        self.raw = np.frombuffer(b" ".join(data) + b" ", np.uint8)
        if lower:
            self.raw = LOWER[self.raw]
        sizes = np.fromiter((len(x) + 1 for x in data), np.int64, len(data))
        self.origin = np.cumsum(sizes) - sizes
        self.start, self.end = bounds(self.raw, space)
        self.doc = np.searchsorted(self.origin, self.start, side="right") - 1
        self.count = np.bincount(self.doc, minlength=len(texts)) if len(texts) else np.zeros(0, np.int64)
        self.first = np.cumsum(self.count) - self.count
        self.hash = range_hashes(self.raw, self.start, self.end)


def pieces(texts: list[str], limit: int = 2 << 20):
    """Cut a list of texts into slices of about ``limit`` characters: (from, to) pairs."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if size and size + len(t) > limit:
            yield at, i
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)
