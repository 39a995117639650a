"""Fingerprints of byte windows and content-defined anchors, in numpy.

A window is ``WINDOW`` bytes long. Each window has one anchor: the position in
it whose gram of ``GRAM`` bytes hashes lowest, the leftmost on a tie. Equal
windows have their anchor at the same offset, so equal windows meet at anchors
with equal grams. The zone of an anchor is what its windows cover together.
"""

import numpy as np

WINDOW = 100
GRAM = 24
SPAN = WINDOW - GRAM + 1
_SLICE = 1 << 18
_ODD = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def _spread(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64 bits."""
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(base: int, count: int) -> np.ndarray:
    out = np.full(count, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Polynomial hashes modulo 2^64 of substrings, over random byte weights."""

    def __init__(self, view: int):
        self._base = _ODD[view]
        self._inverse = pow(self._base, -1, 1 << 64)
        self._weights = np.random.default_rng(1234 + view).integers(0, 1 << 64, 256, np.uint64)
        self._up = self._down = np.ones(1, np.uint64)

    def prefix(self, data: np.ndarray) -> np.ndarray:
        if len(self._up) <= len(data):
            self._up = _powers(self._base, len(data) + 1024)
            self._down = _powers(self._inverse, len(data) + 1024)
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self._weights[data] * self._up[: len(data)], out=out[1:])
        return out

    def between(self, prefix: np.ndarray, starts, ends) -> np.ndarray:
        return _spread((prefix[ends] - prefix[starts]) * self._down[starts])

    def grams(self, prefix: np.ndarray, length: int) -> np.ndarray:
        count = len(prefix) - length
        return _spread((prefix[length:] - prefix[:count]) * self._down[:count])


FIRST, SECOND = Rolling(0), Rolling(1)


def _leftmost_lowest(values: np.ndarray, width: int) -> np.ndarray:
    """Position of the lowest of each ``width`` neighbours, by doubling."""
    mask = np.uint64(_SLICE - 1)
    low = (values & ~mask) | np.arange(len(values), dtype=np.uint64)
    reach = 1
    while 2 * reach <= width:
        low = np.minimum(low[:-reach], low[reach:])
        reach *= 2
    if reach < width:
        low = np.minimum(low[: len(low) - (width - reach)], low[width - reach :])
    return (low & mask).astype(np.int64)


def anchors(data: np.ndarray) -> tuple[np.ndarray, ...]:
    """Anchors of one text: gram hash, zone hash, position of the first and
    the last window of each. A text shorter than a window has none."""
    none = np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(data) < WINDOW:
        return none
    parts = []
    step = _SLICE - WINDOW
    for at in range(0, len(data) - WINDOW + 1, step):
        piece = data[at : at + step + WINDOW - 1]
        prefix = FIRST.prefix(piece)
        grams = FIRST.grams(prefix, GRAM)
        places = _leftmost_lowest(grams, SPAN)
        edge = np.flatnonzero(np.diff(places)) + 1
        starts = np.concatenate(([0], edge))
        ends = np.concatenate((edge, [len(places)])) - 1
        gram = grams[places[starts]]
        offset = (places[starts] - starts).astype(np.uint64)
        zone = FIRST.between(prefix, starts, ends + WINDOW)
        parts.append((gram, _spread(zone + offset * np.uint64(_ODD[1])), starts + at, ends + at))
    return tuple(np.concatenate(x) for x in zip(*parts))


def windows(data: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """Two fingerprints of each window starting at first..last."""
    piece = data[first : last + WINDOW]
    return tuple(r.grams(r.prefix(piece), WINDOW) for r in (FIRST, SECOND))
