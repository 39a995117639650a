"""Largest eigenpairs of a symmetric matrix by contour integration (FEAST).

The matrix is reduced to tridiagonal form once; the signs of its pivots at a
shift count the eigenvalues above it (Sylvester's law of inertia). Counts cut the
spectrum into intervals of few eigenvalues. In each, a block of vectors is
filtered by the resolvent integrated around the interval, that is by a sum of
complex shifted solves, and Rayleigh-Ritz takes the pairs out of the filtered
block, until residuals are at rounding level and the interval holds as many
Ritz values as were counted. A last Rayleigh-Ritz step over all of them makes
the vectors of neighbouring intervals orthogonal.
"""

import numpy as np

#: Quadrature points on the half circle above an interval.
NODES = 8
#: Eigenvalues an interval may hold, where it can be cut further.
MOST = 12
_EPS = np.finfo(float).eps


def tridiagonal(matrix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Diagonal and off-diagonal of an orthogonally similar matrix."""
    a = np.array(matrix, float)
    for k in range(len(a) - 2):
        v = a[k + 1 :, k].copy()
        length = np.linalg.norm(v)
        if length == 0:
            continue
        v[0] += np.copysign(length, v[0])
        v /= np.linalg.norm(v)
        block = a[k + 1 :, k:]
        block -= 2 * np.outer(v, v @ block)
        block = a[k:, k + 1 :]
        block -= 2 * np.outer(block @ v, v)
    return np.diag(a).copy(), np.diag(a, -1).copy()


def count_above(diagonal: np.ndarray, off: np.ndarray, shift: float) -> int:
    """How many eigenvalues exceed the shift: positive pivots."""
    least = _EPS * max(1e-300, np.abs(diagonal).max(initial=0) + np.abs(off).max(initial=0)) * _EPS
    found, pivot = 0, 1.0
    squares = np.concatenate(([0.0], off * off))
    for d, b in zip((diagonal - shift).tolist(), squares.tolist()):
        pivot = d - b / pivot
        if abs(pivot) < least:
            pivot = -least
        found += pivot > 0
    return found


def _cut(low: float, high: float, above) -> list[tuple[float, float, int]]:
    """Intervals (low, high, eigenvalues), highest first; cuts lie in gaps."""
    held = above(low) - above(high)
    if held <= MOST or high - low <= 1e-9 * abs(high):
        return [(low, high, held)] if held else []
    width = high - low
    for place in (0.5, 0.45, 0.55, 0.4, 0.6, 0.35, 0.65, 0.3, 0.7):
        at = low + place * width
        if above(at - 1e-6 * width) == above(at + 1e-6 * width):
            return _cut(at, high, above) + _cut(low, at, above)
    return [(low, high, held)]


def _ritz(matrix: np.ndarray, block: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    basis = np.linalg.qr(block)[0]
    values, turn = np.linalg.eigh(basis.T @ matrix @ basis)
    return values, basis @ turn


def _filtered(matrix: np.ndarray, block: np.ndarray, low: float, high: float) -> np.ndarray:
    """The block after the quadrature of the resolvent around (low, high)."""
    places, weights = np.polynomial.legendre.leggauss(NODES)
    middle, radius = (low + high) / 2, (high - low) / 2
    out = np.zeros_like(block)
    for t, w in zip(places, weights):
        turn = radius * np.exp(0.5j * np.pi * (1 - t))
        solved = np.linalg.solve((middle + turn) * np.eye(len(matrix)) - matrix, block.astype(complex))
        out += w / 2 * (turn * solved).real
    return out


def _interval(matrix: np.ndarray, low: float, high: float, held: int) -> np.ndarray:
    """The eigenvectors of one interval."""
    size, scale = len(matrix), np.abs(matrix).sum(axis=1).max()
    tolerance = 4 * size * _EPS * scale
    random = np.random.default_rng(size)
    width = min(size, held + max(4, held // 2))
    block = random.standard_normal((size, width))
    best, last = None, np.inf
    for turn in range(40):
        if turn == 20:  # values crowd around the interval: take the whole space
            block = np.eye(size)
        else:
            block = _filtered(matrix, block, low, high)
        values, block = _ritz(matrix, block)
        inside = (values > low) & (values <= high)
        if inside.sum() == held:
            found = block[:, inside]
            error = np.linalg.norm(matrix @ found - found * values[inside], axis=0).max()
            if error < last:
                best, last = found, error
            if error <= tolerance:
                return found
        elif turn > 20:
            break
    if best is None or last > 1e-9 * scale:
        raise ArithmeticError(f"{held} eigenvalues are counted in ({low}, {high}], but not all were found")
    return best


def largest(matrix: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Up to ``most`` eigenvalues, falling, and unit eigenvectors as columns. Those
    at rounding level are left out; so a matrix of zeros has none."""
    size = len(matrix)
    unit = np.abs(matrix).sum(axis=1).max(initial=0)
    if not unit:
        return np.zeros(0), np.zeros((size, 0))
    matrix = matrix / unit  # so that squares neither vanish nor overflow
    scale = np.abs(matrix).sum(axis=1).max()
    diagonal, off = tridiagonal(matrix)
    memo: dict[float, int] = {}

    def above(shift: float) -> int:
        if shift not in memo:
            memo[shift] = count_above(diagonal, off, shift)
        return memo[shift]

    floor, high = 8 * size * _EPS * scale, 1.01 * scale
    low = floor
    if above(floor) > most:
        top = high  # the highest bound above which there are enough, to a part in a million
        while top - low > 1e-6 * top:
            middle = (low + top) / 2
            low, top = (middle, top) if above(middle) >= most else (low, middle)
        while low > floor and above(low * (1 - 1e-6)) != above(low * (1 + 1e-6)):
            low = max(floor, low * (1 - 1e-5))  # into a gap
    parts = [_interval(matrix, *part) for part in _cut(low, high, above)]
    if not parts:
        return np.zeros(0), np.zeros((size, 0))
    values, vectors = _ritz(matrix, np.hstack(parts))
    counted = above(low)
    if len(values) != counted:
        raise ArithmeticError(f"{counted} eigenvalues are counted, {len(values)} were found")
    order = np.argsort(-values, kind="stable")[:most]
    return values[order] * unit, vectors[:, order]
