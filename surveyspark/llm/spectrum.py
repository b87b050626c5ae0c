"""Leading eigenpairs of a dense symmetric matrix by spectrum slicing.

The number of eigenvalues above a shift is the number of positive pivots of the LDL-transposed factors of the shifted
matrix (Sylvester's law of inertia). Bisection on these counts puts each leading eigenvalue into an interval of its
own, Rayleigh quotient iteration refines it there, and two more counts, just below and just above the result, certify
its number. The matrix is as wide as a vector is long, whatever the number of rows behind it.
"""

from __future__ import annotations

import numpy as np

ALPHA = (1 + 17**0.5) / 8  # bounds the growth of the factors under complete pivoting


def inertia(a: np.ndarray, shift: float) -> tuple[int, int, int]:
    """Numbers of eigenvalues of ``a`` above, at and below the shift, by factors with pivots of one or two rows."""
    m = np.array(a, float)
    m[np.diag_indices(len(m))] -= shift
    above = at = below = 0
    while n := len(m):
        diagonal = np.abs(np.diag(m))
        k = int(diagonal.argmax())
        r, c = divmod(int(np.abs(m - np.diag(np.diag(m))).argmax()), n)
        off = abs(m[r, c]) if n > 1 else 0.0
        if diagonal[k] == 0 and off == 0:
            at += n
            break
        if diagonal[k] >= ALPHA * off:
            pivot, rest = m[k, k], np.delete(np.arange(n), k)
            above, below = above + (pivot > 0), below + (pivot < 0)
            column = m[rest, k]
            m = m[np.ix_(rest, rest)] - np.outer(column, column / pivot)
        else:  # a pair of rows whose block has one eigenvalue of each sign
            above, below = above + 1, below + 1
            rest = np.delete(np.arange(n), [r, c])
            block, columns = m[np.ix_([r, c], [r, c])], m[np.ix_(rest, [r, c])]
            m = m[np.ix_(rest, rest)] - columns @ np.linalg.solve(block, columns.T)
        m = (m + m.T) / 2
    return above, at, below


def _intervals(a: np.ndarray, k: int, low: float, high: float, floor: float) -> list[tuple[float, float, int, int]]:
    """(low, high, first, last): eigenvalues number first..last (from 1, falling) lie between; as few as can be told apart."""
    above = {low: inertia(a, low)[0], high: 0}
    todo, out = [(low, high)], []
    while todo:
        lo, hi = todo.pop()
        first, last = above[hi] + 1, above[lo]
        if first > last or first > k:
            continue
        middle = (lo + hi) / 2
        if (first == last and hi - lo < 0.1 * abs(hi)) or hi - lo <= floor or not lo < middle < hi:
            out.append((lo, hi, first, last))
            continue
        above[middle] = inertia(a, middle)[0]
        todo += [(lo, middle), (middle, hi)]
    return sorted(out, key=lambda x: x[2])


def _solve(a: np.ndarray, shift: float, v: np.ndarray, nudge: float) -> np.ndarray:
    eye = np.eye(len(a))
    while True:
        try:
            y = np.linalg.solve(a - shift * eye, v)
            if np.isfinite(y).all():
                return y / np.linalg.norm(y)
        except np.linalg.LinAlgError:
            pass
        shift, nudge = shift + nudge, 2 * nudge


def _refine(a: np.ndarray, lo: float, hi: float, found: list[np.ndarray], start: np.ndarray, scale: float) -> tuple[float, np.ndarray]:
    """The eigenpair of the interval that is orthogonal to those found in it before."""
    eps = np.finfo(float).eps

    def free(v):
        for _ in range(2):
            for u in found:
                v = v - (u @ v) * u
        return v / np.linalg.norm(v)

    above = inertia(a, hi)[0]
    single = inertia(a, lo)[0] - above == 1
    while True:
        shift = (lo + hi) / 2
        v = free(_solve(a, shift, free(start), eps * scale))
        v = free(_solve(a, shift, v, eps * scale))
        for _ in range(12):
            rho = float(v @ a @ v)
            if not lo <= rho <= hi:
                break
            residual = np.linalg.norm(a @ v - rho * v)
            if residual <= 4 * eps * scale:
                break
            v = free(_solve(a, rho, v, eps * scale))
        rho = float(v @ a @ v)
        inside = lo - 8 * eps * scale <= rho <= hi + 8 * eps * scale
        if inside or hi - lo <= 8 * eps * scale or not lo < shift < hi:
            v = free(_solve(a, rho, v, eps * scale))  # one more step: the vector at full precision
            return float(v @ a @ v), v
        if single and inertia(a, shift)[0] - above == 1:
            lo = shift
        elif single:
            hi = shift
        else:
            start = free(start[::-1] + v)


def leading(a: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The at most ``k`` largest eigenvalues of a positive semidefinite matrix and their unit vectors, as columns.

    Eigenvalues that are zero within rounding are left out, so fewer than ``k`` may come back. Equal eigenvalues give
    an orthonormal basis of their space. Raises ArithmeticError if the counts contradict the numbering.
    """
    d = len(a)
    scale = float(np.abs(a).sum(1).max()) if d else 0.0  # no eigenvalue is larger
    if not scale:
        return np.zeros(0), np.zeros((d, 0))
    eps = np.finfo(float).eps
    zero = 4 * d * eps * scale
    start = np.random.default_rng(1).standard_normal(d)
    values: list[float] = []
    vectors: list[np.ndarray] = []
    for lo, hi, first, last in _intervals(a, k, zero, scale * (1 + 4 * eps) + zero, 64 * eps * scale):
        group: list[tuple[float, np.ndarray]] = []
        for i in range(first, last + 1):
            # Neighbours that nearly share an eigenvalue are kept orthogonal to what is known of them.
            near = [u for e, u in zip(values, vectors) if abs(e - hi) < 1e-3 * scale] + [u for _, u in group]
            group.append(_refine(a, lo, hi, near, np.roll(start, i), scale))
        group.sort(key=lambda x: -x[0])
        for i, (e, u) in zip(range(first, last + 1), group):
            slack = max(64 * d * eps * scale, hi - lo if last > first else 0.0)
            if inertia(a, e + slack)[0] >= first or inertia(a, e - slack)[0] < i:
                raise ArithmeticError(f"eigenvalue {i} is not where the counts put it")
            values.append(e)
            vectors.append(u)
    n = min(k, len(values))
    return np.array(values[:n]), np.stack(vectors[:n], axis=1) if n else np.zeros((d, 0))
