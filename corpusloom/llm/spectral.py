"""Spectral divide and conquer of a symmetric matrix by polar decompositions (QDWH).

The polar factor of A - shift * I has the eigenvalue 1 for each eigenvalue of A above the shift and -1 for each below, so half of
its sum with I projects on the upper ones. Bases of both ranges split A into two smaller problems, until blocks of
one are left. The polar factor comes from Halley's iteration with dynamic weights, which needs six steps at most in double precision.

A shift at the mean of a block's diagonal always has eigenvalues on both sides, unless all are equal; where it meets an eigenvalue, the
iteration stands still and another shift is taken. Equal eigenvalues share an invariant subspace; any basis of it is right.
The work is on one matrix as wide as the vectors, whatever their number.
"""

from __future__ import annotations

import numpy as np

_EPS = np.finfo(float).eps


def polar(a: np.ndarray, steps: int = 40) -> np.ndarray | None:
    """The symmetric orthogonal polar factor of a symmetric matrix; null where it is singular to working precision."""
    n = len(a)
    eye = np.eye(n)
    size = np.linalg.norm(a, "fro")
    if not size:
        return None
    x = a / size
    # a lower bound of the smallest singular value, from the norm of the inverse
    try:
        low = 1 / (np.linalg.norm(np.linalg.inv(x), "fro"))
    except np.linalg.LinAlgError:
        return None
    if not np.isfinite(low) or low < 4 * n * _EPS:
        return None
    low = min(low, 1.0)
    for _ in range(steps):
        # weights of Halley's iteration that fit the interval [low, 1]
        d = np.cbrt(4 * (1 - low**2) / low**4)
        root = np.sqrt(1 + d)
        wa = root + 0.5 * np.sqrt(max(0.0, 8 - 4 * d + 8 * (2 - low**2) / (low**2 * root)))
        wb = (wa - 1) ** 2 / 4
        wc = wa + wb - 1
        # by QR while the weights are large, which is stable whatever the condition; by Cholesky's normal matrix then
        if wc > 100:
            q, _ = np.linalg.qr(np.vstack([np.sqrt(wc) * x, eye]))
            new = wb / wc * x + (wa - wb / wc) / np.sqrt(wc) * q[:n] @ q[n:].T
        else:
            new = wb / wc * x + (wa - wb / wc) * np.linalg.solve(eye + wc * (x.T @ x), x.T).T
        low = min(1.0, low * (wa + wb * low**2) / (1 + wc * low**2))
        new = (new + new.T) / 2
        moved, x = np.linalg.norm(new - x, "fro"), new
        if moved < np.cbrt(4 * _EPS) and abs(1 - low) < 1e-8:  # it converges with the third power
            break
    return x if np.linalg.norm(x @ x - eye, "fro") < 1e-10 * max(1, n) else None


def _halves(a: np.ndarray, draw: np.random.Generator) -> tuple[np.ndarray, int] | None:
    """An orthogonal matrix whose first columns span the upper invariant subspace of a block, and their number; null for a multiple of the identity."""
    n = len(a)
    middle = np.trace(a) / n
    spread = np.linalg.norm(a - middle * np.eye(n), "fro") / np.sqrt(n)
    best = None
    for step in (0, 0.05, -0.05, 0.13, -0.13, 0.29, -0.29, 0.41, -0.41, 0.003, -0.003):
        u = polar(a - (middle + step * spread) * np.eye(n))
        if u is None:
            continue
        upper = (u + np.eye(n)) / 2
        rank = int(round(np.trace(upper)))
        if not 0 < rank < n:
            continue
        q = draw.standard_normal((n, n))
        for _ in range(2):
            q = np.hstack([upper @ q[:, :rank], q[:, rank:] - upper @ q[:, rank:]])
            q, _ = np.linalg.qr(q)
        off = np.linalg.norm(q[:, rank:].T @ a @ q[:, :rank], "fro")
        if best is None or off < best[0]:
            best = off, q, rank
        if off <= 20 * n * _EPS * max(np.linalg.norm(a, "fro"), _EPS):
            break
    return best and best[1:]


def eigen(a: np.ndarray, wanted: int, floor: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of a symmetric matrix, falling, and their unit eigenvectors as columns.

    wanted: how many at least where there are; lower halves are split only as far as that needs. floor: spreads below count as none.
    """
    a = (a + a.T) / 2
    n = len(a)
    floor = max(floor, 2 * n * _EPS * (np.linalg.norm(a, "fro") if n else 0))
    draw = np.random.default_rng(1)
    values, vectors = [], []
    todo = [np.eye(n)] if n else []
    while todo and len(values) < wanted:
        basis = todo.pop()  # of the uppermost block that is left
        block = basis.T @ a @ basis
        block = (block + block.T) / 2
        k = len(block)
        middle = np.trace(block) / k
        halves = None
        if k > 1 and np.linalg.norm(block - middle * np.eye(k), "fro") > floor:
            halves = _halves(block, draw)
        if halves is None:  # one, or equal ones
            for j in range(k):
                values.append(float(basis[:, j] @ a @ basis[:, j]))
                vectors.append(basis[:, j])
            continue
        q, rank = halves
        todo += [basis @ q[:, rank:], basis @ q[:, :rank]]
    order = np.argsort([-v for v in values], kind="stable")
    vectors = np.array([vectors[i] for i in order]).T if len(order) else np.zeros((n, 0))
    for j in range(vectors.shape[1]):  # the largest entry is positive, so that reruns agree
        vectors[:, j] *= np.sign(vectors[np.argmax(np.abs(vectors[:, j])), j]) / np.linalg.norm(vectors[:, j])
    return np.array([values[i] for i in order]), vectors
