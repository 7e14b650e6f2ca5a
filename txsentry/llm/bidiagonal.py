"""Right singular vectors of one small matrix by a bidiagonal qd solver.

Householder reflections turn a d x d matrix R into an upper bidiagonal B;
dqds (differential qd with shifts) finds the singular values of B to high
relative accuracy; a twisted factorisation of ``B'B - s^2`` gives each right
singular vector of B from two half recurrences that meet where the pivot is
least.  Vectors of values that agree to ``CLUSTER`` of their size are made
orthogonal to each other, with steps of inverse iteration through the same
factorisation where little is left.  The matrix's size is that of the vectors,
never that of the data.
"""

from __future__ import annotations

import math

import numpy as np

EPS = np.finfo(np.float64).eps
CLUSTER = 1e-3


def bidiagonalise(r: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a, b, V): diagonal and superdiagonal of U' r V; U is not kept."""
    a = np.array(r, np.float64)
    d = a.shape[1]
    v = np.eye(d)

    def reflector(x):
        """Unit u so that x - 2 u (u'x) has zeros behind its first entry."""
        norm = np.linalg.norm(x)
        if norm == 0 or not x[1:].any():
            return None
        u = x / norm
        u[0] += math.copysign(1.0, u[0])
        return u / np.linalg.norm(u)

    for k in range(d):
        u = reflector(a[k:, k].copy())
        if u is not None:
            a[k:, k:] -= 2 * np.outer(u, u @ a[k:, k:])
        if k < d - 2:
            u = reflector(a[k, k + 1:].copy())
            if u is not None:
                a[:, k + 1:] -= 2 * np.outer(a[:, k + 1:] @ u, u)
                v[:, k + 1:] -= 2 * np.outer(v[:, k + 1:] @ u, u)
    return np.diag(a).copy(), np.diag(a, 1).copy(), v


def dqds(q: list[float], e: list[float]) -> list[float]:
    """Squared singular values of the bidiagonal with squared entries q, e, falling."""
    q, e, found = list(q), list(e), []
    shift = 0.0            # of the matrix now held against the given one
    for _ in range(200 * len(q) + 200):
        n = len(q)
        if 1.5 * q[0] < q[-1]:      # read from the other end it converges faster
            q.reverse()
            e.reverse()
        if n == 1:
            found.append(q[0] + shift)
            break
        # A negligible e splits off what lies below it.
        cut = next((k for k in range(n - 2, -1, -1) if e[k] <= EPS * EPS * (shift + q[k + 1]) or e[k] <= EPS * EPS * q[k]), None)
        if cut == n - 2:
            found.append(q.pop() + shift)
            e.pop()
            continue
        if cut is not None:
            found += [x + shift for x in dqds(q[cut + 1:], e[cut + 1:])]
            del q[cut + 1:], e[cut:]
            continue
        # The least eigenvalue of the trailing 2 x 2 block, less a margin, as shift.
        x, y, z = q[-2] + (e[-2] if n > 2 else 0.0), math.sqrt(q[-2] * e[-1]), q[-1] + e[-1]
        low = (x + z) / 2 - math.hypot((x - z) / 2, y)
        tau = max(0.0, min(low, q[-1])) * (1 - 1e-3)
        for tau in (tau, tau / 4, 0.0):
            step = _dqds_step(q, e, tau)
            if step:
                (q, e), shift = step, shift + tau
                break
    else:
        raise ArithmeticError("the qd steps did not converge")
    return sorted(found, reverse=True)


def _dqds_step(q: list[float], e: list[float], tau: float) -> tuple[list[float], list[float]] | None:
    """One transform to the bidiagonal of the matrix less ``tau``; None if tau is too large."""
    n, d = len(q), q[0] - tau
    p, f = [0.0] * n, [0.0] * (n - 1)
    for k in range(n - 1):
        if d < 0:
            return None
        p[k] = d + e[k]
        if p[k] == 0.0:
            f[k], d = 0.0, q[k + 1] - tau
            continue
        t = q[k + 1] / p[k]
        f[k] = e[k] * t
        d = d * t - tau
    if d < 0:
        return None
    p[-1] = d
    return p, f


def _twisted(q: np.ndarray, e: np.ndarray, lam: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Pivots and multipliers of both half factorisations of B'B - lam, and gamma.

    B'B = L D L' with D = q and L's multipliers l, l*l*q = e.  Forward:
    L+ D+ L+'; backward: U- D- U-'.
    """
    n = len(q)
    tiny = np.finfo(float).tiny / EPS
    l = [math.sqrt(e[k] / q[k]) for k in range(n - 1)]
    plus, lp = [0.0] * n, [0.0] * (n - 1)
    s = -lam
    fwd = [s] + [0.0] * (n - 1)
    for k in range(n - 1):
        plus[k] = (q[k] + s) or tiny
        lp[k] = q[k] * l[k] / plus[k]
        s = lp[k] * l[k] * s - lam
        fwd[k + 1] = s
    plus[-1] = (q[-1] + s) or tiny
    minus, um = [0.0] * n, [0.0] * (n - 1)
    p = q[-1] - lam
    back = [0.0] * (n - 1) + [p]
    for k in range(n - 2, -1, -1):
        t = e[k] + p
        minus[k + 1] = t or tiny
        um[k] = q[k] * l[k] / minus[k + 1]
        p = p * (q[k] / minus[k + 1]) - lam
        back[k] = p
    minus[0] = p or tiny
    gamma = np.array([fwd[k] + back[k] + lam for k in range(n)])
    return np.array(plus), np.array(lp), np.array(minus), np.array(um), gamma


def _vector(lp: np.ndarray, um: np.ndarray, r: int) -> np.ndarray:
    n = len(lp) + 1
    z = np.zeros(n)
    z[r] = 1.0
    for k in range(r - 1, -1, -1):
        z[k] = -lp[k] * z[k + 1]
        if not math.isfinite(z[k]):
            z[k] = 0.0
    for k in range(r, n - 1):
        z[k + 1] = -um[k] * z[k]
        if not math.isfinite(z[k + 1]):
            z[k + 1] = 0.0
    return z / np.linalg.norm(z)


def _solve(parts: tuple, r: int, rhs: np.ndarray) -> np.ndarray:
    """(B'B - lam) y = rhs by the twisted factorisation with its twist at r."""
    plus, lp, minus, um, gamma = parts
    n = len(rhs)
    y = rhs.copy()
    for k in range(r):
        y[k + 1] -= lp[k] * y[k]
    for k in range(n - 2, r - 1, -1):
        y[k] -= um[k] * y[k + 1]
    g = gamma[r] or EPS * np.abs(gamma).max() or 1.0
    d = np.concatenate((plus[:r], [g], minus[r + 1:]))
    y = y / d
    for k in range(r - 1, -1, -1):
        y[k] -= lp[k] * y[k + 1]
    for k in range(r, n - 1):
        y[k + 1] -= um[k] * y[k]
    return y


def _block(q: np.ndarray, e: np.ndarray) -> tuple[list[float], list[np.ndarray]]:
    """Eigenvalues (falling) and vectors of B'B for one unreduced block."""
    if len(q) == 1:
        return [float(q[0])], [np.ones(1)]
    values = dqds(q.tolist(), e.tolist())
    main = q + np.concatenate(([0.0], e))
    side = np.sqrt(q[:-1] * e)
    size = float(main.max())

    def residual(w, lam):
        t = main * w - lam * w
        t[:-1] += side * w[1:]
        t[1:] += side * w[:-1]
        return float(np.abs(t).max())

    def apart(z, near):
        w = z.copy()
        for _ in range(2):
            for x in near:
                w -= x * (x @ w)
        left = float(np.linalg.norm(w))
        return (w / left if left > 0 else w), left

    rng = np.random.default_rng(11)
    vectors: list[np.ndarray] = []
    for i, lam in enumerate(values):
        near = [vectors[j] for j in range(i) if values[j] - lam <= CLUSTER * values[j]]
        parts = _twisted(q, e, lam)
        order = np.argsort(np.abs(parts[-1]))
        best, worth = None, math.inf
        # Twists at other places give other vectors of a cluster; the first one
        # that is new and has a small residual is taken.
        for r in order[:len(q) if near else 1].tolist():
            w, left = apart(_vector(parts[1], parts[3], r), near)
            if left < 0.1 and near:
                continue
            miss = residual(w, lam)
            if miss < worth:
                best, worth = w, miss
            if worth <= 32 * EPS * size:
                break
        for k in range(6 if worth > 1e-12 * size and near else 0):
            # Inverse iteration from a random start, the value moved by a few units of rounding.
            at = lam * (1 + (2 * k - 5) * EPS)
            shifted = _twisted(q, e, at)
            w = rng.standard_normal(len(q))
            for _ in range(3):
                w = apart(w, near)[0]
                with np.errstate(all="ignore"):
                    w = _solve(shifted, int(np.argmin(np.abs(shifted[-1]))), w)
                norm = np.linalg.norm(w)
                w = w / norm if math.isfinite(norm) and norm > 0 else rng.standard_normal(len(q))
            w, left = apart(w, near)
            if left > 1e-3 and (miss := residual(w, lam)) < worth:
                best, worth = w, miss
        if best is None:
            raise ArithmeticError("no vector found for a singular value")
        vectors.append(best)
    return values, vectors


def right_vectors(r: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared singular values of ``r``, falling; right singular vectors as rows)."""
    d = r.shape[1]
    scale = float(np.abs(r).max()) if r.size else 0.0
    if scale == 0:
        return np.zeros(d), np.eye(d)
    a, b, v = bidiagonalise(r / scale)
    # Zeros on the diagonal (fewer directions than dimensions) are put at the
    # rounding level of the matrix, so that every block has its factorisation.
    floor = EPS * max(np.abs(a).max(), np.abs(b).max() if len(b) else 0.0)
    sign = np.where(a < 0, -1.0, 1.0)
    a = np.maximum(np.abs(a), floor)
    # D1 B D2 with signs D makes both diagonals non-negative: column k takes
    # the sign that turns b[k - 1], row k the one that turns a[k].
    col, row = np.ones(d), np.ones(d)
    for k in range(d):
        row[k] = sign[k] * col[k]
        if k < d - 1:
            col[k + 1] = row[k] * (-1.0 if b[k] < 0 else 1.0)
    b = np.abs(b)
    b[b <= 8 * EPS * np.minimum(a[:-1], a[1:])] = 0.0
    out = []
    start = 0
    for end in [*(np.flatnonzero(b == 0) + 1).tolist(), d]:
        q, e = a[start:end] ** 2, b[start:end - 1] ** 2
        for lam, z in zip(*_block(q, e)):
            full = np.zeros(d)
            full[start:end] = z
            out.append((lam, v @ (col * full)))
        start = end
    out.sort(key=lambda x: -x[0])
    return np.array([x[0] for x in out]) * scale * scale, np.array([x[1] for x in out])
