"""Symmetric band matrices on the driver: what is left of a matrix of individuals by individuals once panels are turned.

A band is its diagonal blocks and those below them, as lists; a block below is an upper triangle, so the band is as wide as
a block. All that is held is some times the size by the width.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def panel(columns: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(v, t, r) of a panel's columns: I - v t v' turns r, filled up with rows of zeros, into them."""
    h, tau = np.linalg.qr(columns, mode="raw")
    h, k = h.T, len(tau)
    v = np.tril(h[:, :k], -1)
    v[np.arange(k), np.arange(k)] = 1
    inner, t = v.T @ v, np.zeros((k, k))
    for j in range(k):
        t[:j, j] = -tau[j] * (t[:j, :j] @ inner[:j, j])
        t[j, j] = tau[j]
    return v, t, np.triu(h[:k])


def times(diagonal: list[np.ndarray], below: list[np.ndarray], x: np.ndarray) -> np.ndarray:
    """A band's product with some vectors."""
    ends = np.cumsum([0, *map(len, diagonal)])
    parts = [x[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    out = [d @ p for d, p in zip(diagonal, parts, strict=True)]
    for k, s in enumerate(below):
        out[k + 1] = out[k + 1] + s @ parts[k]
        out[k] = out[k] + s.T @ parts[k + 1]
    return np.concatenate(out)


def _reflection(x: np.ndarray) -> tuple[np.ndarray, float, float]:
    """(v, tau, beta): I - tau v v' turns x into beta and zeros."""
    rest = x[1:] @ x[1:]
    if rest == 0:
        return np.eye(1, len(x))[0], 0.0, x[0]
    beta = -np.copysign(np.sqrt(x[0] * x[0] + rest), x[0])
    v = x / (x[0] - beta)
    v[0] = 1
    return v, (beta - x[0]) / beta, beta


def tridiagonal(diagonal: list[np.ndarray], below: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """The diagonal and the numbers beside it of a tridiagonal matrix with the band's eigenvalues.

    A column at a time: what its reflection puts outside the band is chased down block by block, one column of it each time.
    """
    n = sum(map(len, diagonal))
    wide = max(1, min(len(diagonal[0]), n - 1))
    row = 3 * wide  # (i, j) lies at i * row + j - i + 2 * wide: a block is a view whose rows are row - 1 apart
    held = np.zeros((n + 1, row))

    def view(i: int, i_end: int, j: int, j_end: int) -> np.ndarray:
        return np.ndarray((i_end - i, j_end - j), np.float64, held, 8 * (i * (row - 1) + j + 2 * wide), (8 * (row - 1), 8))

    at = 0
    for k, d in enumerate(diagonal):
        view(at, at + len(d), at, at + len(d))[:] = d
        if k < len(below):
            s = below[k]
            view(at + len(d), at + len(d) + len(s), at, at + len(d))[:] = s
            for j in range(1, len(d)):  # and its mirror image, as far as a block on the diagonal may reach
                held[at + j, row - j : row - j + len(s)] = s[:j, j]
        at += len(d)
    beside, spare = np.zeros(max(n - 1, 0)), np.empty((wide, wide))

    def less(block: np.ndarray, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> None:
        """Less a b' + c d'."""
        block -= np.matmul(np.array([a, c]).T, np.array([b, d]), out=spare[: len(a), : len(b)])

    for k in range(n - 1):
        low, high = k + 1, min(k + 1 + wide, n)
        v, tau, beside[k] = _reflection(view(low, high, k, k + 1)[:, 0].copy())
        while True:
            block = view(low, high, low, high)
            y = tau * (block @ v)
            y -= (0.5 * tau * (v @ y)) * v
            less(block, v, y, y, v)
            if high == n:
                break
            block = view(high, min(high + wide, n), low, high)
            left, before = tau * (block @ v), v
            v, tau, beta = _reflection(block[:, 0] - left * before[0])
            less(block, left, before, tau * v, v @ block - (v @ left) * before)
            block[0, 0], block[1:, 0] = beta, 0
            view(low + 1, high, high, high + 1)[:, 0] = block[0, 1:]
            low, high = high, min(high + wide, n)
    return held[:n, 2 * wide].copy(), beside


def eigenvalues(diagonal: np.ndarray, beside: np.ndarray, low: int, high: int) -> np.ndarray:
    """Those numbered low to high - 1 of a tridiagonal matrix, from the smallest: halves of an interval, chosen by counting negative pivots."""
    radius = np.append(np.abs(beside), 0) + np.append(0, np.abs(beside))
    scale = max(np.abs(diagonal).max() + radius.max(), 1e-300)
    squares = [float(s) for s in np.maximum(np.append(0, beside) ** 2, 1e-300)]
    centres = [float(d) for d in diagonal + 0.0]
    number = np.arange(low, high)
    a, b = np.full(len(number), (diagonal - radius).min() - 1e-15 * scale), np.full(len(number), (diagonal + radius).max() + 1e-15 * scale)
    with np.errstate(divide="ignore", over="ignore"):
        while True:
            x = (a + b) / 2
            if ((b - a) <= 2.3e-16 * scale).all() or ((x == a) | (x == b)).all():
                return x
            pivot, part, below = np.full(len(x), np.inf), np.empty(len(x)), np.zeros(len(x), np.int64)
            for centre, square in zip(centres, squares, strict=True):
                np.divide(square, pivot, out=part)
                np.subtract(centre, x, out=pivot)
                pivot -= part
                below += pivot < 0
            more = below <= number
            a, b = np.where(more, x, a), np.where(more, b, x)


def _solver(diagonal: list[np.ndarray], below: list[np.ndarray], shift: float, tiny: float) -> Callable[[np.ndarray], np.ndarray]:
    """Solves (band - shift) x = y for any y, by reflections of two blocks of rows at a time; pivots are tiny at least."""
    shifted = [d - shift * np.eye(len(d)) for d in diagonal]
    steps, own, beside = [], shifted[0], below[0].T if below else None
    for k in range(len(diagonal)):
        if k == len(below):
            turn, r = np.linalg.qr(own)
            one = two = None
        else:
            m = len(own)
            turn, r = np.linalg.qr(np.concatenate([own, below[k]]), mode="complete")
            last = k + 1 == len(below)
            after = np.zeros((m, 0)) if last else np.zeros((m, len(below[k + 1])))
            right = turn.T @ np.block([[beside, after], [shifted[k + 1], np.zeros((len(shifted[k + 1]), 0)) if last else below[k + 1].T]])
            width = len(shifted[k + 1])
            r, one, two = r[:m], right[:m, :width], right[:m, width:]
            own, beside = right[m:, :width], right[m:, width:]
        p = np.arange(len(r))
        r[p, p] = np.where(np.abs(r[p, p]) < tiny, tiny, r[p, p])
        steps.append((turn, r, one, two))

    def solve(y: np.ndarray) -> np.ndarray:
        parts, rest, at = [], y[: len(diagonal[0])], len(diagonal[0])
        for turn, r, one, _ in steps[:-1]:
            more = one.shape[1]
            both = turn.T @ np.concatenate([rest, y[at : at + more]])
            parts.append(both[: len(r)])
            rest, at = both[len(r) :], at + more
        parts.append(steps[-1][0].T @ rest)
        found: list[np.ndarray] = []
        for (_, r, one, two), part in zip(reversed(steps), reversed(parts), strict=True):
            if one is not None:
                part = part - one @ found[-1]
            if len(found) > 1:
                part = part - two @ found[-2]
            found.append(np.linalg.solve(r, part))
        return np.concatenate(found[::-1])

    return solve


def leading(diagonal: list[np.ndarray], below: list[np.ndarray], values: np.ndarray, seed: int = 42, tolerance: float = 1e-9) -> np.ndarray:
    """A band's eigenvectors as columns, for its largest eigenvalues in descending order, by inverse iteration; equal eigenvalues get vectors at right angles."""
    n, kept = sum(map(len, diagonal)), len(values)
    scale = found if (found := np.abs(values).max(initial=0)) > 1e-200 else 1.0
    rng, x = np.random.default_rng(seed), np.zeros((n, kept))

    def apart(y: np.ndarray, c: int) -> np.ndarray:
        for _ in range(2):
            y = y - x[:, :c] @ (x[:, :c].T @ y)
            y = y / np.linalg.norm(y)
        return y

    for c in range(kept):
        solve, y = _solver(diagonal, below, values[c], 2.3e-16 * scale), apart(rng.standard_normal(n), c)
        for _ in range(3):
            y = solve(y)
            y = apart(y / np.abs(y).max(), c)
        x[:, c] = y
    turned = times(diagonal, below, x)
    found, turn = np.linalg.eigh(x.T @ turned)
    found, turn = found[::-1], turn[:, ::-1]
    residuals = np.linalg.norm(turned @ turn - x @ turn * found, axis=0)
    if residuals.max(initial=0) > tolerance * scale:
        raise ValueError(f"an eigenvector is off by {residuals.max()} at eigenvalues of up to {scale}")
    return x @ turn
