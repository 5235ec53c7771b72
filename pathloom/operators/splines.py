"""W7 with smoothing: cubic B-splines fitted to a walk over its chord length.

Knots come one set after another, in the intervals that hold most of the residual, until a least-squares spline's residual (the sum of squared
distances of all points) is at most s. Then, of all splines on these knots, the one is taken that is smoothest (by the jumps of
its third derivative) with a residual of s, to a thousandth. If a single cubic's residual is at most s, that is the answer. All systems are
symmetric with four or five diagonals, so time and memory follow the number of points.
"""

from __future__ import annotations

from math import isfinite, log

import numpy as np

from .grouped import spline

DEGREE = 3
#: Up to so many unknowns a dense solver is faster than one by diagonals.
DENSE = 200


def basis(knots: np.ndarray, u: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each u the first of the four B-splines that are not zero there, and their values."""
    span = np.clip(np.searchsorted(knots, u, side="right") - 1, DEGREE, len(knots) - DEGREE - 2)
    values = np.ones((len(u), 1))
    for k in range(1, DEGREE + 1):
        wider = np.zeros((len(u), k + 1))
        for j in range(k):
            right, left = knots[span + j + 1], knots[span + j + 1 - k]
            share = values[:, j] / (right - left)
            wider[:, j] += (right - u) * share
            wider[:, j + 1] += (u - left) * share
        values = wider
    return span - DEGREE, values


def jumps(knots: np.ndarray) -> np.ndarray:
    """One row for each inner knot: what the coefficients of five B-splines in a row add to the third derivative's jump there."""
    spans = np.arange(DEGREE, len(knots) - DEGREE - 1)
    weights = np.broadcast_to(np.eye(DEGREE + 1), (len(spans), DEGREE + 1, DEGREE + 1))
    for k in range(DEGREE, 0, -1):
        first = spans[:, None] - k + 1 + np.arange(k)[None, :]
        width = knots[first + k] - knots[first]
        weights = k * (weights[:, 1:] - weights[:, :-1]) / width[:, :, None]
    third = weights[:, 0]
    out = np.zeros((len(spans) - 1, DEGREE + 2))
    out[:, 1:] += third[1:]
    out[:, :-1] -= third[:-1]
    return out


def diagonals(first: np.ndarray, rows: np.ndarray, size: int, width: int) -> np.ndarray:
    """The products of all pairs of entries, added up: band[i, d] belongs to unknowns i and i + d."""
    band = np.zeros((size, width))
    for a in range(rows.shape[1]):
        for b in range(a, rows.shape[1]):
            band[:, b - a] += np.bincount(first + a, rows[:, a] * rows[:, b], size)
    return band


def solved(band: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Solves a symmetric, positive definite system given by its diagonals."""
    size, width = band.shape
    if size <= DENSE:
        whole = np.zeros((size, size))
        for d in range(width):
            at = np.arange(size - d)
            whole[at, at + d] = whole[at + d, at] = band[: size - d, d]
        return np.linalg.solve(whole, right)
    band, x = band.copy(), right.copy()
    for i in range(size):  # Cholesky without roots, row by row
        n = min(width, size - i)
        for d in range(1, n):
            share = band[i, d] / band[i, 0]
            band[i + d, : n - d] -= share * band[i, d:n]
            x[i + d] -= share * x[i]
    for i in range(size - 1, -1, -1):
        n = min(width, size - i)
        x[i] = (x[i] - band[i, 1:n] @ x[i + 1 : i + n]) / band[i, 0]
    return x


class Fit:
    """Splines on fixed knots through points p at places u."""

    def __init__(self, u: np.ndarray, p: np.ndarray, knots: np.ndarray):
        self.u, self.p, self.knots = u, p, knots
        self.size = len(knots) - DEGREE - 1
        self.first, self.values = basis(knots, u)
        self.squares = diagonals(self.first, self.values, self.size, DEGREE + 2)
        self.right = np.stack([sum(np.bincount(self.first + a, self.values[:, a] * p[:, c], self.size) for a in range(DEGREE + 1)) for c in range(p.shape[1])], axis=1)
        rough = jumps(knots)
        self.rough = diagonals(np.arange(len(rough)), rough, self.size, DEGREE + 2)

    def coefficients(self, roughness: float = 0.0) -> np.ndarray:
        """Those that minimise the residual plus roughness times the squared jumps."""
        return solved(self.squares + roughness * self.rough, self.right)

    def residuals(self, c: np.ndarray) -> np.ndarray:
        return ((self.at(c, self.first, self.values) - self.p) ** 2).sum(axis=1)

    @staticmethod
    def at(c: np.ndarray, first: np.ndarray, values: np.ndarray) -> np.ndarray:
        return sum(values[:, a, None] * c[first + a] for a in range(DEGREE + 1))


def more_knots(knots: np.ndarray, u: np.ndarray, residuals: np.ndarray) -> np.ndarray | None:
    """Knots with as many new ones as there are intervals now, at most, each at the middle point of an interval with much residual; None if no interval holds a point to spare."""
    inner = knots[DEGREE : len(knots) - DEGREE]
    interval = np.clip(np.searchsorted(inner, u, side="right") - 1, 0, len(inner) - 2)
    # points strictly inside: a knot is put on one of them, and every interval between knots keeps one
    free = (u > inner[interval]) & (u < inner[interval + 1])
    count = np.bincount(interval[free], minlength=len(inner) - 1)
    worth = np.bincount(interval, residuals, len(inner) - 1)
    able = np.flatnonzero((count >= 3) & (worth > 0))
    if not len(able):
        return None
    chosen = able[np.argsort(-worth[able], kind="stable")][: max(1, len(inner) // 2)]
    begin = np.searchsorted(interval[free], chosen)
    return np.sort(np.concatenate((knots, u[free][begin + count[chosen] // 2])))


def smoothing_spline(p: np.ndarray, s: float = 0.0, points: int | None = None) -> np.ndarray:
    """`points` points (as many as p by default) at even places of a spline whose residual against p is at most s (to a thousandth).

    s = 0 passes through all points. Under four points, or where neighbours coincide, W4.
    """
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    if s <= 0 or len(p) < 4 or not (step >= 1e-12).all():
        return spline(p, points)
    fit, c = smoothing_fit(p, s)
    if fit is None:
        return spline(p, points)
    return fit.at(c, *basis(fit.knots, np.linspace(0, 1, points or len(p))))


def smoothing_fit(p: np.ndarray, s: float) -> tuple[Fit | None, np.ndarray | None]:
    """The spline of smoothing_spline and its coefficients; None where only one through all points meets s."""
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    u = np.concatenate(([0], np.cumsum(step))) / step.sum()
    u[-1] = 1.0
    knots = np.repeat([0.0, 1.0], DEGREE + 1)
    while True:
        fit = Fit(u, p, knots)
        c = fit.coefficients()
        r = fit.residuals(c)
        if r.sum() <= s:
            break
        knots = more_knots(knots, u, r)
        if knots is None:
            return None, None
    if fit.size == DEGREE + 1:
        return fit, c
    # the residual grows with the roughness's price, from the least-squares spline's to the single cubic's
    unit = fit.squares[:, 0].sum() / fit.rough[:, 0].sum()
    # the exponents between which the price lies, each with its residual's logarithm against s
    low, high, under, over = -15.0, 9.0, log(max(r.sum(), 1e-300) / s), None
    for _ in range(100):
        share = 0.5 if over is None or over - under < 1e-9 else min(max((log(0.9995) - under) / (over - under), 0.1), 0.9)
        price = low + share * (high - low)
        tried = fit.coefficients(unit * 10.0**price)
        reached = fit.residuals(tried).sum()
        if reached <= s:
            low, c, under = price, tried, log(max(reached, 1e-300) / s)
            if reached >= s * 0.999:
                break
        else:
            high, over = price, log(reached / s) if isfinite(reached) else None
    return fit, c


