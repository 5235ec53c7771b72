"""Smoothing splines: residuals within s, and the same as a dense solver on a plainly built basis gives."""

import time

import numpy as np
import pytest

from pathloom.operators import grouped, splines

RNG = np.random.default_rng(7)


def plain_basis(knots, u):
    """All B-splines at all places by the recursion itself."""
    m = len(knots) - 4

    def b(i, k, x):
        if k == 0:
            last = x == 1.0 and knots[i] < 1.0 == knots[i + 1]
            return 1.0 if knots[i] <= x < knots[i + 1] or last else 0.0
        out = 0.0
        if knots[i + k] > knots[i]:
            out += (x - knots[i]) / (knots[i + k] - knots[i]) * b(i, k - 1, x)
        if knots[i + k + 1] > knots[i + 1]:
            out += (knots[i + k + 1] - x) / (knots[i + k + 1] - knots[i + 1]) * b(i + 1, k - 1, x)
        return out

    return np.array([[b(i, 3, x) for i in range(m)] for x in u])


def walk(n, noise=0.1):
    t = np.linspace(0, 6, n)
    return np.stack([4 * t, 3 * np.sin(t), np.cos(2 * t)], axis=1) + RNG.normal(0, noise, (n, 3))


@pytest.mark.parametrize("n, s", [(20, 0.2), (60, 1.0), (99, 2.0), (60, 50.0), (60, 1e6)])
def test_equals_a_dense_solver(n, s):
    p = walk(n)
    fit, c = splines.smoothing_fit(p, s)
    step = np.linalg.norm(np.diff(p, axis=0), axis=1)
    u = np.concatenate(([0], np.cumsum(step))) / step.sum()
    whole = plain_basis(fit.knots, np.minimum(u, 1.0))
    residual = ((whole @ c - p) ** 2).sum()
    assert residual <= s * (1 + 1e-9)
    least = np.linalg.lstsq(whole, p, rcond=None)[0]
    assert ((whole @ least - p) ** 2).sum() <= s * (1 + 1e-9)
    assert np.allclose(fit.coefficients(), least, atol=1e-6)
    if fit.size == 4:
        assert np.allclose(c, least, atol=1e-6)
        return
    assert residual >= 0.998 * s
    # the price that gave c, found again by a dense penalised solve: no other spline with this residual is smoother
    inner = fit.knots[4:-4]
    rough = np.zeros((len(inner), fit.size))
    for k, row in enumerate(splines.jumps(fit.knots)):
        rough[k, k : k + 5] = row
    prices = np.logspace(-15, 9, 400) * (whole**2).sum() / (rough**2).sum()
    right = np.concatenate((p, np.zeros((len(rough), 3))))
    best = min((np.linalg.lstsq(np.concatenate((whole, np.sqrt(q) * rough)), right, rcond=None)[0] for q in prices), key=lambda d: abs(((whole @ d - p) ** 2).sum() - residual))
    assert np.linalg.norm(rough @ c) <= 1.3 * np.linalg.norm(rough @ best) + 1e-9


def test_jumps_of_the_third_derivative():
    knots = np.array([0, 0, 0, 0, 0.2, 0.5, 0.6, 1, 1, 1, 1.0])
    c = RNG.normal(size=len(knots) - 4)
    value = lambda x: (plain_basis(knots, x) @ c)
    cubic = lambda a, b: np.polyfit(np.linspace(a, b, 7), value(np.linspace(a, b - 1e-12, 7)), 3)[0] * 6
    edges = [0, 0.2, 0.5, 0.6, 1.0]
    third = [cubic(a, b) for a, b in zip(edges, edges[1:])]
    got = [row @ c[k : k + 5] for k, row in enumerate(splines.jumps(knots))]
    assert np.allclose(got, np.diff(third), rtol=1e-4)


def test_by_diagonals_as_dense(monkeypatch):
    p = walk(300)
    dense = splines.smoothing_spline(p, 3.0)
    monkeypatch.setattr(splines, "DENSE", 0)
    assert np.allclose(splines.smoothing_spline(p, 3.0), dense, atol=1e-8)


def test_defined_cases():
    p = walk(30)
    assert np.allclose(splines.smoothing_spline(p, 0.0), grouped.spline(p))
    assert np.allclose(splines.smoothing_spline(p, 1e-9), grouped.spline(p), atol=0.05)
    assert np.allclose(splines.smoothing_spline(p[:3], 1.0), grouped.blurred(p[:3]))
    twice = np.concatenate((p[:5], p[4:]))
    assert np.allclose(splines.smoothing_spline(twice, 1.0), grouped.blurred(twice))
    assert splines.smoothing_spline(p, 1.0, 77).shape == (77, 3) and np.isfinite(splines.smoothing_spline(p[:4], 0.01)).all()


def test_long_walks_in_time():
    p = walk(20_000)
    began = time.process_time()
    assert len(splines.smoothing_spline(p, 400.0)) == 20_000
    assert time.process_time() - began < 60


def test_query_over_all_walks(spark):
    from pathloom.plans import queries
    from pathloom.sources.scans import walks

    sf = "/root/testdata/sf0.001"
    got = {}
    for r in queries.QUERIES["w7_smoothing_spline"](spark, sf).orderBy("scan_id", "seq").collect():
        got.setdefault(r.scan_id, []).append((r.x, r.y, r.z))
    points = {}
    for r in walks(spark, sf).orderBy("scan_id", "seq").collect():
        points.setdefault(r.scan_id, []).append((r.x, r.y, r.z))
    assert set(got) == set(points)
    for k, p in points.items():
        p = np.array(p)
        fit, c = splines.smoothing_fit(p, 1.0)
        assert fit is None or fit.residuals(c).sum() <= 1.0
        assert np.allclose(got[k], splines.smoothing_spline(p, 1.0), atol=1e-5)
