"""Lines by closed form against numpy's eigenvectors, on easy and degenerate groups, without Python in the plan."""

import re

import numpy as np
import pytest

from pathloom.operators import lines

POINTS = "scan_id string, seq long, x double, y double, z double"


@pytest.fixture(scope="module")
def groups():
    rng = np.random.default_rng(6)
    out = {f"r{k}": rng.normal(0, rng.uniform(0.001, 100, 3), (int(rng.integers(3, 60)), 3)) @ np.linalg.qr(rng.normal(size=(3, 3)))[0] + rng.uniform(-1e3, 1e3, 3) for k in range(60)}
    t = np.linspace(0, 5, 12)
    out |= {"line": np.stack([t, 2 * t, -t], axis=1), "axis": np.stack([0 * t, 0 * t, t], axis=1), "disc": np.array([(1, 0, 0), (-1, 0, 0), (0, 1, 0), (0, -1, 0.0)]), "tilted": np.array([(1, 0, 1), (-1, 0, -1), (0, 2**0.5, 0), (0, -(2**0.5), 0.0)])}
    out |= {"cube": np.array([(a, b, c) for a in (0, 1) for b in (0, 1) for c in (0, 1)], float), "same": np.ones((5, 3)), "two": np.array([(0, 0, 0), (1, 1, 1.0)]), "one": np.ones((1, 3)), "tiny": rng.normal(0, 1e-7, (9, 3)), "huge": rng.normal(0, 1e6, (9, 3)) * [1, 2, 3]}
    return out


@pytest.fixture(scope="module")
def frame(spark, groups):
    return spark.createDataFrame([(k, i, *map(float, q)) for k, p in groups.items() for i, q in enumerate(p)], POINTS).repartition(4)


def test_directions_and_shares(frame, groups):
    for r in lines.fit_lines(frame, ["scan_id"]).collect():
        p = groups[r.scan_id]
        if len(p) < 2:
            continue
        values = np.linalg.eigvalsh(np.cov(p.T))
        v, whole = np.array(r._v), values.sum()
        assert abs(v @ v - 1) < 1e-9
        along = v @ np.cov(p.T) @ v
        assert along == pytest.approx(values[-1], rel=1e-7, abs=1e-12)  # as large as the largest, whatever the direction
        assert r._share == pytest.approx(values[-1] / whole if whole > 1e-10 else 1.0, rel=1e-7)


def test_projection_and_deviations(frame, groups):
    moved, back = {}, {}
    for r in lines.project(frame).orderBy("seq").collect():
        moved.setdefault(r.scan_id, []).append((r.x, r.y, r.z))
    for r in lines.project(frame, in_order=False).orderBy("seq").collect():
        back.setdefault(r.scan_id, []).append((r.x, r.y, r.z))
    fits = {r.scan_id: r for r in lines.line_fit(frame, distances=True).collect()}
    for k, p in groups.items():
        if len(p) < 3:
            assert np.allclose(moved[k], p) and (fits[k].explained, fits[k].mean_deviation, fits[k].distances) == (1.0, 0.0, None)
            continue
        if k in ("disc", "tilted", "cube", "same"):
            continue  # no direction of their own
        c, v = p.mean(axis=0), np.linalg.eigh(np.cov(p.T))[1][:, -1]
        flat, size = c + np.outer((p - c) @ v, v), np.abs(p).max()
        assert np.allclose(moved[k], flat, atol=1e-6 * size)
        d = np.linalg.norm(flat - p, axis=1)
        assert fits[k].distances == pytest.approx(d.tolist(), abs=1e-6 * size) and fits[k].std_deviation == pytest.approx(d.std(), abs=1e-6 * size)
        steps = (np.array(back[k]) - c) @ v
        assert (np.diff(steps) >= -1e-6 * size).all() or (np.diff(steps) <= 1e-6 * size).all()


def test_chunks(frame, groups):
    got = {}
    for r in lines.straighten_chunks(frame, chunk=7).orderBy("seq").collect():
        got.setdefault(r.scan_id, []).append((r.x, r.y, r.z))
    for k, p in groups.items():
        if k[0] != "r":
            continue
        for a in range(0, len(p), 7):
            part, out = p[a : a + 7], np.array(got[k][a : a + 7])
            values, vectors = np.linalg.eigh(np.cov(part.T)) if len(part) > 2 else (np.zeros(3), None)
            if len(part) > 2 and values[-1] / values.sum() >= 0.85:
                c = part.mean(axis=0)
                part = c + np.outer((part - c) @ vectors[:, -1], vectors[:, -1])
            assert np.allclose(out, part, atol=1e-4)


def test_no_python_and_nothing(frame):
    for df in (lines.project(frame), lines.straighten_chunks(frame), lines.line_fit(frame, distances=True)):
        assert not re.search("Python|Arrow|Pandas", df._jdf.queryExecution().executedPlan().toString())
        assert df.limit(0).count() == 0
    assert lines.line_fit(frame.limit(0)).count() == 0
