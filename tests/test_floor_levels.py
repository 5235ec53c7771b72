"""Height levels (V5, V6) against a plain histogram, kernel and fold in numpy, and no Python in their plan."""

import re

import numpy as np
import pytest

from pathloom.operators import floors


def plain_levels(z, height=3.0):
    spread = z.max() - z.min()
    if spread < height:
        return np.zeros(len(z), int)
    counts, edges = np.histogram(z, bins=max(int(spread / 0.5), 20))
    kernel = np.exp(-0.5 * (np.arange(-6, 7) / 1.5) ** 2)
    smoothed = np.convolve(np.pad(counts.astype(float), 6, mode="symmetric"), kernel / kernel.sum(), mode="valid")
    high = np.flatnonzero(smoothed >= 0.03 * len(z))
    peaks = []
    for region in np.split(high, np.flatnonzero(np.diff(high) > 2) + 1) if len(high) else []:
        peak = float(np.average((edges[region] + edges[region + 1]) / 2, weights=smoothed[region]))
        if all(abs(peak - q) >= 0.7 * height for q in peaks):
            peaks.append(peak)
    if not peaks:
        n = max(1, int(spread / height) + 1)
        peaks = [z.min() + (i + 0.5) * spread / n for i in range(n)]
    return np.abs(z[:, None] - np.sort(peaks)).argmin(axis=1)


@pytest.fixture(scope="module")
def scans():
    rng = np.random.default_rng(4)
    out = {1: np.linspace(0, 2.9, 50), 2: np.array([0.0] * 30 + [4.0] * 30), 3: np.array([5.0]), 4: rng.uniform(0, 40, 900), 5: rng.uniform(-500, 500, 600)}
    for k in range(6, 40):
        centers = np.cumsum(rng.uniform(1.5, 5, rng.integers(1, 9)))
        out[k] = np.concatenate([rng.normal(c, rng.uniform(0.01, 0.6), rng.integers(5, 200)) for c in centers])
    out[40] = np.repeat(np.arange(0, 20, 0.5), 5)  # heights on the bins' edges
    return out


def test_levels_as_in_numpy(spark, scans):
    rows = spark.createDataFrame([(k, i, float(v)) for k, z in scans.items() for i, v in enumerate(z)], "scan_id long, seq long, z double").repartition(5)
    got = rows.join(floors.height_peaks(rows), "scan_id").select("scan_id", "seq", floors.height_level().alias("level"))
    level = {(r.scan_id, r.seq): r.level for r in got.collect()}
    for k, z in scans.items():
        assert [level[k, i] for i in range(len(z))] == plain_levels(z).tolist(), k


def test_no_python_in_the_plan(spark, scans):
    points = spark.createDataFrame([(k, i, 0.0, 0.0, float(v), False) for k, z in scans.items() for i, v in enumerate(z)], "scan_id long, seq long, x double, y double, z double, on_passage boolean")
    for frame in (floors.height_peaks(points), floors.separate_floors(points)):
        assert not re.search("Python|Arrow|Pandas", frame._jdf.queryExecution().executedPlan().toString())
    assert floors.separate_floors(points.limit(0)).count() == 0
