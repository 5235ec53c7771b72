"""The steps that the graph queries share: points are dealt once, and only what a query reads is computed."""

import math

import numpy as np
import pytest

from pathloom.operators import floors, graph, grouped
from pathloom.plans import processing
from pathloom.sources.scans import walks

POINTS = "scan_id long, seq long, x double, y double, z double"


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange ")


def climb(scan, start=0):
    heights = [0.0] * 20 + [0.25 * i for i in range(1, 13)] + [3.0] * 20
    return [(scan, start + i, 0.3 * i, 0.0, z) for i, z in enumerate(heights)]


@pytest.fixture(scope="module")
def done(spark):
    return processing.process(walks(spark, "/root/testdata/sf0.001"))


def test_statistics_compute_no_passages(done):
    assert graph.graph_stats(done.nodes, done.edges).count() > 0
    assert not {"passages", "located", "runs"} & set(vars(done))


def test_points_are_dealt_once(spark, done):
    points = spark.createDataFrame(climb(1) + climb(2), POINTS).repartition(3).localCheckpoint()
    assert exchanges(floors.on_runs(points)) == 1
    assert exchanges(graph.placed_nodes(done.paths.localCheckpoint())) == 1


def test_runs_by_point(spark):
    marked = floors.on_runs(spark.createDataFrame(climb(1) + climb(None), POINTS).repartition(3))
    got = {r.seq: (r.start_idx, r.end_idx) for r in marked.filter("on_passage").collect()}
    [run] = floors.runs_of(marked).collect()
    assert run.scan_id == 1 and set(got) == set(range(run.start_idx, run.end_idx)) and set(got.values()) == {(run.start_idx, run.end_idx)}
    assert marked.filter("scan_id IS NULL AND on_passage").count() == 0 and marked.count() == len(climb(1)) * 2
    assert floors.separate_floors(marked).filter("scan_id IS NULL").count() == 0


def test_ways_of_nodes(done):
    one, other = (sorted((r.from_node, r.to_node, r.distance) for r in e.collect()) for e in (graph.edges_along(done.placed), graph.path_edges(done.paths, done.nodes)))
    assert one == other and len(one) > 100


def test_interpolated_as_stretch_by_stretch():
    rng = np.random.default_rng(3)
    for n in (1, 2, 3, 40):
        p = rng.uniform(0, 4, (n, 3)).round(1)
        p[n // 2 :: 7] = p[n // 2]
        parts = [p[:1]]
        for a, b in zip(p, p[1:]):
            d = float(np.linalg.norm(b - a))
            if d >= 1e-10:
                k = max(1, math.ceil(d / 0.5))
                parts.append(a + np.outer(np.arange(1, k + 1) / k, b - a))
        assert (grouped.interpolated(p, 0.5) == np.concatenate(parts)).all()


def test_merged_runs_without_joins(spark):
    rng = np.random.default_rng(8)
    rows = []
    for scan in range(40):
        z = np.cumsum(np.repeat(rng.choice([0.0, 0.0, 0.25, 0.25, -0.25], 30), rng.integers(2, 14, 30)))
        rows += [(scan, i, float(0.2 * i), float(0.1 * i % 3), float(h)) for i, h in enumerate(z)]
    marked = floors.on_runs(spark.createDataFrame(rows, POINTS).repartition(3)).localCheckpoint()
    runs = floors.runs_of(marked)
    by_joins = sorted(tuple(r) for r in floors.merged_runs(runs, marked).select("scan_id", "start_idx", "end_idx", "z_start", "z_end", "direction", "type").collect())
    merged = floors.on_merged_runs(marked)
    got = floors.summed(merged, ends=True).collect()
    assert sorted(tuple(r[c] for c in ("scan_id", "start_idx", "end_idx", "z_start", "z_end", "direction", "type")) for r in got) == by_joins
    assert exchanges(merged) == 1 and 40 < len(got) < runs.count()
    at = {r[:2]: r[2:] for r in rows}
    for r in got:
        assert (r.entry_x, r.entry_y, r.entry_z) == at[r.scan_id, r.start_idx] and (r.exit_x, r.exit_y, r.exit_z) == at[r.scan_id, r.end_idx - 1]


def test_vertical_edges_by_ends_or_points(spark):
    done = processing.process(walks(spark, "/root/testdata/sf0.001"), True)
    one, other = (sorted(tuple(r) for r in e.select("scan_id", "from_node", "to_node", "distance", "edge_type").collect()) for e in (done.vertical, graph.vertical_edges(done.passages, done.nodes, done.points)))
    assert one == other and one


def test_distances_serve_both_steps():
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 30, 200, grouped.SMALL, grouped.SMALL + 1):
        for width in (0.1, 3.0, 30.0):
            p = np.cumsum(rng.normal(0, 0.4, (n, 3)), axis=0) if width == 3.0 else rng.uniform(0, width, (n, 3))
            merged = p[grouped.overlaps_merged(p, 1.0)]
            assert (grouped.overlaps_merged_and_apart(p, 1.0, 0.5) == merged[grouped.kept_apart(merged, 0.5)]).all()
    p[3] = math.nan
    merged = p[grouped.overlaps_merged(p, 1.0)]
    np.testing.assert_array_equal(grouped.overlaps_merged_and_apart(p, 1.0, 0.5), merged[grouped.kept_apart(merged, 0.5)])
