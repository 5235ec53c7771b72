"""Hand-made walks, one for each branch."""

import sqlite3
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from pathloom.functions import geometry as geo
from pathloom.operators import catalog, cleaning, floors, graph, grouped, routing
from pathloom.sources import scans, slam

POINTS = "scan_id long, seq long, x double, y double, z double"


def walk(spark, xs, ys=None, zs=None):
    n = len(xs)
    return spark.createDataFrame([(1, i, float(x), float(y), float(z)) for i, (x, y, z) in enumerate(zip(xs, ys or [0] * n, zs or [0] * n))], POINTS)


def line(xs):
    return np.array([[x, 0.0, 0.0] for x in xs])


def xs(df):
    return [r.x for r in df.orderBy("seq").collect()]


@pytest.mark.parametrize("points,radius,kept", [([0, 0.1, 1, 1.1, 2], 0.2, [0, 2, 4]), ([0, 0.2, 0.4], 0.25, [0, 2]), ([0, 0.1], 0.2, [0, 1])])
def test_deduplicate(points, radius, kept):
    assert grouped.kept_apart(line(points), radius) == kept


def test_rdp_keeps_ends_of_lines_and_loops():
    assert grouped.rdp(line(range(10)), 0.1) == [0, 9]
    assert grouped.rdp(np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0], [0, 0, 0.0]]), 0.1) == [0, 4]
    assert grouped.rdp(np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0.0]]), 0.1) == [0, 1, 2]


def test_interpolation_and_spline():
    assert grouped.interpolated(line([0, 1.2]), 0.5)[:, 0].tolist() == pytest.approx([0, 0.4, 0.8, 1.2])
    p = np.array([[0, 0, 0], [1, 1, 0], [2, 0, 0], [3, 1, 1], [4, 0, 0.0]])
    u = np.concatenate(([0], np.cumsum(np.linalg.norm(np.diff(p, axis=0), axis=1))))
    assert np.allclose(grouped.spline(p, 101)[[0, -1]], p[[0, -1]])
    cubic = np.stack([np.linspace(0, 1, 9), np.linspace(0, 1, 9) * 2, np.linspace(0, 1, 9) * 3], axis=1)
    assert np.allclose(grouped.spline(cubic, 9), cubic) and len(u) == 5


def test_snapping_drops_single_points():
    assert len(grouped.snapped(line([0, 10, 20]))) == 0
    assert grouped.snapped(line([0, 1, 10, 20, 21]))[:, 0].tolist() == pytest.approx([0, 0.5, 1, 20, 20.5, 21])


def test_outliers(spark):
    assert xs(cleaning.remove_outliers(walk(spark, [0, 1, 100, 3, 2]))) == [0, 1, 100, 3, 2]
    ys = [0.0] * 31
    ys[15] = 100.0
    changed = [r.seq for r in cleaning.remove_outliers(walk(spark, range(31), ys)).join(walk(spark, range(31), ys), ["seq", "y", "x"], "left_anti").collect()]
    assert sorted(changed) == [14, 15, 16]


def test_percentages_round_as_python_does(spark):
    pairs = [(a, b) for b in (1, 3, 7, 16, 40, 80, 400, 2000) for a in range(b + 1)]
    got = spark.createDataFrame(pairs, "a long, b long").select("a", "b", cleaning.percent_text(F.col("a") / F.col("b")).alias("t")).collect()
    assert all(r.t == f"{r.a / r.b * 100:.1f}%" for r in got)


def test_deduplication_stats_round_their_percentage_once(spark):
    pairs = [(a, b) for b in (80, 160, 200, 240, 320) for a in range(1, b)]
    before = spark.createDataFrame([(b * 1000 + a, k) for a, b in pairs for k in range(b)], "scan_id long, seq long")
    after = before.filter("seq >= scan_id % 1000")
    got = {r.scan_id: r.reduction_text for r in cleaning.deduplication_stats(before, after).collect()}
    assert len(got) == len(pairs) and all(got[b * 1000 + a] == f"{100 * a / b:.1f}%" for a, b in pairs)
    assert got[80023] == "28.8%"


def test_gaps(spark):
    assert xs(cleaning.split_at_gaps(walk(spark, [0, 1, 10, 20, 21]))) == [0, 1, 20, 21]
    assert xs(cleaning.split_at_gaps(walk(spark, [5]))) == [5]
    assert cleaning.split_at_gaps(walk(spark, [])).count() == 0


def test_curvature_and_smoothing(spark):
    r = cleaning.curvature(walk(spark, [0, 1, 1], [0, 0, 1])).orderBy("seq").collect()
    assert [x.curvature for x in r] == pytest.approx([1, 1, 1])
    assert [x.curvature for x in cleaning.curvature(walk(spark, [0, 1])).collect()] == [0, 0]
    assert xs(cleaning.smooth(walk(spark, [3] * 5))) == pytest.approx([3] * 5)
    assert xs(cleaning.smooth(walk(spark, [0, 9]))) == [0, 9]
    assert xs(cleaning.adaptive_smooth(walk(spark, [3] * 7))) == pytest.approx([3] * 7)


def test_junctions(spark):
    def corner(k):
        return walk(spark, [min(i, k) for i in range(8)], [max(0, i - k) for i in range(8)])

    found = lambda df: [r.seq for r in graph.junction_turns(df, keys=("scan_id",)).filter("junction").collect()]
    assert found(corner(3)) == [3] and found(corner(2)) == []


def test_edges_stop_at_long_ways(spark):
    p = walk(spark, [0, 4, 5]).withColumn("floor_level", F.lit(1))
    nodes = graph.path_nodes(p)
    assert sorted(r.original_index for r in nodes.collect()) == [0, 1, 2]
    assert [r.distance for r in graph.path_edges(p, nodes).collect()] == pytest.approx([1.0])
    assert graph.vertical_edges(nodes, nodes).count() == 0


def test_nearest_node_equals_all_pairs(spark):
    rng = np.random.default_rng(3)
    p = np.concatenate([rng.normal(0, 1, (150, 3)), rng.normal(0, 30, (50, 3)), np.round(rng.normal(0, 2, (60, 3)))])
    q = np.concatenate([rng.normal(0, 2, (80, 3)), rng.normal(0, 200, (30, 3)), np.round(rng.normal(0, 2, (40, 3)))])
    nodes = spark.createDataFrame([(1, 1 + i % 2, f"n{i}", i, *map(float, x)) for i, x in enumerate(p)] + [(2, 1, "one", 0, 5.0, 5.0, 0.0)], "scan_id long, floor_level int, node_id string, original_index long, x double, y double, z double")
    places = spark.createDataFrame([(1, i, 1 + i % 3, *map(float, x)) for i, x in enumerate(q)] + [(2, 0, 1, -90.0, 7.0, 1.0), (3, 0, 1, 0.0, 0.0, 0.0)], "scan_id long, seq long, floor_level int, px double, py double, pz double")
    got = {(r.scan_id, r.seq): r.node_id for r in graph.nearest_node(places, nodes, ["scan_id", "seq"]).collect()}
    expected = {(1, i): f"n{min((j for j in range(len(p)) if j % 2 == i % 3), key=lambda j: (np.linalg.norm(p[j] - x), j))}" for i, x in enumerate(q) if i % 3 < 2}
    assert got == {**expected, (2, 0): "one"}


def test_every_point_is_snapped(spark):
    from pathloom.plans import queries

    sf_dir = "/root/testdata/sf0.001"
    assert queries.QUERIES["r13_snap_poi"](spark, sf_dir).count() == scans.walks(spark, sf_dir).count()


def test_edge_weights(spark):
    rows = [(10.0, k, p) for k in ("VERTICAL_ELEVATOR", "VERTICAL_STAIRCASE", "HORIZONTAL") for p in ("SHORTEST", "ELEVATOR_FIRST", "STAIRCASE_FIRST")]
    got = [r.w for r in spark.createDataFrame(rows, "d double, k string, p string").select(geo.edge_weight(F.col("d"), F.col("k"), F.col("p")).alias("w")).collect()]
    assert got == [10, 5, 20, 10, 20, 8, 10, 10, 10]


def test_routes(spark):
    nodes = spark.createDataFrame([(1, 1, i, float(i), 0.0, 0.0, "WAYPOINT", None, None, f"n{i}", "Room" if i == 3 else None) for i in range(5)], graph.NODE_SCHEMA + ", node_id string, poi_name string")
    edges = spark.createDataFrame([(1, 1, "n0", "n1", 1.0, "HORIZONTAL", True), (1, 1, "n1", "n3", 5.0, "VERTICAL_ELEVATOR", True), (1, 1, "n1", "n2", 1.0, "VERTICAL_STAIRCASE", True), (1, 1, "n2", "n3", 3.0, "HORIZONTAL", True)], "scan_id long, floor_level int, from_node string, to_node string, distance double, edge_type string, bidirectional boolean")
    asked = spark.createDataFrame([(1, 1, 1, 0.0, 0.0, "Room", "SHORTEST"), (1, 2, 1, 0.0, 0.0, "Room", "ELEVATOR_FIRST"), (1, 3, 1, 4.0, 0.0, "Room", "SHORTEST"), (1, 4, 1, 0.0, 0.0, "Hall", "SHORTEST"), (1, 5, 9, 0.0, 0.0, "Room", "SHORTEST")], "scan_id long, request_id long, floor_level int, x double, y double, destination string, preference string")
    r = {x.request_id: (x.cost, x.path, x.error) for x in routing.routes(asked, nodes, edges).collect()}
    assert r[1] == (5.0, ["n0", "n1", "n2", "n3"], None) and r[2] == (3.5, ["n0", "n1", "n3"], None)
    assert [r[k][2] for k in (3, 4, 5)] == ["NO_PATH_AVAILABLE", "DESTINATION_NOT_FOUND", "GRAPH_NOT_BUILT"]


def test_slam_files(spark, tmp_path):
    pose = lambda x, y, z: struct.pack("<12f", 1, 0, 0, x, 0, 1, 0, y, 0, 0, 1, z)
    with sqlite3.connect(tmp_path / "a.db") as db:
        db.execute("CREATE TABLE Node (id INTEGER, pose BLOB)")
        db.executemany("INSERT INTO Node VALUES (?, ?)", [(3, pose(1, 2, 3)), (1, pose(4, 5, 6)), (2, None), (4, b""), (5, b"x" * 47), (6, pose(0, 0, 0)), (7, pose(float("nan"), 0, 1))])
    slam.register(spark)
    rows = scans.trajectory(spark.read.format("slam_nodes").load(str(tmp_path / "a.db"))).orderBy("seq").collect()
    assert [(r.scan_id, r.node_id, r.seq, r.x, r.y, r.z) for r in rows] == [("a.db", 1, 0, 4, 5, 6), ("a.db", 3, 1, 1, 2, 3)]
    assert [r.file_name for r in scans.scan_files(spark, str(tmp_path)).collect()] == ["a.db"]


def test_catalog(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "id int, name string")
    new = spark.createDataFrame([(2, "x"), (3, " "), (4, "y"), (5, None)], "id int, name string")
    assert [r.id for r in catalog.accepted(new, old, ["id"], ["name"]).collect()] == [4]
    assert [r.id for r in catalog.conflicts(new, old, ["id"]).collect()] == [2]
    with pytest.raises(catalog.CatalogError):
        catalog.only(catalog.matching(old, id=9), "FLOOR_NOT_FOUND")
    assert catalog.named_like(new, "name", " ").count() == 3


def test_entry_imports_without_corpus_operators():
    import __spark_entry__

    assert "t1_trajectory_stats" in __spark_entry__.queries() and set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_answers_not_found(spark):
    asked, rows = spark.createDataFrame([(1,), (9,)], "id int"), spark.createDataFrame([(1, "a")], "id int, name string")
    assert {r.id: (r.name, r.error) for r in catalog.answered(asked, rows, ["id"], "FLOOR_NOT_FOUND").collect()} == {1: ("a", None), 9: (None, "FLOOR_NOT_FOUND")}
    detail = catalog.building_detail(rows, spark.createDataFrame([(1, 2), (1, 1)], "id int, level int"), spark.createDataFrame([], "id int, passage int"), "id", "level", "passage").first()
    assert (detail.floors, detail.passages) == ([1, 2], [])


def test_old_readers(spark):
    rows = [(1, 1, struct.pack("<12f", *[0] * 3, 1e-7, *[0] * 8)), (1, 2, None), (1, 3, b"")]
    nodes = spark.createDataFrame(rows, "scan_id long, node_id long, pose binary")
    assert scans.trajectory(nodes).count() == 0 and scans.trajectory(nodes, scans.OLD_TOLERANCE, any_length=True).count() == 1
    short = spark.createDataFrame([(1, 4, b"x" * 47)], nodes.schema)
    assert scans.trajectory(short).count() == 0
    with pytest.raises(Exception, match="pose of 47 bytes"):
        scans.trajectory(nodes.union(short), any_length=True).collect()
