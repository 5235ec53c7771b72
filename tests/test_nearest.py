"""Nearest nodes against plain loops: inside, outside and far from the nodes' box, on lines, single points and in clusters."""

import math
import random

from pathloom.operators import graph

RNG = random.Random(9)
NODES = "scan_id long, floor_level int, node_id string, original_index long, x double, y double, z double"
PLACES = "place long, scan_id long, floor_level int, px double, py double, pz double"


def floors():
    spread = [(RNG.uniform(0, 50), RNG.uniform(0, 20), RNG.uniform(0, 3)) for _ in range(300)]
    line = [(k * 0.5, 3.0, 1.0) for k in range(100)]
    clusters = [(RNG.gauss(c, 0.01), RNG.gauss(-c, 0.01), 0.0) for c in (0, 1000) for _ in range(60)]
    ties = [(float(x), float(y), 0.0) for x in range(5) for y in range(5)] * 2
    return {(1, 1): spread, (1, 2): line, (2, 1): clusters, (2, 2): [(5.0, 5.0, 5.0)], (3, 1): ties}


def test_equals_plain_loops_in_few_jobs(spark):
    at = floors()
    nodes = [(*key, f"{key}-{k}", k, *p) for key, points in at.items() for k, p in enumerate(points)] + [(1, 1, "nan", 999, math.nan, 0.0, 0.0)]
    places = []
    for key, points in at.items():
        some = [tuple(c + RNG.gauss(0, s) for c in RNG.choice(points)) for s in (0.01, 1, 10, 300, 1e4, 1e7) for _ in range(25)] + points[:20] + [(2.5, 2.5, 0.0), (0.5, 0.5, 0.0)]
        places += [(len(places) + k, *key, *p) for k, p in enumerate(some)]
    n = len(places)
    places += [(n, 1, 1, 1e300, 0.0, 0.0), (n + 1, 1, 2, -1e300, 1e300, 1e300), (n + 2, 1, 1, math.inf, 0.0, 0.0), (n + 3, 9, 9, 0.0, 0.0, 0.0), (n + 4, 1, 1, None, 0.0, 0.0)]
    group = f"nearest{n}"
    spark.sparkContext.setJobGroup(group, group)
    try:
        got = {r.place: (r.node_id, r.distance) for r in graph.nearest_node(spark.createDataFrame(places, PLACES), spark.createDataFrame(nodes, NODES), ["place"]).collect()}
        jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert set(got) == set(range(n + 2)) and jobs < 30
    for i, scan, floor, *p in places[:n]:
        points = at[scan, floor]
        distances = [math.dist(p, q) for q in points]
        least = min(distances)
        assert abs(got[i][1] - least) <= 1e-9 * max(1, least)
        exact = [k for k, v in enumerate(distances) if v <= least * (1 + 1e-12)]
        assert got[i][0] in {f"({scan}, {floor})-{k}" for k in exact}
        if scan == 3 and least < 100:
            assert got[i][0] == f"({scan}, {floor})-{exact[0]}"
    assert got[n][1] == math.inf and got[n + 1][0]


def test_no_places_or_nodes(spark):
    none = spark.createDataFrame([], PLACES)
    nodes = spark.createDataFrame([(1, 1, "a", 0, 0.0, 0.0, 0.0)], NODES)
    assert graph.nearest_node(none, nodes, ["place"]).count() == 0
    assert graph.nearest_node(spark.createDataFrame([(1, 1, 1, 0.0, 0.0, 0.0)], PLACES), nodes.limit(0), ["place"]).count() == 0


def test_places_on_small_floors_travel_once_and_both_ways_agree(spark):
    nodes = spark.createDataFrame([(1, 1, f"n{k}", k, float(k % 6), float(k // 6), 0.0) for k in range(36)], NODES)
    places = spark.createDataFrame([(k, 1, 1, RNG.uniform(-3, 9), RNG.uniform(-3, 9), 0.5) for k in range(40)] + [(40, 1, 1, 2.5, 2.5, 0.0)], PLACES)
    whole = graph.nearest_node(places, nodes, ["place"])
    assert "Generate" not in whole._jdf.queryExecution().toString()
    assert sorted(whole.collect()) == sorted(graph.nearest_node(places, nodes, ["place"], few=0).collect())
