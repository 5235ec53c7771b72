"""Routes by A* with landmarks against Dijkstra's method, for all preferences, and how many nodes either settles."""

import math
import random

import pytest

from pathloom.operators import routing

RNG = random.Random(14)
NODES = "scan_id string, floor_level int, original_index long, node_id string, x double, y double, poi_name string"
EDGES = "scan_id string, from_node string, to_node string, distance double, edge_type string, bidirectional boolean"
ASKED = "scan_id string, request_id long, floor_level int, x double, y double, destination string, preference string"


def building(floors=4, side=14):
    """Grids joined by lifts and stairs, some edges one-way, some missing, and a part on its own."""
    names = [(f, x, y) for f in range(floors) for x in range(side) for y in range(side)]
    edges = []
    for f, x, y in names:
        for a, b in ((x + 1, y), (x, y + 1)):
            if a >= side or b >= side or RNG.random() < 0.1:
                continue
            edges.append((f"{f}-{x}-{y}", f"{f}-{a}-{b}", RNG.uniform(0.5, 2), "HORIZONTAL", RNG.random() > 0.1))
        if f + 1 < floors and RNG.random() < 0.05:
            edges.append((f"{f}-{x}-{y}", f"{f + 1}-{x}-{y}", 3.0, RNG.choice(["VERTICAL_ELEVATOR", "VERTICAL_STAIRCASE"]), True))
    return [f"{f}-{x}-{y}" for f, x, y in names] + ["alone"], edges + [("0-0-0", "unknown", 1.0, "HORIZONTAL", True)]


@pytest.mark.parametrize("seed", range(4))
def test_costs_equal_dijkstras_and_fewer_nodes_are_settled(seed):
    RNG.seed(seed)
    names, edges = building()
    graph = routing.Graph(names, edges)
    marks = graph.far_apart(4)
    assert len(set(marks)) == 4
    plain = guided = 0
    for wish in routing.FACTORS:
        factors = routing.all_factors(wish)
        bounds = [(graph.costs(m, factors), graph.costs(m, factors, True)) for m in marks]
        for _ in range(40):
            start, goals = RNG.randrange(len(names)), set(RNG.sample(range(len(names)), RNG.choice([1, 1, 3])))
            all_costs = graph.costs(start, factors)
            least = min(all_costs[g] for g in goals)
            for used in ((), bounds):
                cost, path, settled = graph.search(start, goals, factors, used)
                assert cost == pytest.approx(least) if least < math.inf else cost == math.inf and not path
                if path:
                    assert path[0] == start and path[-1] in goals
                    steps = [min(d * factors[k] for j, d, k in graph.out[a] if j == b) for a, b in zip(path, path[1:])]
                    assert sum(steps) == pytest.approx(cost)
                    if used:
                        guided += settled
                    else:
                        plain += settled
    assert guided < 0.6 * plain


def test_routes_with_and_without_landmarks(spark):
    RNG.seed(9)
    rows, ways, asked = [], [], []
    for scan in ("a", "b"):
        names, edges = building(3, 8)
        for k, n in enumerate(names):
            f, x, y = map(int, n.split("-")) if n != "alone" else (0, 99, 99)
            rows.append((scan, f, k, n, float(x), float(y), "Room" if n in ("2-7-7", "2-0-7") else "Far" if n == "alone" else None))
        ways += [(scan, *e) for e in edges]
        asked += [(scan, k, 0, float(k % 8), 0.3, "Room", wish) for k, wish in enumerate(list(routing.FACTORS) * 5)]
        asked += [(scan, 50, 0, 0.0, 0.0, "Far", "SHORTEST"), (scan, 51, 9, 0.0, 0.0, "Room", "SHORTEST"), (scan, 52, 0, 0.0, 0.0, "None", "SHORTEST"), (scan, 53, 0, None, 0.0, "Room", "SHORTEST"), (scan, 54, 0, 0.0, 0.0, None, "SHORTEST"), (scan, 55, 2, 7.0, 7.0, "Room", None)]
    asked += [("nowhere", 1, 0, 0.0, 0.0, "Room", "SHORTEST")]
    nodes, edges, requests = spark.createDataFrame(rows, NODES).repartition(3), spark.createDataFrame(ways, EDGES).repartition(3), spark.createDataFrame(asked, ASKED)
    bounds = routing.landmarks(nodes, edges)
    plain = {(r.scan_id, r.request_id): r for r in routing.routes(requests, nodes, edges).collect()}
    guided = {(r.scan_id, r.request_id): r for r in routing.routes(requests, nodes, edges, bounds).collect()}
    assert len(plain) == len(guided) == len(asked)
    for k, r in plain.items():
        assert guided[k].error == r.error and (r.cost is None or guided[k].cost == pytest.approx(r.cost))
    assert sum(r.settled for r in guided.values()) < 0.7 * sum(r.settled for r in plain.values())
    for scan in ("a", "b"):
        assert [guided[scan, k].error for k in range(50, 56)] == ["NO_PATH_AVAILABLE", "GRAPH_NOT_BUILT", "DESTINATION_NOT_FOUND", "GRAPH_NOT_BUILT", "POI_NOT_FOUND", None]
        assert guided[scan, 55].cost == 0 and guided[scan, 55].path == ["2-7-7"]
    assert guided["nowhere", 1].error == "GRAPH_NOT_BUILT"
    assert routing.routes(requests.limit(0), nodes, edges).count() == 0


def test_costs_that_come_out_the_same_are_computed_once(monkeypatch):
    names = [f"n{k}" for k in range(12)]
    way = [(a, b, 1.0 + k / 7, "HORIZONTAL", True) for k, (a, b) in enumerate(zip(names, names[1:]))]
    runs, real = [], routing.Graph.cheapest
    monkeypatch.setattr(routing.Graph, "cheapest", lambda self, *a: runs.append(a) or real(self, *a))
    for extra, most in ((("n0", "n7", 2.0, "HORIZONTAL", True), 1), (("n0", "n7", 2.0, "VERTICAL_ELEVATOR", True), 3), (("n0", "n7", 2.0, "VERTICAL_ELEVATOR", False), 6)):
        graph = routing.Graph(names, [*way, extra])
        runs.clear()
        for wish in routing.FACTORS:
            for back in (False, True):
                assert graph.costs(3, routing.all_factors(wish), back) == real(graph, 3, routing.all_factors(wish), back)
        assert len(runs) == most
