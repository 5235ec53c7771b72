"""Cheapest routes by A* with landmark bounds, all scans in one stream of groups.

Landmarks are a few nodes of each scan's graph far from each other; `landmarks` computes once what every node's way from and to them costs, by
preference, and the table is stored with the graph. By the triangle inequality the cost from v to t is at least cost(L, t) - cost(L, v) and at least
cost(v, L) - cost(t, L). A* that looks at nodes by cost so far plus the best of these bounds finds the cheapest route, as Dijkstra's method does,
and settles fewer nodes. A straight line's length would be no bound, as lifts count less than their length. Without the table all bounds are 0.

A task holds one scan's graph at a time: nodes, edges, bounds and requests come sorted, as rows of one stream.

Defined cases: an edge whose nodes are unknown is left out; of nodes equally near in the plane the first by floor and place on the path is the start; of several nodes of
one name the cheapest to reach is the goal; a start that is a goal costs 0; a preference that is unknown counts as SHORTEST; null coordinates are near nothing
and give GRAPH_NOT_BUILT.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .grouped import in_groups, pa_type

#: What an edge's length counts by preference, for lifts and stairs.
FACTORS = {"SHORTEST": (1.0, 1.0), "ELEVATOR_FIRST": (0.5, 2.0), "STAIRCASE_FIRST": (2.0, 0.8)}
KINDS = {"VERTICAL_ELEVATOR": 0, "VERTICAL_STAIRCASE": 1}
LANDMARKS = 4
NEVER = math.inf
#: Rows of the stream: nodes, edges, bounds, requests.
NODE, EDGE, BOUND, REQUEST = range(4)
COLUMNS = "kind int, place long, a string, b string, floor int, x double, y double, name string, wish string, d double, e double, two boolean"


class Graph:
    """One scan's nodes by number, in the order of floor and place, and its edges both ways."""

    def __init__(self, names: Sequence[str], edges: Sequence[tuple[str, str, float, str, bool]]):
        self.names, self.number = names, {n: k for k, n in enumerate(names)}
        self.out: list[list[tuple[int, float, int]]] = [[] for _ in names]
        self.back: list[list[tuple[int, float, int]]] = [[] for _ in names]
        # whether every edge goes both ways, the kinds of edges, and costs already found
        self.even, self.present, self.found = True, set(), {}
        for a, b, d, kind, two in edges:
            i, j = self.number.get(a), self.number.get(b)
            if i is None or j is None:
                continue
            k = KINDS.get(kind, 2)
            self.out[i].append((j, d, k))
            self.back[j].append((i, d, k))
            self.present.add(k)
            if two:
                self.out[j].append((i, d, k))
                self.back[i].append((j, d, k))
            else:
                self.even = False

    def costs(self, start: int, factors: tuple[float, float, float], back: bool = False) -> list[float]:
        """What the cheapest way from start to each node costs; with back from each node to start.

        Ways there are ways back where every edge goes both ways, and preferences differ only where there are lifts or stairs: what
        comes out the same is computed once.
        """
        same = (start, back and not self.even, *(f for k, f in enumerate(factors) if k in self.present))
        if same not in self.found:
            self.found[same] = self.cheapest(start, factors, same[1])
        return self.found[same]

    def cheapest(self, start: int, factors: tuple[float, float, float], back: bool) -> list[float]:
        ways, best = self.back if back else self.out, [NEVER] * len(self.names)
        best[start] = 0.0
        heap = [(0.0, start)]
        while heap:
            c, i = heapq.heappop(heap)
            if c > best[i]:
                continue
            for j, d, k in ways[i]:
                new = c + d * factors[k]
                if new < best[j]:
                    best[j] = new
                    heapq.heappush(heap, (new, j))
        return best

    def search(self, start: int, goals: set[int], factors: tuple[float, float, float], bounds: list[tuple[list[float], list[float]]] = ()) -> tuple[float, list[int], int]:
        """(cost, nodes of the route, nodes settled) to the cheapest of goals; an infinite cost without a route."""
        least: dict[int, float] = {}

        def left(i: int) -> float:
            got = least.get(i)
            if got is None:
                got = NEVER
                for t in goals:
                    low = 0.0
                    for come, go in bounds:
                        if come[i] < NEVER:
                            low = max(low, come[t] - come[i])
                        if go[t] < NEVER:
                            low = max(low, go[i] - go[t])
                    got = min(got, low)
                # a hair less, so that rounding makes it no more than the truth
                least[i] = got = max(0.0, got * (1 - 1e-12) - 1e-12) if got < NEVER else NEVER
            return got

        best, came, settled = {start: 0.0}, {}, 0
        heap = [(left(start), 0.0, start)]
        while heap:
            whole, c, i = heapq.heappop(heap)
            if c > best[i] or whole == NEVER:
                continue
            settled += 1
            if i in goals:
                path = [i]
                while path[-1] in came:
                    path.append(came[path[-1]])
                return c, path[::-1], settled
            for j, d, k in self.out[i]:
                new = c + d * factors[k]
                if new < best.get(j, NEVER):
                    best[j], came[j] = new, i
                    heapq.heappush(heap, (new + left(j), new, j))
        return NEVER, [], settled

    def far_apart(self, count: int) -> list[int]:
        """Nodes far from each other, each the one that is farthest from those before; parts without a way between them come first."""
        near, chosen = [NEVER] * len(self.names), []
        while len(chosen) < min(count, len(self.names)):
            at = max(range(len(near)), key=near.__getitem__)
            if near[at] == 0:
                break
            chosen.append(at)
            for way in (self.costs(at, (1.0, 1.0, 1.0)), self.costs(at, (1.0, 1.0, 1.0), True)):
                near = [min(a, b) for a, b in zip(near, way)]
        return chosen


def typed(rows: DataFrame, **columns) -> DataFrame:
    """scan_id and the stream's columns, null where not given."""
    fields = T.StructType.fromDDL(COLUMNS).fields
    return rows.select("scan_id", *((columns[f.name] if f.name in columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in fields))


def graph_rows(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    name = F.col("poi_name") if "poi_name" in nodes.columns else F.lit(None)
    found = typed(nodes, kind=F.lit(NODE), place=F.col("original_index"), a=F.col("node_id"), floor=F.col("floor_level"), x=F.col("x"), y=F.col("y"), name=name)
    return found.unionByName(typed(edges, kind=F.lit(EDGE), a=F.col("from_node"), b=F.col("to_node"), name=F.col("edge_type"), d=F.col("distance"), two=F.col("bidirectional")))


def graph_of(columns: list[np.ndarray]) -> tuple[Graph, dict[str, np.ndarray], dict[str, np.ndarray]]:
    """The graph of one scan's columns, its nodes (by floor and place) and its requests."""
    c = dict(zip((column.split()[0] for column in COLUMNS.split(", ")), columns))
    of = {k: np.flatnonzero(c["kind"] == k) for k in range(4)}
    at = of[NODE]
    at = at[np.lexsort((c["place"][at].astype(float), c["floor"][at].astype(float)))]
    nodes = {k: c[k][at] for k in ("a", "floor", "x", "y", "name")}
    e = of[EDGE]
    graph = Graph(nodes["a"].tolist(), list(zip(c["a"][e], c["b"][e], c["d"][e].astype(float).tolist(), c["name"][e], c["two"][e])))
    return graph, nodes, {"bounds": {k: c[k][of[BOUND]] for k in ("place", "a", "wish", "d", "e")}, "asked": {k: c[k][of[REQUEST]] for k in ("place", "floor", "x", "y", "name", "wish")}}


def all_factors(wish: str) -> tuple[float, float, float]:
    return (*FACTORS.get(wish, (1.0, 1.0)), 1.0)


def landmarks(nodes: DataFrame, edges: DataFrame, count: int = LANDMARKS) -> DataFrame:
    """(scan_id, landmark, preference, node_id, cost_from, cost_to): what the way from and to each landmark costs; null where there is none."""
    kind = nodes.schema["scan_id"].dataType
    id_type = pa_type(kind)
    schema = T.StructType([T.StructField("scan_id", kind), *T.StructType.fromDDL("landmark int, preference string, node_id string, cost_from double, cost_to double").fields])

    def run(key: tuple, columns: list[np.ndarray]) -> list[pa.Array] | None:
        graph, _, _ = graph_of(columns)
        parts = []
        for n, at in enumerate(graph.far_apart(count)):
            for wish in FACTORS:
                both = [np.array(graph.costs(at, all_factors(wish), back)) for back in (False, True)]
                parts.append((n, wish, both))
        if not parts:
            return None
        size = len(graph.names)
        costs = [np.concatenate([p[2][k] for p in parts]) for k in range(2)]
        return [
            pa.array([key[0]] * (size * len(parts)), id_type), pa.array(np.repeat(np.array([p[0] for p in parts], np.int32), size)), pa.array([p[1] for p in parts for _ in range(size)]),
            pa.array(list(graph.names) * len(parts)), *(pa.array(c, mask=np.isinf(c)) for c in costs),
        ]

    return in_groups(graph_rows(nodes, edges), ["scan_id"], "kind", run, schema)


def routes(requests: DataFrame, nodes: DataFrame, edges: DataFrame, bounds: DataFrame | None = None) -> DataFrame:
    """(scan_id, request_id, cost, path, error, settled) for each request (scan_id, request_id, floor_level, x, y, destination, preference).

    nodes may have poi_name; bounds is the table of `landmarks`. A request without an answer gets GRAPH_NOT_BUILT (no node on its floor),
    POI_NOT_FOUND (no destination asked for, or a scan without any named place), DESTINATION_NOT_FOUND or NO_PATH_AVAILABLE.
    """
    rows = graph_rows(nodes, edges).join(requests.select("scan_id").distinct(), "scan_id", "left_semi")
    if bounds is not None:
        rows = rows.unionByName(typed(bounds.join(requests.select("scan_id").distinct(), "scan_id", "left_semi"), kind=F.lit(BOUND), place=F.col("landmark"), a=F.col("node_id"), wish=F.col("preference"), d=F.col("cost_from"), e=F.col("cost_to")))
    rows = rows.unionByName(typed(requests, kind=F.lit(REQUEST), place=F.col("request_id"), floor=F.col("floor_level"), x=F.col("x"), y=F.col("y"), name=F.col("destination"), wish=F.col("preference")))
    kind = requests.schema["scan_id"].dataType
    id_type = pa_type(kind)
    schema = T.StructType([T.StructField("scan_id", kind), *T.StructType.fromDDL("request_id long, cost double, path array<string>, error string, settled long").fields])

    def run(key: tuple, columns: list[np.ndarray]) -> list[pa.Array] | None:
        graph, on, rest = graph_of(columns)
        asked, known = rest["asked"], rest["bounds"]
        if not len(asked["place"]):
            return None
        tables: dict[str, list] = {}
        for wish in set(known["wish"]):
            mine = known["wish"] == wish
            found = []
            for n in sorted(set(known["place"][mine])):
                of = np.flatnonzero(mine & (known["place"] == n))
                at = np.array([graph.number.get(node, -1) for node in known["a"][of]], np.int64)
                pair = []
                for name in ("d", "e"):
                    cost, side = known[name][of].astype(float), np.full(len(graph.names), NEVER)
                    there = (at >= 0) & ~np.isnan(cost)
                    side[at[there]] = cost[there]
                    pair.append(side.tolist())
                found.append(tuple(pair))
            tables[wish] = found
        named: dict[str, set[int]] = {}
        for k, name in enumerate(on["name"]):
            if name is not None:
                named.setdefault(name, set()).add(k)
        floors, x, y = on["floor"].astype(float), on["x"].astype(float), on["y"].astype(float)
        out = []
        for place, floor, px, py, name, wish in zip(*(asked[k] for k in ("place", "floor", "x", "y", "name", "wish"))):
            here = np.flatnonzero(floors == floor) if floor is not None else np.zeros(0, int)
            off = np.hypot(x[here] - float(px if px is not None else math.nan), y[here] - float(py if py is not None else math.nan))
            if not len(here) or np.isnan(off).all():
                out.append((place, None, None, "GRAPH_NOT_BUILT", 0))
            elif name not in named:
                out.append((place, None, None, "POI_NOT_FOUND" if name is None or not named else "DESTINATION_NOT_FOUND", 0))
            else:
                cost, path, settled = graph.search(int(here[np.nanargmin(off)]), named[name], all_factors(wish), tables.get(wish, ()))
                out.append((place, cost, [graph.names[k] for k in path], None, settled) if path else (place, None, None, "NO_PATH_AVAILABLE", settled))
        kinds = [pa.int64(), pa.float64(), pa.list_(pa.string()), pa.string(), pa.int64()]
        return [pa.array([key[0]] * len(out), id_type), *(pa.array([r[k] for r in out], t) for k, t in enumerate(kinds))]

    return in_groups(rows, ["scan_id"], "kind", run, schema)
