"""Routing graphs. Points are (scan_id, floor_level, seq, x, y, z) in order."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.geometry import angle, distance, minus
from .cleaning import by, here, shifted
from .floors import ENDS
from .grouped import CHUNK, Answer, chosen_apart, chunked, dealt, in_groups
from .keeping import kept

FLOOR = ("scan_id", "floor_level")
NODE_SCHEMA = "scan_id long, floor_level int, original_index long, x double, y double, z double, type string, angle_change double, merged_count int"


def junction_turns(points: DataFrame, least: float = 45.0, margin: int = 3, keys: tuple[str, ...] = FLOOR) -> DataFrame:
    """G1: points with `turn`, and `junction` where it is at least 45 degrees with three points on either side."""
    w, whole = by(keys), Window.partitionBy(*keys)
    n = F.count("*").over(whole)
    p = points.withColumn("turn", angle(minus(here(), shifted(-1, w)), minus(shifted(1, w), here())))
    inside = (n >= 5) & (F.col("seq") >= margin) & (F.col("seq") < n - margin)
    return p.withColumn("junction", F.coalesce(inside & (F.col("turn") >= least), F.lit(False)))


def merged_junctions(turns: DataFrame, near: float = 1.5, chunk: int = CHUNK) -> DataFrame:
    """Of the junctions of junction_turns the first of each group (floor, seq), with the group's largest turn and number.

    In order, a junction that no earlier seed is nearer to than `near` is a seed; the others belong to their earliest seed so near. Both are joins
    over cells; no task holds more than `chunk` junctions of a floor.
    """
    found = kept(turns.filter("junction").select(*FLOOR, "seq", "x", "y", "z", "turn"))
    just_under = float(np.nextafter(near, 0.0))
    seeds = chosen_apart(found, just_under, FLOOR, chunk)
    cell = lambda c: F.floor(F.col(c) / near)
    at = seeds.select(*FLOOR, F.col("seq").alias("_seed"), *(F.col(c).alias(f"_{c}") for c in "xyz"), *(cell(c).alias(f"_c{c}") for c in "xyz"))
    asked = found
    for c in "xyz":
        asked = asked.withColumn(f"_c{c}", F.explode(F.sequence(cell(c) - 1, cell(c) + 1)))
    met = asked.join(at, [*FLOOR, "_cx", "_cy", "_cz"]).filter((distance(here(), [F.col(f"_{c}") for c in "xyz"]) <= just_under) & (F.col("_seed") <= F.col("seq")))
    first = met.groupBy(*FLOOR, "seq").agg(F.min("_seed").alias("_seed"), F.first("turn").alias("turn"))
    return first.groupBy(*FLOOR, F.col("_seed").alias("seq")).agg(F.max("turn").alias("angle_change"), F.count("*").cast("int").alias("merged_count"))


def path_nodes(points: DataFrame, spacing: float = 1.0, near: float = 1.5, chunk: int = CHUNK) -> DataFrame:
    """Junctions merged around the first of each group, ends, and waypoints `spacing` from the last node."""
    return placed_nodes(points, spacing, near, chunk).drop("way")


def placed_nodes(points: DataFrame, spacing: float = 1.0, near: float = 1.5, chunk: int = CHUNK) -> DataFrame:
    """path_nodes with `way`, how far along the path each lies.

    A floor of up to `chunk` points is gone through in one task, junctions and all, and points are dealt once. On larger ones junctions are merged by
    joins, and as which points are nodes depends on the last node only, such a floor is gone through in rounds of `chunk` points, each of which starts
    from the last node of the rounds before: no task holds more of a floor.
    """
    whole = Window.partitionBy(*FLOOR)
    turns = junction_turns(dealt(points, FLOOR)).withColumn("_d", F.coalesce(distance(here(), shifted(-1, by(FLOOR))), F.lit(0.0)))
    turns = turns.withColumns({"way": F.sum("_d").over(by(FLOOR).rowsBetween(Window.unboundedPreceding, 0)), "_n": F.count("*").over(whole)})
    turns = turns.select(*FLOOR, "seq", "x", "y", "z", "turn", "way", "junction", "_n")
    schema = T.StructType([*(points.schema[k] for k in FLOOR), *T.StructType.fromDDL(NODE_SCHEMA).fields[len(FLOOR) :], T.StructField("way", T.DoubleType())])

    def answer(seq: np.ndarray, p: list[list[float]], way: np.ndarray, merged: dict[int, tuple[float, int]], ends: set[int], last: list[float] | None) -> list[Answer] | None:
        places, kinds = [], []
        for i, at in enumerate(p):
            kind = "ENDPOINT" if i in ends else "JUNCTION" if i in merged else "WAYPOINT" if last is not None and math.dist(at, last) >= spacing else None
            if kind:
                places.append(i)
                kinds.append(kind)
                last = at
        if not places:
            return None
        of = [merged[i] if kind == "JUNCTION" else (None, None) for i, kind in zip(places, kinds)]
        return [seq[places], *([p[i][c] for i in places] for c in range(3)), kinds, [a for a, _ in of], [n for _, n in of], way[places]]

    def at_once(key: tuple, columns: list[np.ndarray]) -> list[Answer] | None:
        seq, p, turn, way, junction = columns[0], np.stack(columns[1:4], axis=1).astype(float).tolist(), columns[4], columns[5], columns[6]
        return answer(seq, p, way, merged_at_once(p, turn, np.flatnonzero(junction).tolist(), near), {0, len(p) - 1}, None) if len(p) > 1 else None

    few = in_groups(turns.filter(F.col("_n") <= chunk).drop("_n"), FLOOR, "seq", at_once, schema, as_dealt=True, keyed=True)
    if points.groupBy(*FLOOR).count().filter(F.col("count") > chunk).isEmpty():
        nodes = few
    else:
        nodes = few.unionByName(nodes_in_rounds(turns.filter(F.col("_n") > chunk).drop("_n"), near, chunk, answer, schema))
    return nodes.withColumn("node_id", F.sha2(F.concat_ws(":", *FLOOR, "original_index"), 256))


def merged_at_once(p: list[list[float]], turn: np.ndarray, junctions: list[int], near: float) -> dict[int, tuple[float, int]]:
    """merged_junctions of one floor: the place of each seed with the largest turn of its group and their number. Seeds are found by cells as wide as `near`."""
    groups: dict[int, tuple[float, int]] = {}
    grid: dict[tuple[int, ...], list[int]] = {}
    for j in junctions:
        at = p[j]
        cell = [math.floor(v / near) for v in at]
        met = (s for a in (-1, 0, 1) for b in (-1, 0, 1) for c in (-1, 0, 1) for s in grid.get((cell[0] + a, cell[1] + b, cell[2] + c), ()) if apart(p[s], at) < near) if grid else ()
        seed = min(met, default=j)
        if seed == j:
            grid.setdefault(tuple(cell), []).append(j)
        largest, n = groups.get(seed, (-math.inf, 0))
        groups[seed] = max(largest, float(turn[j])), n + 1
    return groups


def apart(a: list[float], b: list[float]) -> float:
    """The distance as Spark's columns compute it."""
    x, y, z = a[0] - b[0], a[1] - b[1], a[2] - b[2]
    return math.sqrt(x * x + y * y + z * z)


def nodes_in_rounds(turns: DataFrame, near: float, chunk: int, answer: Callable[..., list[Answer] | None], schema: T.StructType) -> DataFrame:
    """placed_nodes' way for floors of more than `chunk` points."""
    turns = kept(turns)
    whole = Window.partitionBy(*FLOOR)
    rows = turns.drop("junction").join(merged_junctions(turns, near, chunk), [*FLOOR, "seq"], "left")
    rows = rows.withColumns({"_end": (F.col("seq") == F.min("seq").over(whole)) | (F.col("seq") == F.max("seq").over(whole)), "_many": F.min("seq").over(whole) != F.max("seq").over(whole)}).filter("_many").drop("_many")
    rows, rounds = chunked(rows, FLOOR, chunk)

    def run(key: tuple, columns: list[np.ndarray]) -> list[Answer] | None:
        seq, p, turn, way, merged, ends = columns[0], np.stack(columns[1:4], axis=1).astype(float).tolist(), columns[4].astype(float), columns[5].astype(float), columns[7].astype(float), columns[8]
        angles, last = columns[6].astype(float), [float(columns[9 + k][0]) for k in range(3)]
        groups = {i: (float(angles[i]), int(merged[i])) for i in np.flatnonzero(merged > 0).tolist()}
        return answer(seq, p, way, groups, set(np.flatnonzero(ends).tolist()), None if math.isnan(last[0]) else last)

    nodes = None
    wide = ["seq", "x", "y", "z", "turn", "way", "angle_change", "merged_count", "_end"]
    for k in range(rounds):
        now = rows.filter(F.col("_chunk") == k).select(*FLOOR, *wide)
        lasts = [f"_l{c}" for c in "xyz"]
        if nodes is None:
            now = now.withColumns({c: F.lit(None).cast("double") for c in lasts})
        else:
            last = nodes.groupBy(*FLOOR).agg(F.max_by(F.struct(*(F.col(c).alias(f"_l{c}") for c in "xyz")), "original_index").alias("_l")).select(*FLOOR, "_l.*")
            now = now.join(last, list(FLOOR))
        new = kept(in_groups(now.select(*FLOOR, *wide, *lasts), FLOOR, "seq", run, schema, keyed=True))
        nodes = new if nodes is None else nodes.unionByName(new)
    return nodes


def path_edges(points: DataFrame, nodes: DataFrame, longest: float = 3.0) -> DataFrame:
    """Neighbours along the path whose way along it is at most `longest`."""
    return edges_along(nodes.join(along(points), [*FLOOR, "original_index"]), longest)


def edges_along(placed: DataFrame, longest: float = 3.0) -> DataFrame:
    """path_edges of placed_nodes' nodes."""
    w = Window.partitionBy(*FLOOR).orderBy("original_index")
    e = placed.select(*FLOOR, F.col("node_id").alias("from_node"), F.lead("node_id").over(w).alias("to_node"), (F.lead("way").over(w) - F.col("way")).alias("distance"))
    return e.filter(F.col("distance") <= longest).withColumns({"edge_type": F.lit("HORIZONTAL"), "bidirectional": F.lit(True)})


def along(points: DataFrame) -> DataFrame:
    """The way from the first point to each."""
    p = points.withColumn("_d", F.coalesce(distance(here(), shifted(-1, by(FLOOR))), F.lit(0.0)))
    return p.select(*FLOOR, F.col("seq").alias("original_index"), F.sum("_d").over(by(FLOOR).rowsBetween(Window.unboundedPreceding, 0)).alias("way"))


#: A floor of up to this many nodes is compared whole.
FEW = 128


def nearest_node(places: DataFrame, nodes: DataFrame, keep: list[str], few: int = FEW) -> DataFrame:
    """For places (*keep, scan_id, floor_level, px, py, pz) the nearest node of their floor, the first of equals.

    A floor of up to `few` nodes comes to its places as one array, so that a place travels as one row. On others places go by cells.

    Such a floor's nodes lie in cells of the plane, of about one node each at level 0 and four times as wide at each level above, up to
    one for all. A place is first compared with one node of each of the nine cells around it at every level, which bounds its
    distance; then with all nodes of the nine cells at the level whose cells are as wide as what the bound leaves. A place outside the
    nodes' box looks around the box's nearest point c: as the box is convex, a node at r from c is at least sqrt(|p - c|^2 + r^2) from p, so
    far places cost no more than others. Two joins, whatever the places. Positions that are not finite are near nothing;
    where distances overflow, all are infinite and equal.
    """
    def finite(names: str):
        return F.forall(F.array(*names.split()), lambda v: F.coalesce(F.abs(v) < math.inf, F.lit(False)))

    span = [F.max(c) - F.min(c) for c in "xy"]
    at = nodes.select(*FLOOR, "node_id", "original_index", "x", "y", "z").filter(finite("x y z"))
    side = F.greatest(F.sqrt(span[0] * span[1] / F.count("*")), span[0] / F.count("*"), span[1] / F.count("*"))
    box = [e for c in "xyz" for e in (F.min(c).alias(f"_low_{c}"), F.max(c).alias(f"_high_{c}"))]
    grid = at.groupBy(*FLOOR).agg(*box, F.count("*").alias("_n"), F.when(side > 1e-6, side).otherwise(1.0).alias("_side"), F.greatest(*span).alias("_span"))
    grid = grid.withColumn("_top", F.greatest(F.ceil(F.log(F.greatest(F.col("_span") / F.col("_side"), F.lit(1.0))) / math.log(4)) + 1, F.lit(1)).cast("int")).drop("_span")
    grid = kept(grid)
    many = grid.filter(F.col("_n") > few).drop("_n")
    place = list(dict.fromkeys([*keep, *FLOOR, "px", "py", "pz"]))
    where = places.select(*place).filter(finite("px py pz"))
    whole = at.join(grid.filter(F.col("_n") <= few).select(*FLOOR), list(FLOOR)).groupBy(*FLOOR).agg(F.collect_list(F.struct("original_index", "node_id", "x", "y", "z")).alias("_nodes"))
    p = [F.col("px"), F.col("py"), F.col("pz")]
    close = F.array_min(F.transform("_nodes", lambda n: F.struct(distance(p, [n[c] for c in "xyz"]).alias("d"), n["original_index"].alias("original_index"), n["node_id"].alias("node_id"))))
    candidates = where.join(whole, list(FLOOR)).select(*keep, close.alias("best"))
    if not many.isEmpty():
        candidates = candidates.unionByName(nearest_by_cells(where.distinct(), at, many, keep, place))
    best = candidates.groupBy(*keep).agg(F.min("best").alias("best"))
    return best.select(*keep, F.col("best.node_id").alias("node_id"), F.col("best.d").alias("distance"))


def nearest_by_cells(places: DataFrame, at: DataFrame, grid: DataFrame, keep: list[str], place: list[str]) -> DataFrame:
    """nearest_node's way for floors of many nodes, of which grid has the boxes, cells and levels: (*keep, best: d, original_index, node_id)."""
    def cell(c: str, of: str):
        return F.floor((F.col(c) - F.col(f"_low_{of}")) / (F.col("_side") * F.pow(F.lit(4.0), F.col("_k"))))

    def around(rows: DataFrame) -> DataFrame:
        for c, to in (("_qx", "_cx"), ("_qy", "_cy")):
            rows = rows.select("*", F.explode(F.sequence(cell(c, c[-1]) - 1, cell(c, c[-1]) + 1)).alias(to))
        return rows

    layers = at.join(grid, list(FLOOR)).withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_top"))))
    layers = kept(layers.select(*FLOOR, "_k", cell("x", "x").alias("_cx"), cell("y", "y").alias("_cy"), "node_id", "original_index", "x", "y", "z"))
    of_cell = [*FLOOR, "_k", "_cx", "_cy"]
    first = layers.groupBy(*of_cell).agg(F.min(F.struct("original_index", "node_id", "x", "y", "z")).alias("_n")).select(*of_cell, "_n.x", "_n.y", "_n.z")

    asked = places.join(grid, list(FLOOR))
    asked = asked.withColumns({f"_q{c}": F.greatest(f"_low_{c}", F.least(f"_high_{c}", f"p{c}")) for c in "xyz"})
    asked = kept(asked.withColumns({"_out": distance([F.col(f"p{c}") for c in "xyz"], [F.col(f"_q{c}") for c in "xyz"])}))
    d = distance([F.col("px"), F.col("py"), F.col("pz")], here())
    rough = around(asked.withColumn("_k", F.explode(F.sequence(F.lit(0), F.col("_top"))))).join(first, of_cell).groupBy(*place, "_out", "_side", "_top", "_qx", "_qy", "_low_x", "_low_y").agg(F.min(d).alias("_d"))
    # how far from c a node can be that is nearer; rounding errors of the squares come on top
    left = F.when(F.col("_d") < 1e150, F.sqrt((F.col("_d") - F.col("_out")) * (F.col("_d") + F.col("_out")) * (1 + 1e-9) + F.col("_d") * F.col("_d") * 1e-14)).otherwise(math.inf)
    level = F.when(left <= F.col("_side"), 0).when(left >= F.col("_side") * F.pow(F.lit(4.0), F.col("_top")), F.col("_top")).otherwise(F.least(F.ceil(F.log(left / F.col("_side")) / math.log(4) + 1e-9), F.col("_top"))).cast("int")
    found = around(rough.withColumn("_k", level)).join(layers, of_cell)
    return found.groupBy(*keep).agg(F.min(F.struct(d.alias("d"), "original_index", "node_id")).alias("best"))


def vertical_edges(passages: DataFrame, nodes: DataFrame, points: DataFrame | None = None) -> DataFrame:
    """An edge between the nodes nearest a passage's entry and exit, from a node to itself too where both are nearest to it.

    Passages carry no entry and exit unless they were measured with them or `points` (the scan's) are given to take them from.
    """
    keep = ["scan_id", "start_idx", "z_displacement", "type"]
    sides = ((False, "from_floor", "entry", F.col("start_idx")), (True, "to_floor", "exit", F.col("end_idx") - 1))
    if set(ENDS) <= set(passages.columns):
        places = [passages.select(*keep, F.lit(to).alias("_to"), F.col(level).alias("floor_level"), *(F.col(f"{end}_{c}").alias(f"p{c}") for c in "xyz")) for to, level, end, _ in sides]
        places = places[0].unionByName(places[1])
    elif points is not None:
        at = points.select("scan_id", F.col("seq"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
        places = [passages.withColumns({"seq": seq, "floor_level": F.col(level), "_to": F.lit(to)}) for to, level, _, seq in sides]
        places = places[0].unionByName(places[1]).join(at, ["scan_id", "seq"]).select(*keep, "_to", "floor_level", "px", "py", "pz")
    else:
        return path_edges_empty(nodes)
    near = nearest_node(places, nodes, [*keep, "_to"])
    both = near.groupBy(*keep).agg(*(F.max(F.when(F.col("_to") == to, F.col("node_id"))).alias(n) for to, n in ((False, "from_node"), (True, "to_node")))).filter("from_node IS NOT NULL AND to_node IS NOT NULL")
    return both.select("scan_id", F.lit(None).cast("int").alias("floor_level"), "from_node", "to_node", F.coalesce("z_displacement", F.lit(3.0)).alias("distance"), F.concat(F.lit("VERTICAL_"), "type").alias("edge_type"), F.lit(True).alias("bidirectional"))


def path_edges_empty(nodes: DataFrame) -> DataFrame:
    return nodes.limit(0).select("scan_id", "floor_level", F.col("node_id").alias("from_node"), F.col("node_id").alias("to_node"), F.lit(0.0).alias("distance"), F.lit("").alias("edge_type"), F.lit(True).alias("bidirectional"))


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """G7."""
    n = nodes.groupBy("scan_id").agg(F.count("*").alias("total_nodes"), *(F.sum((F.col("type") == t).cast("long")).alias(f"{t.lower()}_count") for t in ("JUNCTION", "ENDPOINT", "WAYPOINT")))
    e = edges.groupBy("scan_id").agg(F.count("*").alias("total_edges"), F.sum("distance").alias("total_distance"), F.avg("distance").alias("average_edge_length"))
    return n.join(e, "scan_id", "left").fillna(0)


def dead_ends(edges: DataFrame) -> DataFrame:
    """Nodes of degree one; an edge of one direction counts for its source only."""
    ends = edges.select("scan_id", F.explode(F.when(F.col("bidirectional"), F.array("from_node", "to_node")).otherwise(F.array("from_node"))).alias("node_id"))
    return ends.groupBy("scan_id", "node_id").count().filter("count = 1").drop("count")
