"""Column functions over points, directions, graph edges and nodes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AXES = ("x", "y", "z")


def length(parts: list[Column]) -> Column:
    return F.sqrt(sum((p * p for p in parts[1:]), parts[0] * parts[0]))


def minus(a: list[Column], b: list[Column]) -> list[Column]:
    return [p - q for p, q in zip(a, b)]


def dot(a: list[Column], b: list[Column]) -> Column:
    return sum((p * q for p, q in zip(a[1:], b[1:])), a[0] * b[0])


def distance(a: list[Column], b: list[Column]) -> Column:
    """M1; with two axes M2's distance in the plane, with one the distance in height."""
    return length(minus(a, b))


def angle(a: list[Column], b: list[Column]) -> Column:
    """M3: degrees between two directions; 0 if either is shorter than 1e-10, null if either is."""
    na, nb = length(a), length(b)
    short = (na < 1e-10) | (nb < 1e-10)
    cosine = dot(a, b) / F.when(short, 1.0).otherwise(na * nb)
    return F.when(short, 0.0).when(cosine.isNotNull(), F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine)))))


def line_distance(p: list[Column], start: list[Column], end: list[Column]) -> Column:
    """M4: distance to the infinite line through two points; to the first point if they coincide."""
    line = minus(end, start)
    n = length(line)
    unit = [c / F.when(n < 1e-10, 1.0).otherwise(n) for c in line]
    off = minus(p, start)
    along = F.when(n < 1e-10, 0.0).otherwise(dot(off, unit))
    return length([o - along * u for o, u in zip(off, unit)])


def edge_weight(d: Column, edge_type: Column, preference: Column) -> Column:
    """M5: cost of an edge under SHORTEST, ELEVATOR_FIRST or STAIRCASE_FIRST."""
    lift, stairs = edge_type == "VERTICAL_ELEVATOR", edge_type == "VERTICAL_STAIRCASE"
    return (
        F.when((preference == "ELEVATOR_FIRST") & lift, d * 0.5).when((preference == "ELEVATOR_FIRST") & stairs, d * 2.0)
        .when((preference == "STAIRCASE_FIRST") & lift, d * 2.0).when((preference == "STAIRCASE_FIRST") & stairs, d * 0.8).otherwise(d)
    )


def poi_type(node_type: Column, name: Column) -> Column:
    """M6: a node that gets a name that is not blank becomes a POI."""
    return F.when(F.trim(name) != "", "POI").otherwise(node_type)


def cleared_type(node_type: Column) -> Column:
    return F.when(node_type == "POI", "WAYPOINT").otherwise(node_type)


#: Fixed value: what the names of floors above ground end in.
FLOOR_SUFFIX = "층"


def floor_name(level: Column) -> Column:
    """M7: -2 is B2; floors above ground have their number before FLOOR_SUFFIX, and level 0 is named like level 1."""
    return F.when(level < 0, F.format_string("B%d", -level)).otherwise(F.format_string(f"%d{FLOOR_SUFFIX}", F.greatest(level, F.lit(1))))


def point_or_null(x: Column, y: Column, z: Column) -> Column:
    """M8: the point, or null if any coordinate is."""
    return F.when(x.isNotNull() & y.isNotNull() & z.isNotNull(), F.struct(x.alias("x"), y.alias("y"), z.alias("z")))


def updated(new: Column, old: Column) -> Column:
    """M9: a null leaves the old value."""
    return F.coalesce(new, old)


def valid_position(x: Column, y: Column, z: Column, tolerance: float = 1e-6) -> Column:
    """Finite, and not the origin within the tolerance."""
    finite = [~F.isnan(c) & (F.abs(c) < float("inf")) for c in (x, y, z)]
    return F.coalesce(finite[0] & finite[1] & finite[2] & ~((F.abs(x) <= tolerance) & (F.abs(y) <= tolerance) & (F.abs(z) <= tolerance)), F.lit(False))
