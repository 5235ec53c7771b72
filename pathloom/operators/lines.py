"""Lines through points by their principal direction, from sums that Spark adds up: no point leaves the JVM.

Means and sample covariances are aggregated for each group; the largest eigenvalue of the 3 x 3 matrix follows in closed form
(from its trace, the spread of the rest and their determinant), its vector from the cross products of the rows of matrix less eigenvalue. Where the
two largest are equal, a vector of their plane that depends on the matrix only is taken; without variance the x axis. A vector's sign has no meaning.

Defined cases: groups of under three points are not projected, have a share and straightness of 1 and zeros as deviations; a group without
variance has a share of 1; a group with positions that are not finite has no defined line.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES
from .cleaning import KEYS

PAIRS = ("xx", "yy", "zz", "xy", "xz", "yz")


def let(value: Column, *steps) -> Column:
    """The last step's result, each being made of the one before, which is computed once."""
    held = F.array(value)
    for step in steps:
        held = F.transform(held, step)
    return held[0]


def cross(a: Sequence[Column], b: Sequence[Column]) -> list[Column]:
    return [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]


def with_norm(v: Sequence[Column]) -> Column:
    return F.struct(sum((x * x for x in v[1:]), v[0] * v[0]).alias("n"), F.array(*v).alias("v"))


def principal(c: dict[str, Column]) -> Column:
    """struct(v, share): the direction of the largest variance of a covariance matrix, given by its six entries, and its share of the whole (1 without variance)."""
    def rows(t: Column) -> list[list[Column]]:
        return [[t["xx"] - t["top"], t["xy"], t["xz"]], [t["xy"], t["yy"] - t["top"], t["yz"]], [t["xz"], t["yz"], t["zz"] - t["top"]]]

    def keep(t: Column, **more: Column) -> Column:
        return F.struct(*(t[k].alias(k) for k in PAIRS), *(v.alias(k) for k, v in more.items()))

    def spread(t: Column) -> Column:
        q = (t["xx"] + t["yy"] + t["zz"]) / 3
        return keep(t, q=q, p=F.sqrt(((t["xx"] - q) * (t["xx"] - q) + (t["yy"] - q) * (t["yy"] - q) + (t["zz"] - q) * (t["zz"] - q) + 2 * (t["xy"] * t["xy"] + t["xz"] * t["xz"] + t["yz"] * t["yz"])) / 6))

    def largest(t: Column) -> Column:
        p = F.when(t["p"] > 0, t["p"]).otherwise(1.0)
        a, b, d = ((t[k] - t["q"]) / p for k in ("xx", "yy", "zz"))
        e, f, g = (t[k] / p for k in ("xy", "xz", "yz"))
        half = (a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)) / 2
        return keep(t, q=t["q"], top=t["q"] + 2 * t["p"] * F.cos(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), half))) / 3))

    def vector(t: Column) -> Column:
        r = rows(t)
        best = F.array_max(F.array(*(with_norm(cross(r[i], r[j])) for i, j in ((0, 1), (0, 2), (1, 2)))))
        row = F.array_max(F.array(*(with_norm(x) for x in r)))
        return keep(t, q=t["q"], best=best, row=row)

    def unit(t: Column) -> Column:
        whole = 3 * t["q"]
        w = [t["row"]["v"][k] for k in range(3)]
        # across the row, away from the axis that it follows least
        axis = F.when((F.abs(w[0]) <= F.abs(w[1])) & (F.abs(w[0]) <= F.abs(w[2])), F.array(F.lit(0.0), w[2], -w[1])).when(F.abs(w[1]) <= F.abs(w[2]), F.array(-w[2], F.lit(0.0), w[0])).otherwise(F.array(w[1], -w[0], F.lit(0.0)))
        found = F.when(t["best"]["n"] > 1e-24 * whole * whole * whole * whole, t["best"]["v"]).when(t["row"]["n"] > 1e-24 * whole * whole, axis).otherwise(F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0)))
        return keep(t, q=t["q"], v=found)

    def share(t: Column) -> Column:
        v = [t["v"][k] for k in range(3)]
        n = F.sqrt(v[0] * v[0] + v[1] * v[1] + v[2] * v[2])
        along = (v[0] * v[0] * t["xx"] + v[1] * v[1] * t["yy"] + v[2] * v[2] * t["zz"] + 2 * (v[0] * v[1] * t["xy"] + v[0] * v[2] * t["xz"] + v[1] * v[2] * t["yz"])) / (n * n)
        return F.struct(F.transform(t["v"], lambda x: x / n).alias("v"), F.when(3 * t["q"] > 1e-10, along / F.when(3 * t["q"] > 1e-10, 3 * t["q"]).otherwise(1.0)).otherwise(1.0).alias("share"))

    return let(F.struct(*(F.coalesce(c[k], F.lit(0.0)).alias(k) for k in PAIRS)), spread, largest, vector, unit, share)


def fit_lines(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    """for each group its number of points, mean, direction (array) and the share of the variance along it."""
    sums = points.groupBy(*keys).agg(F.count("*").alias("_n"), *(F.avg(c).alias(f"_m{c}") for c in AXES), *(F.covar_samp(a, b).alias(f"_{a}{b}") for a, b in PAIRS))
    line = principal({k: F.col(f"_{k}") for k in PAIRS})
    return sums.select(*keys, "_n", *(f"_m{c}" for c in AXES), line.alias("_line")).select(*keys, "_n", *(f"_m{c}" for c in AXES), F.col("_line.v").alias("_v"), F.col("_line.share").alias("_share"))


def on_line() -> tuple[Column, list[Column]]:
    """A point's place along its group's line, and the point there; of columns as fit_lines names them."""
    t = sum(((F.col(c) - F.col(f"_m{c}")) * F.col("_v")[k] for k, c in enumerate(AXES[1:], 1)), (F.col("x") - F.col("_mx")) * F.col("_v")[0])
    return t, [F.col(f"_m{c}") + t * F.col("_v")[k] for k, c in enumerate(AXES)]


def project(points: DataFrame, keys: Sequence[str] = KEYS, in_order: bool = True) -> DataFrame:
    """each group's points on its line, in the walk's order or in that along the line; groups of under three points as they are."""
    met = points.select(*keys, "seq", *AXES).join(fit_lines(points, keys), list(keys))
    t, at = on_line()
    many = F.col("_n") > 2
    moved = met.select(*keys, "seq", *(F.when(many, to).otherwise(F.col(c)).alias(c) for to, c in zip(at, AXES)), F.when(many, t).alias("_t"))
    if in_order:
        return moved.drop("_t")
    return moved.withColumn("seq", (F.row_number().over(Window.partitionBy(*keys).orderBy("_t", "seq")) - 1).cast("long")).drop("_t")


def straighten_chunks(points: DataFrame, keys: Sequence[str] = KEYS, chunk: int = 20, linear: float = 0.85) -> DataFrame:
    """chunks of points (under three are skipped) projected where their line explains enough."""
    rows = points.select(*keys, "seq", *AXES, F.floor(F.col("seq") / chunk).alias("_chunk"))
    both = [*keys, "_chunk"]
    met = rows.join(fit_lines(rows, both), both)
    _, at = on_line()
    straight = (F.col("_n") > 2) & (F.col("_share") >= linear)
    return met.select(*keys, "seq", *(F.when(straight, to).otherwise(F.col(c)).alias(c) for to, c in zip(at, AXES)))


def line_fit(points: DataFrame, keys: Sequence[str] = KEYS, distances: bool = False) -> DataFrame:
    """Explained share (the straightness), and mean, largest and population sd of the distance from the line; 1 and zeros under three points.

    With distances also each point's, in order; null under three points.
    """
    met = points.select(*keys, "seq", *AXES).join(fit_lines(points, keys), list(keys))
    _, at = on_line()
    off = F.sqrt(sum(((F.col(c) - to) * (F.col(c) - to) for c, to in list(zip(AXES, at))[1:]), (F.col("x") - at[0]) * (F.col("x") - at[0])))
    many = F.col("_n") > 2
    rows = met.select(*keys, "seq", F.when(many, off).otherwise(0.0).alias("_d"), many.alias("_many"), F.when(many, F.col("_share")).otherwise(1.0).alias("_e"))
    parts = [F.max("_e").alias("explained"), F.avg("_d").alias("mean_deviation"), F.max("_d").alias("max_deviation"), F.stddev_pop("_d").alias("std_deviation")]
    if distances:
        listed = F.transform(F.array_sort(F.collect_list(F.struct("seq", "_d"))), lambda r: r["_d"])
        parts.append(F.when(F.max("_many"), listed).alias("distances"))
    return rows.groupBy(*keys).agg(*parts)
