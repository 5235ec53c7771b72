"""Trajectory statistics and windowed cleaning. Rows are (*keys, seq, x, y, z); seq is dense from 0 within the keys."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import AXES, distance, length, minus

KEYS = ("scan_id",)


def here() -> list[Column]:
    return [F.col(c) for c in AXES]


def shifted(n: int, w) -> list[Column]:
    """The point n rows on (behind, if negative)."""
    return [F.lead(c, n).over(w) for c in AXES]


def by(keys: Sequence[str]):
    return Window.partitionBy(*keys).orderBy("seq")


def with_step(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    return points.withColumn("step", distance(here(), shifted(-1, by(keys))))


def trajectory_stats(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """T1 (and T4's total_distance)."""
    bounds = [f(c).alias(f"{c}_{n}") for c in AXES for n, f in (("min", F.min), ("max", F.max))]
    return with_step(points, keys).groupBy(*keys).agg(F.count("*").alias("total_nodes"), *bounds, F.coalesce(F.sum("step"), F.lit(0.0)).alias("total_distance"), F.coalesce(F.avg("step"), F.lit(0.0)).alias("mean_step"))


def percent_text(rate: Column) -> Column:
    """A share from 0 to 1 as a percentage with one decimal."""
    return one_decimal(rate * 100)


def one_decimal(percent: Column) -> Column:
    """A number from 0 to 100 with one decimal and a percent sign, halves to even by its exact binary value, as "%.1f" does in C and Python."""
    whole = F.floor(percent)
    part = ((percent - whole) * (1 << 58)).cast("long")  # exact from 1 / 64 on, and below that nothing is halfway
    tenths = F.shiftright(part * 10, 58)
    left = part * 10 - F.shiftleft(tenths, 58)
    half = F.lit(1 << 57)
    tenths = whole * 10 + tenths + F.when((left > half) | ((left == half) & (tenths % 2 == 1)), 1).otherwise(0)
    return F.concat(F.floor(tenths / 10).cast("string"), F.lit("."), (tenths % 10).cast("string"), F.lit("%"))


def deduplication_stats(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """T2. The text's percentage is 100 times the number removed, divided once: the rate times 100 would be rounded twice, and 23 of 80 would fall below 28.75."""
    n = before.groupBy(*keys).agg(F.count("*").alias("original_count")).join(after.groupBy(*keys).agg(F.count("*").alias("final_count")), list(keys), "left")
    n = n.withColumn("final_count", F.coalesce("final_count", F.lit(0))).withColumn("removed_count", F.col("original_count") - F.col("final_count"))
    rate = F.col("removed_count") / F.col("original_count")
    return n.withColumn("reduction_rate", rate).withColumn("reduction_text", one_decimal(F.col("removed_count") * 100.0 / F.col("original_count")))


def smoothing_stats(before: DataFrame, after: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Displacement of points with one seq, and both path lengths."""
    on = [*keys, "seq"]
    moved = before.select(*on, *AXES).join(after.select(*on, *(F.col(c).alias(f"{c}2") for c in AXES)), on)
    d = moved.groupBy(*keys).agg(*(f(distance(here(), [F.col(f"{c}2") for c in AXES])).alias(n) for n, f in (("mean_displacement", F.avg), ("max_displacement", F.max))))
    for name, points in (("original_length", before), ("smoothed_length", after)):
        d = d.join(with_step(points, keys).groupBy(*keys).agg(F.coalesce(F.sum("step"), F.lit(0.0)).alias(name)), list(keys))
    return d


def scan_overlap(a: DataFrame, b: DataFrame, least: float = 0.5) -> DataFrame:
    """Overlap of two scans' bounding boxes in x and y."""

    def box(points: DataFrame, n: int) -> DataFrame:
        return points.agg(*(f(c).alias(f"{c}_{k}{n}") for c in "xy" for k, f in (("min", F.min), ("max", F.max))))

    both = box(a, 1).crossJoin(box(b, 2))  # two rows of one each
    over = {c: F.greatest(F.lit(0.0), F.least(f"{c}_max1", f"{c}_max2") - F.greatest(f"{c}_min1", f"{c}_min2")) for c in "xy"}
    return both.select(over["x"].alias("overlap_x"), over["y"].alias("overlap_y"), ((over["x"] > least) | (over["y"] > least)).alias("mergeable"))


def remove_outliers(points: DataFrame, k: float = 3.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Interior points beside a step over mean + k sd become the middle of their neighbours as they came in."""
    w, whole = by(keys), Window.partitionBy(*keys)
    p = with_step(points, keys).withColumn("_next", F.lead("step").over(w))
    limit = F.avg("step").over(whole) + F.lit(k) * F.stddev_pop("step").over(whole)
    bad = (F.count("*").over(whole) >= 5) & F.col("step").isNotNull() & F.col("_next").isNotNull() & ((F.col("step") > limit) | (F.col("_next") > limit))
    p = p.withColumns({"_bad": bad, **{f"_{c}": (F.lag(c).over(w) + F.lead(c).over(w)) / 2 for c in AXES}})
    return p.withColumns({c: F.when(F.col("_bad"), F.col(f"_{c}")).otherwise(F.col(c)) for c in AXES}).select(*points.columns)


def split_at_gaps(points: DataFrame, gap: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """`piece` counts the steps over the gap so far; pieces of one point go, unless there is no gap."""
    p = with_step(points, keys).withColumn("piece", F.coalesce(F.sum((F.col("step") > gap).cast("long")).over(by(keys)), F.lit(0)))
    p = p.withColumn("_n", F.count("*").over(Window.partitionBy(*keys, "piece"))).withColumn("_pieces", F.max("piece").over(Window.partitionBy(*keys)))
    return p.filter((F.col("_n") > 1) | (F.col("_pieces") == 0)).drop("_n", "_pieces", "step")


def renumbered(points: DataFrame, keys: Sequence[str]) -> DataFrame:
    return points.withColumn("seq", (F.row_number().over(by(keys)) - 1).cast("long"))


def curvature(points: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """|v1 x v2| / (|v1| |v2|) of the steps before and after; the ends take their neighbour's."""
    w = by(keys)
    p = points.withColumns({f"_{n}{c}": e for n, v in (("a", minus(here(), shifted(-1, w))), ("b", minus(shifted(1, w), here()))) for c, e in zip(AXES, v)})
    a, b = ([F.col(f"_{n}{c}") for c in AXES] for n in "ab")
    cross = [a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]]
    size = length(a) * length(b)
    p = p.withColumn("_k", F.when(size > 1e-10, length(cross) / F.when(size > 1e-10, size).otherwise(1.0)).otherwise(F.when(size.isNotNull(), 0.0)))
    out = p.withColumn("curvature", F.coalesce("_k", F.lead("_k").over(w), F.lag("_k").over(w), F.lit(0.0)))
    return out.select(*points.columns, "curvature")


def around(points: DataFrame, radius: int, keys: Sequence[str]) -> DataFrame:
    """points with `_n`, their group's size, and `_near`, the points up to `radius` before and behind, of which the first is `_low`."""
    near = by(keys).rowsBetween(-radius, radius)
    return points.withColumns({"_n": F.count("*").over(Window.partitionBy(*keys)), "_near": F.collect_list(F.struct(*AXES)).over(near)}).withColumn("_low", F.greatest(F.lit(0), F.col("seq") - radius))


def smooth(points: DataFrame, sigma: float = 2.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """Gaussian kernel of radius int(4 sigma + 0.5), ends mirrored half a sample out; fewer than three points stay.

    A mirrored place is never further off than the place it stands for, so one window of the kernel's width holds all.
    """
    radius = int(4 * sigma + 0.5)
    weights = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(-radius, radius + 1)]
    p = around(points, radius, keys)
    places = []
    for k in range(-radius, radius + 1):
        m = F.pmod(F.col("seq") + k, 2 * F.col("_n"))
        places.append((F.when(m < F.col("_n"), m).otherwise(2 * F.col("_n") - 1 - m) - F.col("_low")).cast("int"))
    p = p.withColumn("_at", F.array(*places))
    sums = {c: sum((F.col("_near")[F.col("_at")[k]][c] * (w / sum(weights)) for k, w in enumerate(weights)), F.lit(0.0)) for c in AXES}
    return p.withColumns({c: F.when(F.col("_n") < 3, F.col(c)).otherwise(sums[c]) for c in AXES}).select(*points.columns)


def smooth_pieces(points: DataFrame, sigma: float = 2.0, gap: float = 5.0, keys: Sequence[str] = KEYS) -> DataFrame:
    """W2, then W4 in each piece."""
    inner = (*keys, "piece")
    return renumbered(smooth(renumbered(split_at_gaps(points, gap, keys), inner), sigma, inner).withColumn("seq", F.col("piece") * (1 << 32) + F.col("seq")), keys)


def adaptive_smooth(points: DataFrame, base: float = 1.0, weight: float = 0.5, keys: Sequence[str] = KEYS) -> DataFrame:
    """The sharper the bend the narrower the kernel, cut off at 3 sigma and at the ends; under five points W4."""
    p = curvature(points, keys)
    top = F.max("curvature").over(Window.partitionBy(*keys))
    sigma = F.greatest(F.lit(0.5), F.lit(base) * (1 - F.lit(weight) * F.col("curvature") / F.when(top > 0, top).otherwise(1.0)))
    p = p.withColumn("_s", sigma)
    radius = int(3 * max(0.5, base))
    p = around(p, radius, keys)
    inside = [(F.abs(F.lit(k)) <= F.floor(3 * F.col("_s"))) & (F.col("seq") + k >= 0) & (F.col("seq") + k < F.col("_n")) for k in range(-radius, radius + 1)]
    kernel = [F.when(ok, F.exp(-0.5 * (F.lit(float(k)) / F.col("_s")) * (F.lit(float(k)) / F.col("_s")))).otherwise(0.0) for k, ok in zip(range(-radius, radius + 1), inside)]
    p = p.withColumn("_w", F.array(*kernel))
    places = [(F.least(F.greatest(F.col("seq") + k, F.lit(0)), F.col("_n") - 1) - F.col("_low")).cast("int") for k in range(-radius, radius + 1)]
    whole_weight = sum((F.col("_w")[k] for k in range(2 * radius + 1)), F.lit(0.0))
    sums = {c: sum((F.col("_near")[at][c] * F.col("_w")[k] for k, at in enumerate(places)), F.lit(0.0)) / whole_weight for c in AXES}
    few = smooth(points, base, keys).select(*keys, "seq", *(F.col(c).alias(f"_{c}0") for c in AXES))
    p = p.select(*keys, "seq", "_n", *(c for c in points.columns if c not in (*keys, "seq", *AXES)), *(sums[c].alias(c) for c in AXES))
    return p.join(few, [*keys, "seq"]).withColumns({c: F.when(F.col("_n") < 5, F.col(f"_{c}0")).otherwise(F.col(c)) for c in AXES}).select(*points.columns)
