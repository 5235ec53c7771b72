"""Vertical passages and floors. Points are (scan_id, seq, x, y, z)."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .cleaning import by
from .keeping import kept

SCAN = ["scan_id"]

#: V3: runs that follow within so many points may be merged.
GAP = 10


def climbing(points: DataFrame, step: float = 0.05, window: int = 10, least: float = 1.5) -> DataFrame:
    """V1: `marked` points lie in a window whose height changes by over half of `least`, most of its steps that way."""
    w = by(SCAN)
    p = points.withColumn("_dz", F.col("z") - F.lag("z").over(w)).withColumn("_rise", F.lead("z", window).over(w) - F.col("z"))
    ahead = w.rowsBetween(1, window)
    ups, downs = (F.sum(c.cast("int")).over(ahead) for c in (F.col("_dz") > step / 2, F.col("_dz") < -step / 2))
    hit = (F.abs("_rise") > least / 2) & (F.when(F.col("_rise") > 0, ups).otherwise(downs) > window // 2)
    p = p.withColumn("_hit", F.coalesce(hit, F.lit(False)))
    return p.withColumn("marked", F.max("_hit").over(w.rowsBetween(-window, 0))).drop("_dz", "_rise", "_hit")


def on_runs(points: DataFrame, least: float = 1.5, shortest: int = 5) -> DataFrame:
    """V1 and V2 for each point: `start_idx` and `end_idx` (exclusive) of its run, a maximal stretch of marked points that changes height by `least` or more,
    and whether it goes `up`; `on_passage` if it has one, from runs before they are merged. Windows over the scan only, so points are dealt once."""
    w = by(SCAN)
    p = climbing(points).withColumn("_apart", F.coalesce(F.col("seq") - F.lag("seq").over(w) != 1, F.lit(True)))
    p = p.withColumn("_run", F.sum((~F.col("marked") | F.col("_apart")).cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy("scan_id", "marked", "_run").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    p = p.withColumns({"_a": F.first("seq").over(run), "_b": F.last("seq").over(run) + 1, "_rise": F.abs(F.last("z").over(run) - F.first("z").over(run)), "_up": F.last("z").over(run) > F.first("z").over(run)})
    p = p.withColumn("on_passage", F.coalesce(F.col("scan_id").isNotNull() & F.col("marked") & (F.col("_rise") >= least) & (F.col("_b") - F.col("_a") >= shortest), F.lit(False)))
    return p.select(*points.columns, *(F.when(F.col("on_passage"), F.col(c)).alias(n) for c, n in (("_a", "start_idx"), ("_b", "end_idx"), ("_up", "up"))), "on_passage")


def measured(runs: DataFrame, points: DataFrame) -> DataFrame:
    """runs (scan_id, start_idx, end_idx exclusive) with heights, ratio of way to height, type and direction."""
    return summed(runs.withColumn("seq", F.explode(F.sequence("start_idx", F.col("end_idx") - 1))).join(points.select("scan_id", "seq", "x", "y", "z"), ["scan_id", "seq"]))


#: Where a passage is entered and left.
ENDS = tuple(f"{end}_{c}" for end in ("entry", "exit") for c in "xyz")


def summed(rows: DataFrame, ends: bool = False) -> DataFrame:
    """measured's columns from the runs' points, and with `ends` ENDS."""
    w = Window.partitionBy("scan_id", "start_idx").orderBy("seq")
    places = [f(c, "seq").alias(f"{end}_{c}") for end, f in (("entry", F.min_by), ("exit", F.max_by)) for c in "xyz"] if ends else []
    rows = rows.withColumn("_way", F.sqrt(F.pow(F.col("x") - F.lag("x").over(w), 2) + F.pow(F.col("y") - F.lag("y").over(w), 2)))
    out = rows.groupBy("scan_id", "start_idx", "end_idx").agg(F.min_by("z", "seq").alias("z_start"), F.max_by("z", "seq").alias("z_end"), F.coalesce(F.sum("_way"), F.lit(0.0)).alias("_xy"), *places)
    out = out.withColumn("z_displacement", F.abs(F.col("z_end") - F.col("z_start")))
    ratio = F.when(F.col("z_displacement") > 0, F.col("_xy") / F.when(F.col("z_displacement") > 0, F.col("z_displacement")).otherwise(1.0)).otherwise(float("inf"))
    out = out.withColumn("xy_z_ratio", ratio).withColumn("type", F.when(F.col("xy_z_ratio") < 1.0, "ELEVATOR").otherwise("STAIRCASE"))
    return out.withColumn("direction", F.when(F.col("z_end") > F.col("z_start"), "UP").otherwise("DOWN")).drop("_xy")


def runs_of(marked: DataFrame) -> DataFrame:
    """V2: the runs of on_runs' points."""
    return summed(marked.filter("on_passage"))


def passage_runs(points: DataFrame, least: float = 1.5, shortest: int = 5) -> DataFrame:
    """V2: maximal marked runs that change height by `least` or more."""
    return runs_of(on_runs(points, least, shortest))


def merged_runs(runs: DataFrame, points: DataFrame, gap: int = GAP) -> DataFrame:
    """V3: a run joins the one before if it goes the same way and starts less than `gap` points behind it."""
    w = Window.partitionBy("scan_id").orderBy("start_idx")
    new = ~F.coalesce((F.lag("direction").over(w) == F.col("direction")) & (F.col("start_idx") - F.lag("end_idx").over(w) < gap), F.lit(False))
    groups = runs.withColumn("_new", new.cast("int")).withColumn("_g", F.sum("_new").over(w)).groupBy("scan_id", "_g").agg(F.min("start_idx").alias("start_idx"), F.max("end_idx").alias("end_idx"))
    return measured(groups.drop("_g"), points)


#: The histogram's kernel: its reach in bins, and its width.
REACH, SIGMA = 6, 1.5


def height_peaks(rows: DataFrame, height: float = 3.0) -> DataFrame:
    """V5 and V6: for each scan of rows the lowest z, `spread`, the number n of points and the heights of its levels in rising order: peaks of a smoothed
    histogram of z in bins of about half a metre. `peaks` is null for a scan of less than `height`, empty where no peak stands out.

    Bins without points are no rows: a bin's count goes to the bins within reach of it, and of its mirror images beyond either end. A region
    of high bins (a gap of one is none) has one peak; regions come from below, so a peak is accepted if it is far enough from the last one.
    """
    whole = rows.groupBy("scan_id").agg(F.min("z").alias("lowest"), (F.max("z") - F.min("z")).alias("spread"), F.count("*").alias("n"))
    return whole.join(found_peaks(with_spread(rows), height), "scan_id", "left").select("scan_id", "lowest", "spread", "n", peaks_or_none(height).alias("peaks"))


def with_spread(rows: DataFrame) -> DataFrame:
    """rows with their scan's lowest z, spread and number of points, by a window: what follows by scan is not dealt again."""
    w = Window.partitionBy("scan_id")
    return rows.withColumns({"lowest": F.min("z").over(w), "spread": F.max("z").over(w) - F.min("z").over(w), "n": F.count("*").over(w)})


def peaks_or_none(height: float):
    return F.when(F.col("spread") >= height, F.coalesce("peaks", F.array().cast("array<double>")))


def found_peaks(spread: DataFrame, height: float) -> DataFrame:
    """height_peaks' (scan_id, peaks) of with_spread's rows, for scans where a peak stands out."""
    edge = lambda k: F.col("lowest") + k * (F.col("spread") / F.col("_bins"))
    b = spread.filter(F.col("spread") >= height).select("scan_id", "z", "lowest", "spread", "n").withColumn("_bins", F.greatest(F.floor(F.col("spread") / 0.5), F.lit(20)))
    b = b.withColumn("_k", F.least(F.floor((F.col("z") - F.col("lowest")) / F.col("spread") * F.col("_bins")), F.col("_bins") - 1))
    # a height at an edge belongs to the bin above it, whatever the division's rounding says; the highest to the last bin
    b = b.withColumn("_k", F.col("_k") - (F.col("z") < edge(F.col("_k"))).cast("int"))
    b = b.withColumn("_k", F.col("_k") + ((F.col("_k") != F.col("_bins") - 1) & (F.col("z") >= edge(F.col("_k") + 1))).cast("int"))
    counts = b.groupBy("scan_id", "lowest", "spread", "_bins", "n", "_k").agg(F.count("*").alias("_c"))
    norm = sum(math.exp(-0.5 * (o / SIGMA) ** 2) for o in range(-REACH, REACH + 1))
    weights = F.array(*(F.lit(math.exp(-0.5 * (o / SIGMA) ** 2) / norm) for o in range(-REACH, REACH + 1)))
    images = F.array(F.col("_k"), -1 - F.col("_k"), 2 * F.col("_bins") - 1 - F.col("_k"))
    # images out of reach of all bins are no rows
    spread_out = counts.select("*", F.explode(F.filter(images, lambda i: (i >= -REACH) & (i < F.col("_bins") + REACH))).alias("_image"))
    spread_out = spread_out.select("*", F.explode(F.sequence(F.greatest(F.lit(-REACH), -F.col("_image")), F.least(F.lit(REACH), F.col("_bins") - 1 - F.col("_image")))).alias("_o")).withColumn("_to", F.col("_image") + F.col("_o"))
    smooth = spread_out.groupBy("scan_id", "lowest", "spread", "_bins", "n", "_to").agg(F.sum(F.col("_c") * F.element_at(weights, (F.col("_o") + REACH + 1).cast("int"))).alias("_s"))
    w = Window.partitionBy("scan_id").orderBy("_to")
    high = smooth.filter(F.col("_s") >= 0.03 * F.col("n")).withColumn("_new", F.coalesce(F.col("_to") - F.lag("_to").over(w) > 2, F.lit(True)).cast("int")).withColumn("_region", F.sum("_new").over(w))
    regions = high.groupBy("scan_id", "_region").agg((F.sum((edge(F.col("_to")) + edge(F.col("_to") + 1)) / 2 * F.col("_s")) / F.sum("_s")).alias("_peak"))
    none = F.array().cast("array<double>")
    far = lambda kept_, x: (F.size(kept_) == 0) | (x - F.element_at(kept_, -1) >= 0.7 * height)
    return regions.groupBy("scan_id").agg(F.aggregate(F.array_sort(F.collect_list("_peak")), none, lambda taken, x: F.when(far(taken, x), F.concat(taken, F.array(x))).otherwise(taken)).alias("peaks"))


def height_level(height: float = 3.0):
    """V5: the place of the nearest peak to z, the lowest of equals; without peaks of the nearest of as many even parts of the spread as have about `height`."""
    nearest = F.array_min(F.transform("peaks", lambda p, i: F.struct(F.abs(F.col("z") - p).alias("d"), i.alias("i"))))["i"]
    part = F.col("spread") / F.greatest(F.floor(F.col("spread") / height) + 1, F.lit(1))
    even = F.greatest(F.ceil((F.col("z") - F.col("lowest")) / F.when(part > 0, part).otherwise(1.0)) - 1, F.lit(0))
    return F.when(F.col("peaks").isNull(), F.lit(0)).when(F.size("peaks") == 0, even).otherwise(nearest).cast("int")


def separate_floors(points: DataFrame, height: float = 3.0, least: int = 10) -> DataFrame:
    """V4: points off passages with floor_level 1..k by rising mean height; levels of under `least` points go."""
    rows = with_spread(points.filter("scan_id IS NOT NULL AND NOT on_passage").select("scan_id", "seq", "x", "y", "z"))
    leveled = rows.join(found_peaks(rows, height), "scan_id", "left").withColumn("peaks", peaks_or_none(height)).select("scan_id", "seq", "x", "y", "z", height_level(height).alias("_level"))
    level = Window.partitionBy("scan_id", "_level")
    leveled = leveled.withColumns({"_z": F.avg("z").over(level), "_n": F.count("*").over(level)}).filter(F.col("_n") >= least)
    return leveled.withColumn("floor_level", F.dense_rank().over(Window.partitionBy("scan_id").orderBy("_z", "_level"))).select("scan_id", "seq", "x", "y", "z", "floor_level")


def floor_summary(floors: DataFrame) -> DataFrame:
    return floors.groupBy("scan_id", "floor_level").agg(F.avg("z").alias("z_mean"), F.min("z").alias("z_min"), F.max("z").alias("z_max"), F.count("*").alias("point_count"))


def assign_floors(passages: DataFrame, summary: DataFrame) -> DataFrame:
    """V7: the floors nearest in height to start and end; 0 without floors, the lowest of equals. Floors of one scan are few."""
    levels = summary.groupBy("scan_id").agg(F.collect_list(F.struct("floor_level", "z_mean")).alias("_levels"))
    near = lambda z: F.coalesce(F.array_min(F.transform("_levels", lambda f: F.struct(F.abs(f["z_mean"] - F.col(z)).alias("d"), f["floor_level"].alias("level"))))["level"], F.lit(0))
    return passages.join(levels, "scan_id", "left").withColumns({"from_floor": near("z_start"), "to_floor": near("z_end")}).drop("_levels")


def detect_passages(points: DataFrame) -> DataFrame:
    """V8: V1 to V3, V4 and V7 in one."""
    marked = kept(on_runs(points))
    return passages_of(marked, separate_floors(marked))


def passages_of(marked: DataFrame, leveled: DataFrame, ends: bool = False) -> DataFrame:
    """V3 and V7 of on_runs' points and their floors, with `ends` ENDS too."""
    return assign_floors(summed(on_merged_runs(marked), ends), floor_summary(leveled))


def on_merged_runs(marked: DataFrame, gap: int = GAP) -> DataFrame:
    """The points of merged_runs' runs, those between the runs that are merged included, with `start_idx` and `end_idx`: windows over the scan, so points are dealt once."""
    w = by(SCAN)
    before, group = w.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy("scan_id", "_g")
    goes_on = (F.last("up", True).over(before) == F.col("up")) & (F.col("start_idx") - F.last("end_idx", True).over(before) < gap)
    p = marked.filter("scan_id IS NOT NULL").select("scan_id", "seq", "x", "y", "z", "start_idx", "end_idx", "up")
    p = p.withColumn("_new", (F.coalesce(F.col("seq") == F.col("start_idx"), F.lit(False)) & ~F.coalesce(goes_on, F.lit(False))).cast("int"))
    p = p.withColumn("_g", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    p = p.filter(F.col("_g") > 0).withColumns({"start_idx": F.min("seq").over(group), "end_idx": F.max("end_idx").over(group)})
    return p.filter(F.col("seq") < F.col("end_idx")).select("scan_id", "start_idx", "end_idx", "seq", "x", "y", "z")


def passage_stats(passages: DataFrame) -> DataFrame:
    """V9."""
    of = {"STAIRCASE": "staircase_count", "ELEVATOR": "elevator_count"}
    return passages.groupBy("scan_id").agg(F.count("*").alias("total_passages"), *(F.sum((F.col("type") == k).cast("long")).alias(n) for k, n in of.items()), F.sum("z_displacement").alias("total_z_displacement"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.array("from_floor", "to_floor"))))).alias("connected_floors"))
