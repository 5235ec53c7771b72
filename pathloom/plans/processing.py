"""A recorded walk from points to graph: one plan for all scans at once."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.geometry import distance, floor_name
from ..operators import cleaning, floors, graph, grouped
from ..operators.cleaning import by, here, shifted
from ..operators.graph import FLOOR
from ..operators.keeping import kept


class Processed:
    """The process's tables, each computed when first asked for, once, and then read by all that follow."""

    def __init__(self, points: DataFrame, derive_endpoints: bool = False):
        self.marked, self.derive_endpoints = kept(floors.on_runs(points.select("scan_id", "seq", "x", "y", "z"))), derive_endpoints
        self.points = self.marked.select("scan_id", "seq", "x", "y", "z")

    @cached_property
    def runs(self) -> DataFrame:
        return kept(floors.runs_of(self.marked))

    @cached_property
    def leveled(self) -> DataFrame:
        return kept(floors.separate_floors(self.marked))

    @cached_property
    def located(self) -> DataFrame:
        """The passages with their entries and exits."""
        return kept(floors.passages_of(self.marked, self.leveled, ends=True))

    @cached_property
    def passages(self) -> DataFrame:
        return self.located.drop(*floors.ENDS)

    @cached_property
    def paths(self) -> DataFrame:
        clean = cleaning.remove_outliers(cleaning.renumbered(grouped.dealt(self.leveled, FLOOR), FLOOR), keys=FLOOR)
        return kept(grouped.per_group(clean, FLOOR, lambda p: grouped.snapped(apart(p)), as_dealt=True))

    @cached_property
    def placed(self) -> DataFrame:
        """The nodes with their way along the path, from which edges follow without the points."""
        return kept(graph.placed_nodes(self.paths))

    @cached_property
    def nodes(self) -> DataFrame:
        return self.placed.drop("way")

    @cached_property
    def vertical(self) -> DataFrame:
        return graph.vertical_edges(self.located, self.nodes) if self.derive_endpoints else graph.path_edges_empty(self.nodes)

    @cached_property
    def edges(self) -> DataFrame:
        return graph.edges_along(self.placed).unionByName(self.vertical)


def process(points: DataFrame, derive_endpoints: bool = False) -> Processed:
    """Passages, floors, cleaning (W1, D2 at 1.0, D1 at 0.5), F9 and the graph. With derive_endpoints floors get joined."""
    return Processed(points, derive_endpoints)


def apart(p):
    return grouped.overlaps_merged_and_apart(p, 1.0, 0.5)


def floor_results(paths: DataFrame) -> DataFrame:
    """G9's part for floors: name, bounds, total distance over every pair of neighbours and the segments."""
    w = by(FLOOR)
    p = paths.withColumns({f"_{c}": e for c, e in zip("xyz", shifted(1, w))}).withColumn("_d", distance(here(), [F.col(f"_{c}") for c in "xyz"]))
    segment = F.when(F.col("_d").isNotNull(), F.struct(F.col("seq").alias("sequence"), F.struct("x", "y", "z").alias("start"), F.struct(*(F.col(f"_{c}").alias(c) for c in "xyz")).alias("end"), F.col("_d").alias("length")))
    bounds = F.struct(*(f(c).alias(f"{n}_{c}") for c in "xyz" for n, f in (("min", F.min), ("max", F.max))))
    out = p.groupBy(*FLOOR).agg(F.count("*").alias("point_count"), F.coalesce(F.sum("_d"), F.lit(0.0)).alias("total_distance"), bounds.alias("bounds"), F.array_sort(F.collect_list(segment)).alias("segments"))
    return out.withColumn("floor_name", floor_name(F.col("floor_level")))


def results(done: Processed) -> DataFrame:
    """One nested row for each scan, ready for write.json or write.parquet."""
    f = floor_results(done.paths).groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("floor_level", "floor_name", "point_count", "total_distance", "bounds", "segments"))).alias("floors"), F.sum("total_distance").alias("total_distance"))
    v = done.passages.groupBy("scan_id").agg(F.array_sort(F.collect_list(F.struct("start_idx", "end_idx", "type", "direction", F.coalesce("from_floor", F.lit(0)).alias("from_floor"), F.coalesce("to_floor", F.lit(0)).alias("to_floor"), "z_displacement"))).alias("passages"))
    return f.join(v, "scan_id", "left").join(graph.graph_stats(done.nodes, done.edges).select("scan_id", "total_nodes", "total_edges"), "scan_id", "left")


def write_results(done: Processed, path: str, version: int = 0) -> None:
    """The results as JSON lines, one folder a version. Writing a version again replaces that one only; other scans' results stay."""
    results(done).write.mode("overwrite").json(f"{path}/version={version}")


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """The latest version of each scan's result."""
    rows = spark.read.json(path)
    return rows.groupBy("scan_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "scan_id")), "version").alias("_r")).select("scan_id", "_r.*")


#: A job's progress when a stage has ended.
STAGES = (("points", 5), ("runs", 20), ("leveled", 40), ("paths", 70), ("nodes", 95))


def jobs(points: DataFrame, done: Processed | None = None, reached: str | None = None, submitted: DataFrame | None = None) -> DataFrame:
    """One row for each scan submitted (by default those with points): status, progress and error.

    A scan is PENDING (0) without points while the work goes on, PROCESSING with the progress of the stage `reached` if one is
    named, and in the end COMPLETED (100), or FAILED with the reason if no path came out of it, at the progress of the last stage that
    gave it rows.
    """
    scans = (submitted if submitted is not None else points).select("scan_id").distinct()
    if reached is not None:
        known = points.select("scan_id").distinct().withColumn("_known", F.lit(True))
        started = F.coalesce("_known", F.lit(False))
        return scans.join(known, "scan_id", "left").select("scan_id", F.when(started, "PROCESSING").otherwise("PENDING").alias("status"), F.when(started, dict(STAGES)[reached]).otherwise(0).alias("progress"), F.lit(None).cast("string").alias("error"))
    if done is None:
        return scans.select("scan_id", F.lit("PENDING").alias("status"), F.lit(0).alias("progress"), F.lit(None).cast("string").alias("error"))
    best = F.lit(0)
    for name, share in STAGES:
        found = getattr(done, name).select("scan_id").distinct().withColumn(f"_{name}", F.lit(share))
        scans = scans.join(found, "scan_id", "left")
        best = F.greatest(best, F.coalesce(f"_{name}", F.lit(0)))
    ok = F.col("_paths").isNotNull()
    return scans.select("scan_id", F.when(ok, "COMPLETED").otherwise("FAILED").alias("status"), F.when(ok, 100).otherwise(best).alias("progress"), F.when(~ok, "no path is left after cleaning").alias("error"))
