"""Every operator as a query over a folder of tables, with DuckDB SQL where SQL says it well."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import geometry as geo
from ..operators import catalog, cleaning, floors, graph, grouped, lines, routing, splines
from ..operators.keeping import kept, shared_folder
from ..sources import slam
from ..sources.scans import OLD_TOLERANCE, TRAJECTORY_SQL, decoded_pose, encoded_pose, rotation, trajectory, walks
from ..sources.versions import VersionedTable
from ..streaming import jobs
from . import processing

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
WALKS = f"WITH p AS ({TRAJECTORY_SQL.format(events='events')})"
STEP = "sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w) + (z - lag(z) OVER w) * (z - lag(z) OVER w))"
S = f"{WALKS}, s AS (SELECT *, {STEP} AS step FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY seq))"


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, places: int = 6) -> DataFrame:
    """Doubles to some places: sums differ in their last bits by order."""
    return df.select(*(F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- trajectories -----------------------------------------------------------------------------------------------------

query("s1_trajectory", f"{WALKS} SELECT scan_id, node_id, seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM p")(lambda s, d: rounded(walks(s, d)))
def nodes_of(spark: SparkSession, d: str) -> DataFrame:
    """The walks as a SLAM database holds them: poses as bytes, some missing, cut short or at the origin."""
    w, node = walks(spark, d), F.col("node_id")
    one = lambda c: F.when(node % 13 == 0, F.lit(0.0)).otherwise(F.col(c))
    matrix = F.array(*(F.lit(float(k)) for k in (1, 0)), (node % 7).cast("double"), one("x"), *(F.lit(float(k)) for k in (0, 1)), (node % 5).cast("double"), one("y"), *(F.lit(float(k)) for k in (0, 0, 1)), one("z"))
    pose = F.when(node % 11 == 0, F.lit(None).cast("binary")).when(node % 17 == 0, F.lit(b"")).otherwise(encoded_pose(matrix))
    return w.select("scan_id", "node_id", pose.alias("pose"), (node % 19 == 0).alias("short"))


FLOATS = "CAST(CAST(x AS FLOAT) AS DOUBLE) AS x, CAST(CAST(y AS FLOAT) AS DOUBLE) AS y, CAST(CAST(z AS FLOAT) AS DOUBLE) AS z"
query("s1_s2_s3_positions", f"{WALKS}, v AS (SELECT scan_id, node_id, {FLOATS} FROM p WHERE node_id % 11 <> 0 AND node_id % 13 <> 0 AND node_id % 17 <> 0 AND node_id % 19 <> 0) SELECT scan_id, node_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY node_id) - 1 AS BIGINT) AS seq, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM v")(
    lambda s, d: rounded(trajectory(nodes_of(s, d).withColumn("pose", F.when(F.col("short"), F.substring("pose", 1, 47)).otherwise(F.col("pose")))).select("scan_id", "node_id", "seq", "x", "y", "z"), 5)
)
def slam_folder(spark: SparkSession, nodes: DataFrame) -> DataFrame:
    """nodes written as one database a scan into the shared folder, and read from there by the source; through Spark's files where the shared folder is no mounted one."""
    shared = f"{shared_folder(spark)}/slam-{uuid.uuid4().hex}"
    if shared.startswith(("file:", "/")):
        slam.write_nodes(nodes, shared)
        return slam.read_nodes(spark, shared)
    slam.packed(nodes).write.parquet(shared)
    return slam.nodes_in(spark.read.parquet(shared)).filter("NOT head")


query("s1_slam_files", f"{WALKS}, v AS (SELECT scan_id, node_id, {FLOATS} FROM p WHERE node_id % 11 <> 0 AND node_id % 13 <> 0 AND node_id % 17 <> 0 AND node_id % 19 <> 0 AND node_id > 500) SELECT scan_id || '.db' AS scan_id, node_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY node_id) - 1 AS BIGINT) AS seq, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM v")(
    lambda s, d: rounded(trajectory(slam_folder(s, nodes_of(s, d).withColumn("pose", F.when(F.col("short"), F.substring("pose", 1, 47)).otherwise(F.col("pose")))).filter("node_id > 500")).select("scan_id", "node_id", "seq", "x", "y", "z"), 5)
)
query("s5_rotation", f"{WALKS} SELECT scan_id, node_id, node_id % 7 AS r3, node_id % 5 AS r6, 3 AS trace FROM p WHERE node_id % 11 <> 0 AND node_id % 17 <> 0")(
    lambda s, d: nodes_of(s, d).filter(F.length("pose") == 48).withColumn("r", rotation(decoded_pose("pose"))).select("scan_id", "node_id", F.col("r")[2].cast("long").alias("r3"), F.col("r")[5].cast("long").alias("r6"), (F.col("r")[0] + F.col("r")[4] + F.col("r")[8]).cast("int").alias("trace"))
)
query("s6_old_reader", f"{WALKS}, v AS (SELECT scan_id, node_id FROM p WHERE node_id % 11 <> 0 AND node_id % 13 <> 0 AND node_id % 17 <> 0) SELECT scan_id, count(*) AS n FROM v GROUP BY scan_id")(lambda s, d: trajectory(nodes_of(s, d), OLD_TOLERANCE, any_length=True).groupBy("scan_id").agg(F.count("*").alias("n")))


@query("s4_valid_position", f"{WALKS}, v AS (SELECT scan_id, CASE WHEN node_id % 50 = 0 THEN 0.0000005 WHEN node_id % 53 = 0 THEN 'NaN'::DOUBLE WHEN node_id % 59 = 0 THEN 'Infinity'::DOUBLE WHEN node_id % 61 = 0 THEN NULL ELSE x END AS x, CASE WHEN node_id % 50 = 0 THEN 0 ELSE y END AS y, CASE WHEN node_id % 50 = 0 THEN 0 ELSE z END AS z FROM p) SELECT scan_id, count(*) AS n, sum(CASE WHEN x IS NOT NULL AND isfinite(x) AND NOT (abs(x) <= 1e-6 AND abs(y) <= 1e-6 AND abs(z) <= 1e-6) THEN 1 ELSE 0 END)::BIGINT AS valid FROM v GROUP BY scan_id")
def s4(spark: SparkSession, d: str) -> DataFrame:
    """Points of which some are made the origin, not a number, infinite or null."""
    node, zero = F.col("node_id"), F.lit(0.0)
    x = F.when(node % 50 == 0, F.lit(5e-7)).when(node % 53 == 0, F.lit(float("nan"))).when(node % 59 == 0, F.lit(float("inf"))).when(node % 61 == 0, F.lit(None).cast("double")).otherwise(F.col("x"))
    spoiled = walks(spark, d).select("scan_id", x.alias("x"), *(F.when(node % 50 == 0, zero).otherwise(F.col(c)).alias(c) for c in "yz"))
    return spoiled.groupBy("scan_id").agg(F.count("*").alias("n"), F.sum(geo.valid_position(F.col("x"), F.col("y"), F.col("z")).cast("long")).alias("valid"))


query("m1_m2_distances", f"{WALKS} SELECT scan_id, seq, round(sqrt(x * x + y * y + z * z), 6) AS d3, round(sqrt(x * x + y * y), 6) AS d2, abs(round(z, 6)) AS dz FROM p")(
    lambda s, d: walks(s, d).select("scan_id", "seq", F.round(geo.length(cleaning.here()), 6).alias("d3"), F.round(geo.length(cleaning.here()[:2]), 6).alias("d2"), F.abs(F.round("z", 6)).alias("dz"))
)
ANGLES = "((x - lag(x) OVER w) * (lead(x) OVER w - x) + (y - lag(y) OVER w) * (lead(y) OVER w - y) + (z - lag(z) OVER w) * (lead(z) OVER w - z))"
NEXT = "sqrt((lead(x) OVER w - x) * (lead(x) OVER w - x) + (lead(y) OVER w - y) * (lead(y) OVER w - y) + (lead(z) OVER w - z) * (lead(z) OVER w - z))"
TURNS = f"{WALKS}, a AS (SELECT scan_id, seq, count(*) OVER (PARTITION BY scan_id) AS n, CASE WHEN {STEP} < 1e-10 OR {NEXT} < 1e-10 THEN 0 ELSE degrees(acos(greatest(-1, least(1, {ANGLES} / ({STEP} * {NEXT}))))) END AS turn FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY seq))"
query("m3_angles", f"{TURNS} SELECT scan_id, seq, round(turn, 4) AS turn FROM a WHERE seq > 0 AND seq < n - 1")(
    lambda s, d: graph.junction_turns(walks(s, d), keys=("scan_id",)).filter("turn IS NOT NULL").select("scan_id", "seq", F.round("turn", 4).alias("turn"))
)
query("g1_junctions", f"{TURNS} SELECT scan_id, seq FROM a WHERE n >= 5 AND seq >= 3 AND seq < n - 3 AND turn >= 45")(lambda s, d: graph.junction_turns(walks(s, d), keys=("scan_id",)).filter("junction").select("scan_id", "seq"))


@query("m5_edge_weight", "SELECT o_orderkey, round(CASE WHEN p = 'SHORTEST' THEN d WHEN p = 'ELEVATOR_FIRST' THEN CASE t WHEN 'VERTICAL_ELEVATOR' THEN d * 0.5 WHEN 'VERTICAL_STAIRCASE' THEN d * 2 ELSE d END ELSE CASE t WHEN 'VERTICAL_ELEVATOR' THEN d * 2 WHEN 'VERTICAL_STAIRCASE' THEN d * 0.8 ELSE d END END, 6) AS weight FROM (SELECT o_orderkey, o_totalprice AS d, CASE o_orderstatus WHEN 'F' THEN 'VERTICAL_ELEVATOR' WHEN 'O' THEN 'VERTICAL_STAIRCASE' ELSE 'HORIZONTAL' END AS t, CASE o_orderkey % 3 WHEN 0 THEN 'SHORTEST' WHEN 1 THEN 'ELEVATOR_FIRST' ELSE 'STAIRCASE_FIRST' END AS p FROM orders)")
def m5(spark: SparkSession, d: str) -> DataFrame:
    kind = F.when(F.col("o_orderstatus") == "F", "VERTICAL_ELEVATOR").when(F.col("o_orderstatus") == "O", "VERTICAL_STAIRCASE").otherwise("HORIZONTAL")
    wish = F.when(F.col("o_orderkey") % 3 == 0, "SHORTEST").when(F.col("o_orderkey") % 3 == 1, "ELEVATOR_FIRST").otherwise("STAIRCASE_FIRST")
    return table(spark, d, "orders").select("o_orderkey", F.round(geo.edge_weight(F.col("o_totalprice"), kind, wish), 6).alias("weight"))


query("m7_floor_name", "SELECT DISTINCT c_nationkey - 5 AS level, CASE WHEN c_nationkey < 5 THEN 'B' || (5 - c_nationkey) ELSE greatest(c_nationkey - 5, 1) || '층' END AS name FROM customer")(lambda s, d: table(s, d, "customer").select((F.col("c_nationkey") - 5).alias("level")).distinct().withColumn("name", geo.floor_name(F.col("level"))))
query("t1_trajectory_stats", f"{S} SELECT scan_id, count(*) AS total_nodes, round(min(x), 6) AS x_min, round(max(x), 6) AS x_max, round(min(y), 6) AS y_min, round(max(y), 6) AS y_max, round(min(z), 6) AS z_min, round(max(z), 6) AS z_max, round(coalesce(sum(step), 0), 6) AS total_distance, round(coalesce(avg(step), 0), 6) AS mean_step FROM s GROUP BY scan_id")(lambda s, d: rounded(cleaning.trajectory_stats(walks(s, d))))
OUTLIERS = f"{S}, f AS (SELECT *, lead(step) OVER w AS nxt, count(*) OVER (PARTITION BY scan_id) AS n, avg(step) OVER (PARTITION BY scan_id) + 3.0 * stddev_pop(step) OVER (PARTITION BY scan_id) AS lim, (lag(x) OVER w + lead(x) OVER w) / 2 AS mx, (lag(y) OVER w + lead(y) OVER w) / 2 AS my, (lag(z) OVER w + lead(z) OVER w) / 2 AS mz FROM s WINDOW w AS (PARTITION BY scan_id ORDER BY seq)), c AS (SELECT *, coalesce(n >= 5 AND (step > lim OR nxt > lim) AND step IS NOT NULL AND nxt IS NOT NULL, false) AS bad FROM f)"
query("w1_remove_outliers", f"{OUTLIERS} SELECT scan_id, seq, round(CASE WHEN bad THEN mx ELSE x END, 6) AS x, round(CASE WHEN bad THEN my ELSE y END, 6) AS y, round(CASE WHEN bad THEN mz ELSE z END, 6) AS z FROM c")(lambda s, d: rounded(cleaning.remove_outliers(walks(s, d)).drop("node_id")))
PIECES = f"{S}, g AS (SELECT *, CAST(coalesce(sum(CASE WHEN step > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY seq), 0) AS BIGINT) AS piece FROM s), h AS (SELECT *, count(*) OVER (PARTITION BY scan_id, piece) AS m, max(piece) OVER (PARTITION BY scan_id) AS k FROM g)"
query("w2_split_at_gaps", f"{PIECES} SELECT scan_id, seq, piece FROM h WHERE m > 1 OR k = 0")(lambda s, d: cleaning.split_at_gaps(walks(s, d)).select("scan_id", "seq", "piece"))
TURN = ("(y - lag(y) OVER w) * (lead(z) OVER w - z) - (z - lag(z) OVER w) * (lead(y) OVER w - y)", "(z - lag(z) OVER w) * (lead(x) OVER w - x) - (x - lag(x) OVER w) * (lead(z) OVER w - z)", "(x - lag(x) OVER w) * (lead(y) OVER w - y) - (y - lag(y) OVER w) * (lead(x) OVER w - x)")
CURVES = f"{WALKS}, cr AS (SELECT scan_id, seq, x, y, z, {TURN[0]} AS c1, {TURN[1]} AS c2, {TURN[2]} AS c3, {STEP} * {NEXT} AS size FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY seq)), ck AS (SELECT *, CASE WHEN size > 1e-10 THEN sqrt(c1 * c1 + c2 * c2 + c3 * c3) / size WHEN size IS NOT NULL THEN 0 END AS k FROM cr), cu AS (SELECT scan_id, seq, x, y, z, coalesce(k, lead(k) OVER w, lag(k) OVER w, 0) AS curvature FROM ck WINDOW w AS (PARTITION BY scan_id ORDER BY seq))"
query("w3_curvature", f"{CURVES} SELECT scan_id, seq, round(curvature, 6) AS curvature FROM cu")(lambda s, d: cleaning.curvature(walks(s, d)).select("scan_id", "seq", F.round("curvature", 6).alias("curvature")))
query("w4_smooth", f"{WALKS}, n AS (SELECT *, count(*) OVER (PARTITION BY scan_id) AS n FROM p), k AS (SELECT k, exp(-0.5 * (k / 2.0) * (k / 2.0)) AS w FROM range(-8, 9) t(k)), kk AS (SELECT k, w / (SELECT sum(w) FROM k) AS w FROM k), m AS (SELECT scan_id, seq, n, w, ((seq + k) % (2 * n) + 2 * n) % (2 * n) AS j FROM n, kk), f AS (SELECT scan_id, seq, w, CASE WHEN j < n THEN j ELSE 2 * n - 1 - j END AS j FROM m) SELECT f.scan_id, f.seq, round(sum(p.x * w), 5) AS x, round(sum(p.y * w), 5) AS y, round(sum(p.z * w), 5) AS z FROM f JOIN p ON p.scan_id = f.scan_id AND p.seq = f.j GROUP BY f.scan_id, f.seq")(lambda s, d: rounded(cleaning.smooth(walks(s, d)).drop("node_id"), 5))
KERNEL = "k AS (SELECT k, exp(-0.5 * (k / 2.0) * (k / 2.0)) AS w FROM range(-8, 9) t(k)), kk AS (SELECT k, w / (SELECT sum(w) FROM k) AS w FROM k)"


def smoothed_sql(source: str, keys: str) -> str:
    """CTEs that smooth `source` (keys, seq, x, y, z) into `sm`."""
    same = " AND ".join(f"q.{c.strip()} = f.{c.strip()}" for c in keys.split(","))
    return f"{KERNEL}, sn AS (SELECT *, count(*) OVER (PARTITION BY {keys}) AS n FROM {source}), sf AS (SELECT {keys}, seq, n, w, ((seq + k) % (2 * n) + 2 * n) % (2 * n) AS j FROM sn, kk), sg AS (SELECT {keys}, seq, n, w, CASE WHEN j < n THEN j ELSE 2 * n - 1 - j END AS j FROM sf), sm AS (SELECT {', '.join('f.' + c.strip() for c in keys.split(','))}, f.seq, CASE WHEN any_value(f.n) < 3 THEN any_value(o.x) ELSE sum(q.x * w) END AS x, CASE WHEN any_value(f.n) < 3 THEN any_value(o.y) ELSE sum(q.y * w) END AS y, CASE WHEN any_value(f.n) < 3 THEN any_value(o.z) ELSE sum(q.z * w) END AS z FROM sg f JOIN {source} q ON {same} AND q.seq = f.j JOIN {source} o ON {same.replace('q.', 'o.')} AND o.seq = f.seq GROUP BY ALL)"


query("w5_smooth_pieces", f"{PIECES}, u AS (SELECT scan_id, piece, row_number() OVER (PARTITION BY scan_id, piece ORDER BY seq) - 1 AS seq, x, y, z FROM h WHERE m > 1 OR k = 0), {smoothed_sql('u', 'scan_id, piece').replace('k AS (SELECT k, exp', 'kn AS (SELECT k, exp').replace('FROM k) AS w FROM k)', 'FROM kn) AS w FROM kn)')} SELECT scan_id, piece, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY piece, seq) - 1 AS BIGINT) AS seq, round(x, 5) AS x, round(y, 5) AS y, round(z, 5) AS z FROM sm")(lambda s, d: rounded(cleaning.smooth_pieces(walks(s, d)).drop("node_id"), 5))
query("w6_adaptive_smooth", f"{CURVES}, sg AS (SELECT scan_id, seq, greatest(0.5, 1.0 * (1 - 0.5 * curvature / CASE WHEN max(curvature) OVER (PARTITION BY scan_id) > 0 THEN max(curvature) OVER (PARTITION BY scan_id) ELSE 1 END)) AS s FROM cu), ws AS (SELECT scan_id, seq, k, exp(-0.5 * (k / s) * (k / s)) AS w FROM sg, range(-3, 4) t(k) WHERE abs(k) <= floor(3 * s)) SELECT ws.scan_id, ws.seq, round(sum(p.x * w) / sum(w), 5) AS x, round(sum(p.y * w) / sum(w), 5) AS y, round(sum(p.z * w) / sum(w), 5) AS z FROM ws JOIN p ON p.scan_id = ws.scan_id AND p.seq = ws.seq + ws.k GROUP BY ws.scan_id, ws.seq")(lambda s, d: rounded(cleaning.adaptive_smooth(walks(s, d)).drop("node_id"), 5))
query("w7_spline")(lambda s, d: rounded(grouped.per_group(walks(s, d), cleaning.KEYS, grouped.spline)))
query("w7_smoothing_spline")(lambda s, d: rounded(grouped.per_group(walks(s, d), cleaning.KEYS, lambda p: splines.smoothing_spline(p, 1.0))))
query("t3_smoothing_stats", f"{S}, {smoothed_sql('p', 'scan_id')}, b AS (SELECT scan_id, sum(step) AS l FROM s GROUP BY scan_id), a AS (SELECT scan_id, sum(step) AS l FROM (SELECT scan_id, {STEP} AS step FROM sm WINDOW w AS (PARTITION BY scan_id ORDER BY seq)) GROUP BY scan_id), dd AS (SELECT p.scan_id, sqrt((p.x - sm.x) * (p.x - sm.x) + (p.y - sm.y) * (p.y - sm.y) + (p.z - sm.z) * (p.z - sm.z)) AS d FROM p JOIN sm USING (scan_id, seq)) SELECT scan_id, round(avg(d), 5) AS mean_displacement, round(max(d), 5) AS max_displacement, round(coalesce(any_value(b.l), 0), 5) AS original_length, round(coalesce(any_value(a.l), 0), 5) AS smoothed_length FROM dd JOIN b USING (scan_id) JOIN a USING (scan_id) GROUP BY scan_id")(lambda s, d: rounded(cleaning.smoothing_stats(walks(s, d), cleaning.smooth(walks(s, d))), 5))
#: F1 in SQL: from `m` (a group's keys, n, means and sample covariances) the direction of the largest variance, v1 to v3, and its share.
LINE = """m1 AS (SELECT *, (xx + yy + zz) / 3 AS q FROM m), m2 AS (SELECT *, sqrt(((xx - q) * (xx - q) + (yy - q) * (yy - q) + (zz - q) * (zz - q) + 2 * (xy * xy + xz * xz + yz * yz)) / 6) AS p FROM m1),
m3 AS (SELECT *, (xx - q) / p AS a, (yy - q) / p AS b, (zz - q) / p AS d, xy / p AS e, xz / p AS f, yz / p AS g FROM m2 WHERE n > 2 AND p > 0),
m4 AS (SELECT *, q + 2 * p * cos(acos(greatest(-1, least(1, (a * (b * d - g * g) - e * (e * d - g * f) + f * (e * g - b * f)) / 2))) / 3) AS top FROM m3),
m5 AS (SELECT *, [xx - top, xy, xz] AS r0, [xy, yy - top, yz] AS r1, [xz, yz, zz - top] AS r2 FROM m4),
m6 AS (SELECT *, list_max([list_prepend(list_dot_product(c, c), c) FOR c IN [list_value(r0[2] * r1[3] - r0[3] * r1[2], r0[3] * r1[1] - r0[1] * r1[3], r0[1] * r1[2] - r0[2] * r1[1]),
  list_value(r0[2] * r2[3] - r0[3] * r2[2], r0[3] * r2[1] - r0[1] * r2[3], r0[1] * r2[2] - r0[2] * r2[1]), list_value(r1[2] * r2[3] - r1[3] * r2[2], r1[3] * r2[1] - r1[1] * r2[3], r1[1] * r2[2] - r1[2] * r2[1])]]) AS best FROM m5),
line AS (SELECT *, best[2] / sqrt(best[1]) AS v1, best[3] / sqrt(best[1]) AS v2, best[4] / sqrt(best[1]) AS v3, (v1 * v1 * xx + v2 * v2 * yy + v3 * v3 * zz + 2 * (v1 * v2 * xy + v1 * v3 * xz + v2 * v3 * yz)) / (3 * q) AS share FROM m6)"""
MOMENTS = "count(*) AS n, avg(x) AS mx, avg(y) AS my, avg(z) AS mz, covar_samp(x, x) AS xx, covar_samp(y, y) AS yy, covar_samp(z, z) AS zz, covar_samp(x, y) AS xy, covar_samp(x, z) AS xz, covar_samp(y, z) AS yz"
ALONG = "((x - mx) * v1 + (y - my) * v2 + (z - mz) * v3)"
LINES = f"{WALKS}, m AS (SELECT scan_id, {MOMENTS} FROM p GROUP BY scan_id), {LINE}"
query("t5_t6_line_fit", f"{LINES}, o AS (SELECT scan_id, share, sqrt((x - mx - {ALONG} * v1) * (x - mx - {ALONG} * v1) + (y - my - {ALONG} * v2) * (y - my - {ALONG} * v2) + (z - mz - {ALONG} * v3) * (z - mz - {ALONG} * v3)) AS d FROM p JOIN line USING (scan_id)) SELECT scan_id, round(max(share), 6) AS explained, round(avg(d), 6) AS mean_deviation, round(max(d), 6) AS max_deviation, round(stddev_pop(d), 6) AS std_deviation FROM o GROUP BY scan_id")(
    lambda s, d: rounded(lines.line_fit(walks(s, d)))
)
query("t7_scan_overlap", f"{WALKS}, b AS (SELECT scan_id % 2 AS odd, min(x) AS x1, max(x) AS x2, min(y) AS y1, max(y) AS y2 FROM p GROUP BY 1) SELECT round(greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)), 6) AS overlap_x, round(greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)), 6) AS overlap_y, greatest(0, least(a.x2, b.x2) - greatest(a.x1, b.x1)) > 0.5 OR greatest(0, least(a.y2, b.y2) - greatest(a.y1, b.y1)) > 0.5 AS mergeable FROM b a JOIN b ON a.odd = 0 AND b.odd = 1")(lambda s, d: rounded(cleaning.scan_overlap(walks(s, d).filter("scan_id % 2 = 0"), walks(s, d).filter("scan_id % 2 = 1"))))
DEDUP = f"""WITH RECURSIVE p AS ({TRAJECTORY_SQL.format(events='events')}),
l AS (SELECT a.scan_id, a.seq, list(b.seq) FILTER (WHERE b.seq IS NOT NULL) AS later FROM p a LEFT JOIN p b ON a.scan_id = b.scan_id AND b.seq > a.seq AND sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y) + (b.z - a.z) * (b.z - a.z)) <= 0.5 GROUP BY a.scan_id, a.seq),
r AS (SELECT scan_id, seq, true AS kept, coalesce(later, []) AS dead FROM l WHERE seq = 0
  UNION ALL SELECT l.scan_id, l.seq, NOT list_contains(r.dead, l.seq), CASE WHEN list_contains(r.dead, l.seq) THEN r.dead ELSE list_distinct(list_concat(r.dead, coalesce(l.later, []))) END FROM r JOIN l ON l.scan_id = r.scan_id AND l.seq = r.seq + 1)"""
query("d1_deduplicate", f"{DEDUP} SELECT scan_id, CAST(row_number() OVER (PARTITION BY scan_id ORDER BY seq) - 1 AS BIGINT) AS seq, round(x, 6) AS x, round(y, 6) AS y, round(z, 6) AS z FROM r JOIN p USING (scan_id, seq) WHERE kept")(lambda s, d: rounded(grouped.deduplicate(walks(s, d), 0.5)))
query("t2_deduplication_stats", f"{DEDUP} SELECT scan_id, count(*) AS original_count, sum(kept::INT)::BIGINT AS final_count, sum((NOT kept)::INT)::BIGINT AS removed_count, round(sum((NOT kept)::INT) / count(*), 6) AS reduction_rate, printf('%.1f%%', 100.0 * sum((NOT kept)::INT) / count(*)) AS reduction_text FROM r GROUP BY scan_id")(lambda s, d: rounded(cleaning.deduplication_stats(walks(s, d), grouped.deduplicate(walks(s, d), 0.5))))
query("d2_d3_d4_merge_overlaps")(lambda s, d: rounded(grouped.merge_overlaps(walks(s, d), 1.0)))
query("d5_simplify")(lambda s, d: rounded(grouped.simplify(walks(s, d), 0.5)))
query("f1_f2_project", f"{LINES} SELECT scan_id, seq, round(mx + {ALONG} * v1, 6) AS x, round(my + {ALONG} * v2, 6) AS y, round(mz + {ALONG} * v3, 6) AS z FROM p JOIN line USING (scan_id)")(lambda s, d: rounded(lines.project(walks(s, d))))
query("f3_f4_f5_f6_straighten")(lambda s, d: rounded(grouped.straighten(walks(s, d))))
query("f7_straighten_chunks", f"{WALKS}, m AS (SELECT scan_id, seq // 20 AS chunk, {MOMENTS} FROM p GROUP BY ALL), {LINE} SELECT p.scan_id, seq, round(CASE WHEN share >= 0.85 THEN mx + {ALONG} * v1 ELSE x END, 6) AS x, round(CASE WHEN share >= 0.85 THEN my + {ALONG} * v2 ELSE y END, 6) AS y, round(CASE WHEN share >= 0.85 THEN mz + {ALONG} * v3 ELSE z END, 6) AS z FROM p LEFT JOIN line ON p.scan_id = line.scan_id AND seq // 20 = chunk")(
    lambda s, d: rounded(lines.straighten_chunks(walks(s, d)))
)
query("f8_straighten_xy")(lambda s, d: rounded(grouped.per_group(walks(s, d), cleaning.KEYS, grouped.straightened_flat)))
query("f9_f10_snap_to_lines")(lambda s, d: rounded(grouped.snap_to_lines(walks(s, d))))
CLIMB = f"{WALKS}, a AS (SELECT *, z - lag(z) OVER w AS dz, lead(z, 10) OVER w - z AS rise FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY seq)), b AS (SELECT *, sum(CASE WHEN dz > 0.025 THEN 1 ELSE 0 END) OVER k AS up, sum(CASE WHEN dz < -0.025 THEN 1 ELSE 0 END) OVER k AS down FROM a WINDOW k AS (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN 1 FOLLOWING AND 10 FOLLOWING)), c AS (SELECT *, max(CASE WHEN abs(rise) > 0.75 AND CASE WHEN rise > 0 THEN up ELSE down END > 5 THEN 1 ELSE 0 END) OVER (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN 10 PRECEDING AND CURRENT ROW) AS marked FROM b)"
query("v1_climbing", f"{CLIMB} SELECT scan_id, seq FROM c WHERE marked = 1")(lambda s, d: floors.climbing(walks(s, d)).filter("marked").select("scan_id", "seq"))
RUNS = f"{CLIMB}, r AS (SELECT *, seq - row_number() OVER (PARTITION BY scan_id ORDER BY seq) AS run FROM c WHERE marked = 1), q AS (SELECT *, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS way FROM r WINDOW w AS (PARTITION BY scan_id, run ORDER BY seq)), t AS (SELECT scan_id, min(seq) AS start_idx, max(seq) + 1 AS end_idx, arg_min(z, seq) AS z1, arg_max(z, seq) AS z2, coalesce(sum(way), 0) AS xy FROM q GROUP BY scan_id, run)"
query("v2_passage_runs", f"{RUNS} SELECT scan_id, start_idx, end_idx, round(abs(z2 - z1), 6) AS z_displacement, round(xy / abs(z2 - z1), 6) AS xy_z_ratio, CASE WHEN xy / abs(z2 - z1) < 1 THEN 'ELEVATOR' ELSE 'STAIRCASE' END AS type, CASE WHEN z2 > z1 THEN 'UP' ELSE 'DOWN' END AS direction FROM t WHERE abs(z2 - z1) >= 1.5 AND end_idx - start_idx >= 5")(lambda s, d: rounded(floors.passage_runs(walks(s, d)).drop("z_start", "z_end")))
#: V3 in SQL, from RUNS: `t7` has the merged passages.
MERGED = "t2 AS (SELECT *, CASE WHEN z2 > z1 THEN 'UP' ELSE 'DOWN' END AS dir FROM t WHERE abs(z2 - z1) >= 1.5 AND end_idx - start_idx >= 5), t3 AS (SELECT *, CASE WHEN lag(dir) OVER w = dir AND start_idx - lag(end_idx) OVER w < 10 THEN 0 ELSE 1 END AS new FROM t2 WINDOW w AS (PARTITION BY scan_id ORDER BY start_idx)), t4 AS (SELECT *, sum(new) OVER (PARTITION BY scan_id ORDER BY start_idx) AS g FROM t3), t5 AS (SELECT scan_id, g, min(start_idx) AS start_idx, max(end_idx) AS end_idx FROM t4 GROUP BY scan_id, g), t6 AS (SELECT t5.scan_id, t5.start_idx, t5.end_idx, p.seq, p.z, sqrt((x - lag(x) OVER w) * (x - lag(x) OVER w) + (y - lag(y) OVER w) * (y - lag(y) OVER w)) AS way FROM t5 JOIN p ON p.scan_id = t5.scan_id AND p.seq >= t5.start_idx AND p.seq < t5.end_idx WINDOW w AS (PARTITION BY t5.scan_id, t5.g ORDER BY p.seq)), t7 AS (SELECT scan_id, start_idx, end_idx, arg_min(z, seq) AS z1, arg_max(z, seq) AS z2, coalesce(sum(way), 0) AS xy FROM t6 GROUP BY ALL)"
query("v3_merged_runs", f"{RUNS}, {MERGED} SELECT scan_id, start_idx, end_idx, round(z1, 6) AS z_start, round(z2, 6) AS z_end, round(abs(z2 - z1), 6) AS z_displacement, round(xy / abs(z2 - z1), 6) AS xy_z_ratio, CASE WHEN xy / abs(z2 - z1) < 1 THEN 'ELEVATOR' ELSE 'STAIRCASE' END AS type, CASE WHEN z2 > z1 THEN 'UP' ELSE 'DOWN' END AS direction FROM t7")(lambda s, d: rounded(floors.merged_runs(floors.passage_runs(walks(s, d)), walks(s, d))))
#: V4 to V6 in SQL: `lv` has the points off passages with their floors, `fs` the floors.
FLOORS_SQL = f"""{RUNS}, off AS (SELECT scan_id, start_idx, end_idx FROM t WHERE abs(z2 - z1) >= 1.5 AND end_idx - start_idx >= 5),
f AS (SELECT p.scan_id, p.seq, p.x, p.y, p.z FROM p ANTI JOIN off ON p.scan_id = off.scan_id AND p.seq >= off.start_idx AND p.seq < off.end_idx),
zs AS (SELECT scan_id, min(z) AS z0, max(z) - min(z) AS spread, count(*) AS n, greatest(CAST(floor((max(z) - min(z)) / 0.5) AS BIGINT), 20) AS nb FROM f GROUP BY scan_id),
b0 AS (SELECT scan_id, z, z0, spread, nb, n, least(CAST(floor((z - z0) / spread * nb) AS BIGINT), nb - 1) AS k FROM f JOIN zs USING (scan_id) WHERE spread >= 3),
b1 AS (SELECT * REPLACE (k - CASE WHEN z < z0 + k * (spread / nb) THEN 1 ELSE 0 END AS k) FROM b0),
b2 AS (SELECT * REPLACE (k + CASE WHEN k <> nb - 1 AND z >= z0 + (k + 1) * (spread / nb) THEN 1 ELSE 0 END AS k) FROM b1),
hist AS (SELECT scan_id, z0, spread, nb, n, k, count(*) AS c FROM b2 GROUP BY ALL),
images AS (SELECT * EXCLUDE (k), unnest([k, -1 - k, 2 * nb - 1 - k]) AS k FROM hist),
kernel AS (SELECT o, exp(-0.5 * (o / 1.5) * (o / 1.5)) / sum(exp(-0.5 * (o / 1.5) * (o / 1.5))) OVER () AS w FROM range(-6, 7) r(o)),
smooth AS (SELECT scan_id, z0, spread, nb, n, k + o AS k, sum(c * w) AS s FROM images, kernel WHERE k + o BETWEEN 0 AND nb - 1 GROUP BY ALL),
high AS (SELECT *, CASE WHEN k - lag(k) OVER (PARTITION BY scan_id ORDER BY k) <= 2 THEN 0 ELSE 1 END AS new FROM smooth WHERE s >= 0.03 * n),
region AS (SELECT *, sum(new) OVER (PARTITION BY scan_id ORDER BY k) AS region FROM high),
peak AS (SELECT scan_id, sum((z0 + k * (spread / nb) + z0 + (k + 1) * (spread / nb)) / 2 * s) / sum(s) AS peak FROM region GROUP BY scan_id, region),
peaks AS (SELECT scan_id, list_reduce(list([peak] ORDER BY peak), lambda a, b: CASE WHEN b[1] - a[-1] >= 0.7 * 3 THEN list_concat(a, b) ELSE a END) AS peaks FROM peak GROUP BY scan_id),
lv0 AS (SELECT f.*, CASE WHEN spread < 3 THEN 0 WHEN peaks IS NULL THEN greatest(ceil((z - z0) / (spread / greatest(floor(spread / 3) + 1, 1))) - 1, 0)
  ELSE list_position(list_transform(peaks, lambda q: abs(z - q)), list_min(list_transform(peaks, lambda q: abs(z - q)))) - 1 END AS level FROM f JOIN zs USING (scan_id) LEFT JOIN peaks USING (scan_id)),
fl AS (SELECT scan_id, level, avg(z) AS z_mean, min(z) AS z_min, max(z) AS z_max, count(*) AS point_count, row_number() OVER (PARTITION BY scan_id ORDER BY avg(z), level) AS floor_level FROM lv0 GROUP BY scan_id, level HAVING count(*) >= 10),
lv AS (SELECT lv0.*, floor_level FROM lv0 JOIN fl USING (scan_id, level))"""
query("v4_v5_v6_floors", f"{FLOORS_SQL} SELECT scan_id, CAST(floor_level AS INT) AS floor_level, round(z_mean, 9) AS z_mean, round(z_min, 9) AS z_min, round(z_max, 9) AS z_max, point_count FROM fl")(lambda s, d: rounded(floors.floor_summary(processing.process(walks(s, d)).leveled), 9))
#: V7 in SQL: `pa` has the passages with the floors nearest to their ends.
PASSAGES_SQL = f"""{FLOORS_SQL}, {MERGED},
pa AS (SELECT t7.scan_id, start_idx, end_idx, z1 AS z_start, z2 AS z_end, abs(z2 - z1) AS z_displacement, xy / abs(z2 - z1) AS xy_z_ratio, CASE WHEN xy / abs(z2 - z1) < 1 THEN 'ELEVATOR' ELSE 'STAIRCASE' END AS type,
  CASE WHEN z2 > z1 THEN 'UP' ELSE 'DOWN' END AS direction, CAST(coalesce(arg_min(floor_level, (abs(z_mean - z1), floor_level)), 0) AS INT) AS from_floor, CAST(coalesce(arg_min(floor_level, (abs(z_mean - z2), floor_level)), 0) AS INT) AS to_floor
  FROM t7 LEFT JOIN fl USING (scan_id) GROUP BY ALL)"""
query("v7_v8_passages", f"{PASSAGES_SQL} SELECT scan_id, start_idx, end_idx, round(z_start, 6) AS z_start, round(z_end, 6) AS z_end, round(z_displacement, 6) AS z_displacement, round(xy_z_ratio, 6) AS xy_z_ratio, type, direction, from_floor, to_floor FROM pa")(lambda s, d: rounded(floors.detect_passages(walks(s, d))))
query("v9_passage_stats", f"{PASSAGES_SQL} SELECT scan_id, count(*) AS total_passages, count(*) FILTER (WHERE type = 'STAIRCASE') AS staircase_count, count(*) FILTER (WHERE type = 'ELEVATOR') AS elevator_count, round(sum(z_displacement), 6) AS total_z_displacement, list_sort(list_distinct(flatten(list([from_floor, to_floor])))) AS connected_floors FROM pa GROUP BY scan_id")(lambda s, d: rounded(floors.passage_stats(processing.process(walks(s, d)).passages)))
query("g2_g3_path_nodes")(lambda s, d: rounded(processing.process(walks(s, d)).nodes))
query("g4_g5_g6_path_edges")(lambda s, d: rounded(processing.process(walks(s, d)).edges))


@query("g7_graph_stats")
def g7(spark: SparkSession, d: str) -> DataFrame:
    done = processing.process(walks(spark, d))
    return rounded(graph.graph_stats(done.nodes, done.edges))


query("g8_g10_vertical_edges")(lambda s, d: rounded(processing.process(walks(s, d), True).edges.filter("floor_level IS NULL")))
query("g9_s8_results")(lambda s, d: processing.results(processing.process(walks(s, d))))
query("g11_dead_ends")(lambda s, d: graph.dead_ends(processing.process(walks(s, d)).edges))
query("job_status")(lambda s, d: processing.jobs(walks(s, d), processing.process(walks(s, d))))


@query("g12_routes")
def g12(spark: SparkSession, d: str) -> DataFrame:
    """From the first point of each scan to the last node of its highest floor, once for each preference."""
    done = processing.process(walks(spark, d), True)
    last = done.nodes.groupBy("scan_id").agg(F.max_by("node_id", F.struct("floor_level", "original_index")).alias("node_id"))
    nodes = done.nodes.join(last.withColumn("poi_name", F.lit("Goal")), ["scan_id", "node_id"], "left")
    wishes = F.explode(F.array(*map(F.lit, ("SHORTEST", "ELEVATOR_FIRST", "STAIRCASE_FIRST"))))
    first = done.points.filter("seq = 0").select("scan_id", F.lit(1).alias("floor_level"), "x", "y", F.lit("Goal").alias("destination"), wishes.alias("preference"))
    asked = first.withColumn("request_id", F.row_number().over(Window.partitionBy("scan_id").orderBy("preference")).cast("long"))
    edges = kept(done.edges)
    return rounded(routing.routes(asked, nodes, edges, routing.landmarks(done.nodes, edges)).withColumn("n_nodes", F.size("path")).drop("path", "settled"))


# --- look-ups: nations as buildings, customers as floors, orders as paths with line items as segments ---------------------

FLOORS = "SELECT c_custkey, c_nationkey, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS level FROM customer"


def floor_rows(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").select("c_custkey", "c_nationkey", F.row_number().over(Window.partitionBy("c_nationkey").orderBy("c_custkey")).cast("long").alias("level"))


query("r1_floors_of_building", f"SELECT * FROM ({FLOORS}) WHERE c_nationkey = 7 ORDER BY level")(lambda s, d: catalog.of_parent(floor_rows(s, d), "c_nationkey", 7, "level"))
query("r2_floor_by_level", f"SELECT * FROM ({FLOORS}) WHERE c_nationkey = 7 AND level = 2")(lambda s, d: catalog.matching(floor_rows(s, d), c_nationkey=7, level=2))
query("r3_r4_floor_with_segments", "SELECT o_orderkey, o_orderstatus, count(l_linenumber) AS n, coalesce(string_agg(CAST(l_linenumber AS VARCHAR), ',' ORDER BY l_linenumber), '') AS segments FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY ALL")(
    lambda s, d: catalog.with_parts(table(s, d, "orders").select("o_orderkey", "o_orderstatus"), table(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber", ["l_quantity"], "parts").select("o_orderkey", "o_orderstatus", F.coalesce(F.size("parts"), F.lit(0)).cast("long").alias("n"), F.coalesce(F.array_join(F.col("parts.l_linenumber").cast("array<string>"), ","), F.lit("")).alias("segments"))
)
query("r5_conflicts", f"SELECT c_nationkey, level FROM ({FLOORS}) WHERE level <= 3 AND c_nationkey < 5")(lambda s, d: catalog.conflicts(s.range(5).select(F.col("id").cast("int").alias("c_nationkey"), F.explode(F.array(*(F.lit(i).cast("long") for i in (1, 2, 3)))).alias("level")), floor_rows(s, d), ["c_nationkey", "level"]))
query("r6_path_with_segments", "SELECT o_orderkey, sum(l_quantity) AS quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")(
    lambda s, d: catalog.with_parts(table(s, d, "orders").select("o_orderkey"), table(s, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), "o_orderkey", "l_linenumber", ["l_quantity"], "parts", "inner").select("o_orderkey", F.aggregate("parts.l_quantity", F.lit(0.0), lambda a, x: a + x).alias("quantity"))
)
query("r7_passages_by_type", "SELECT o_orderkey FROM orders WHERE o_custkey = 7 AND o_orderstatus = 'F'")(lambda s, d: catalog.matching(table(s, d, "orders"), o_custkey=7, o_orderstatus="F").select("o_orderkey"))
query("r8_passage_with_levels", f"WITH f AS ({FLOORS}) SELECT o_orderkey, a.level AS from_level, b.level AS to_level FROM orders LEFT JOIN f a ON a.c_custkey = o_custkey LEFT JOIN f b ON b.c_custkey = o_custkey + 1")(
    lambda s, d: catalog.with_levels(table(s, d, "orders").select("o_orderkey", F.col("o_custkey").alias("from_floor_id"), (F.col("o_custkey") + 1).alias("to_floor_id")), floor_rows(s, d).withColumnRenamed("c_custkey", "floor_id")).select("o_orderkey", "from_level", "to_level")
)
query("r9_r10_poi_search", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'plate')")(lambda s, d: catalog.named_like(table(s, d, "part"), "p_name", " PLATE ").select("p_partkey", "p_name"))
query("r11_poi_by_name", "SELECT p_partkey, p_name FROM part WHERE p_name = (SELECT min(p_name) FROM part)")(lambda s, d: table(s, d, "part").join(table(s, d, "part").agg(F.min("p_name").alias("p_name")), "p_name", "left_semi").select("p_partkey", "p_name"))
query("r12_buildings_by_status", "SELECT n_nationkey, n_name, count(c_custkey) AS floors FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'BUILDING' GROUP BY ALL")(
    lambda s, d: table(s, d, "nation").join(catalog.matching(table(s, d, "customer"), c_mktsegment="BUILDING"), F.col("n_nationkey") == F.col("c_nationkey"), "left").groupBy("n_nationkey", "n_name").agg(F.count("c_custkey").alias("floors"))
)


ASKED = "SELECT CAST(n AS INTEGER) AS c_nationkey FROM range(0, 30) t(n)"
query("r12_building_detail", f"WITH f AS ({FLOORS}), a AS ({ASKED}), fl AS (SELECT c_nationkey, string_agg(CAST(level AS VARCHAR), ',' ORDER BY level) AS floors FROM f GROUP BY 1), pa AS (SELECT c_nationkey, count(*) AS n, min(o_orderkey) AS first FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1) SELECT a.c_nationkey, n_name, coalesce(floors, '') AS floors, coalesce(pa.n, 0) AS n_passages, pa.first AS first_passage, CASE WHEN n_nationkey IS NULL THEN 'BUILDING_NOT_FOUND' END AS error FROM a LEFT JOIN nation ON n_nationkey = a.c_nationkey LEFT JOIN fl ON fl.c_nationkey = a.c_nationkey LEFT JOIN pa ON pa.c_nationkey = a.c_nationkey")(
    lambda s, d: catalog.building_detail(
        catalog.answered(s.range(30).select(F.col("id").cast("int").alias("c_nationkey")), table(s, d, "nation").select(F.col("n_nationkey").cast("int").alias("c_nationkey"), "n_name"), ["c_nationkey"], "BUILDING_NOT_FOUND"),
        floor_rows(s, d), table(s, d, "orders").join(table(s, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("c_nationkey", "o_orderkey"), "c_nationkey", "level", "o_orderkey",
    ).select("c_nationkey", "n_name", F.array_join(F.col("floors").cast("array<string>"), ",").alias("floors"), F.size("passages").cast("long").alias("n_passages"), F.try_element_at("passages", F.lit(1)).alias("first_passage"), "error")
)
query("r17_not_found", "SELECT c_custkey + 10 AS key, CASE WHEN c_custkey + 10 > (SELECT max(c_custkey) FROM customer) THEN 'FLOOR_NOT_FOUND' END AS error FROM customer")(
    lambda s, d: catalog.answered(table(s, d, "customer").select((F.col("c_custkey") + 10).alias("key")), table(s, d, "customer").select(F.col("c_custkey").alias("key")), ["key"], "FLOOR_NOT_FOUND")
)
query("job_pending", f"{WALKS} SELECT scan_id + k * 1000000 AS scan_id, CASE k WHEN 0 THEN 'PROCESSING' ELSE 'PENDING' END AS status, CASE k WHEN 0 THEN 40 ELSE 0 END AS progress, NULL AS error FROM (SELECT DISTINCT scan_id FROM p), range(0, 2) t(k)")(
    lambda s, d: processing.jobs(walks(s, d), reached="leveled", submitted=walks(s, d).select("scan_id").unionByName(walks(s, d).select((F.col("scan_id") + 1000000).alias("scan_id"))))
)


@query("r13_snap_poi")
def r13(spark: SparkSession, d: str) -> DataFrame:
    done = processing.process(walks(spark, d))
    nodes = done.nodes
    places = done.points.select("scan_id", "seq", F.lit(1).alias("floor_level"), F.col("x").alias("px"), F.col("y").alias("py"), F.col("z").alias("pz"))
    return rounded(graph.nearest_node(places, nodes, ["scan_id", "seq"]))


query("r14_sessions_of_building", "SELECT o_orderkey, o_orderstatus FROM orders WHERE o_custkey = 11")(lambda s, d: catalog.of_parent(table(s, d, "orders"), "o_custkey", 11).select("o_orderkey", "o_orderstatus"))
query("r17_accepted", "SELECT c_custkey + 10 AS key FROM customer WHERE c_custkey + 10 NOT IN (SELECT c_custkey FROM customer)")(lambda s, d: catalog.accepted(table(s, d, "customer").select((F.col("c_custkey") + 10).alias("key")), table(s, d, "customer").select(F.col("c_custkey").alias("key")), ["key"], ["key"]))
def created_floors(spark: SparkSession, d: str) -> DataFrame:
    """A table of floors in the shared folder, and new ones of which some clash with it, some with each other and some are blank."""
    c, key = table(spark, d, "customer"), F.col("c_custkey")
    floors_table = VersionedTable(spark, f"{shared_folder(spark)}/floors-{uuid.uuid4().hex}", "request long, level long, name string")
    catalog.create(floors_table, c.filter(key % 3 == 0).select((-key).alias("request"), key.alias("level"), F.col("c_name").alias("name")), ["level"], ["name"], "request")
    new = c.select(key.alias("request"), F.floor(key / 2).alias("level"), F.when(key % 7 == 0, " ").otherwise(F.col("c_name")).alias("name"))
    answers = catalog.create(floors_table, new, ["level"], ["name"], "request")
    return answers.select("request", "level", "error", F.lit(floors_table.latest()).alias("version")).join(floors_table.read().select("request", F.col("level").alias("stored")), "request", "left").select("request", "level", "error", "version", F.when(F.col("error").isNull(), F.col("stored")).alias("stored"))


query("r17_created", """WITH n AS (SELECT CAST(c_custkey AS BIGINT) AS request, CAST(c_custkey // 2 AS BIGINT) AS level, c_custkey % 7 = 0 AS blank FROM customer),
j AS (SELECT request, level, CASE WHEN blank THEN 'INVALID_INPUT_VALUE' WHEN level IN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) OR row_number() OVER (PARTITION BY level, blank ORDER BY request) > 1 THEN 'FLOOR_ALREADY_EXISTS' END AS error FROM n)
SELECT request, level, error, 2 AS version, CASE WHEN error IS NULL THEN level END AS stored FROM j""")(created_floors)  # fmt: skip
query("r17_m9_changed", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment FROM customer")(lambda s, d: catalog.changed(table(s, d, "customer").select("c_custkey", "c_mktsegment"), table(s, d, "customer").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "NEW").alias("c_mktsegment")), "c_custkey", ["c_mktsegment"]))
query("r17_deleted", "SELECT c_custkey FROM customer WHERE c_custkey % 5 <> 0")(lambda s, d: catalog.deleted(table(s, d, "customer").select("c_custkey"), table(s, d, "customer").filter("c_custkey % 5 = 0"), "c_custkey"))
query("m6_poi_type", "SELECT p_partkey, CASE WHEN p_partkey % 4 > 1 THEN 'POI' WHEN p_partkey % 3 = 0 THEN 'POI' ELSE 'WAYPOINT' END AS type, CASE WHEN p_partkey % 3 = 1 THEN 'ENDPOINT' ELSE 'WAYPOINT' END AS cleared FROM part")(
    lambda s, d: table(s, d, "part").select("p_partkey", F.when(F.col("p_partkey") % 4 == 1, F.lit("  ")).when(F.col("p_partkey") % 4 > 1, F.col("p_name")).alias("name"), F.when(F.col("p_partkey") % 3 == 0, "POI").otherwise("WAYPOINT").alias("was"), F.when(F.col("p_partkey") % 3 == 0, "POI").when(F.col("p_partkey") % 3 == 1, "ENDPOINT").otherwise("WAYPOINT").alias("before"))
    .select("p_partkey", geo.poi_type(F.col("was"), F.col("name")).alias("type"), geo.cleared_type(F.col("before")).alias("cleared"))
)
query("m8_point_or_null", f"{WALKS} SELECT scan_id, seq, CASE WHEN seq > 0 AND node_id % 5 <> 0 THEN round(lag(x) OVER (PARTITION BY scan_id ORDER BY seq), 6) END AS px, CASE WHEN seq > 0 AND node_id % 5 <> 0 THEN round(z, 6) END AS pz FROM p")(
    lambda s, d: walks(s, d).withColumns({"x": F.lag("x").over(cleaning.by(cleaning.KEYS)), "z": F.when(F.col("node_id") % 5 != 0, F.col("z"))}).select("scan_id", "seq", geo.point_or_null(F.col("x"), F.col("y"), F.col("z")).alias("at")).select("scan_id", "seq", F.round("at.x", 6).alias("px"), F.round("at.z", 6).alias("pz"))
)
OFF = "(x - ax) * ux + (y - ay) * uy + (z - az) * uz"
query("m4_line_distance", f"{WALKS}, e AS (SELECT *, first_value(x) OVER w AS ax, first_value(y) OVER w AS ay, first_value(z) OVER w AS az, last_value(x) OVER w AS bx, last_value(y) OVER w AS ey, last_value(z) OVER w AS bz FROM p WINDOW w AS (PARTITION BY scan_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)), l AS (SELECT *, sqrt((bx - ax) * (bx - ax) + (ey - ay) * (ey - ay) + (bz - az) * (bz - az)) AS n FROM e), u AS (SELECT *, CASE WHEN n < 1e-10 THEN 0 ELSE (bx - ax) / n END AS ux, CASE WHEN n < 1e-10 THEN 0 ELSE (ey - ay) / n END AS uy, CASE WHEN n < 1e-10 THEN 0 ELSE (bz - az) / n END AS uz FROM l), o AS (SELECT *, {OFF} AS t FROM u) SELECT scan_id, seq, round(sqrt((x - ax - t * ux) * (x - ax - t * ux) + (y - ay - t * uy) * (y - ay - t * uy) + (z - az - t * uz) * (z - az - t * uz)), 6) AS d FROM o")(lambda s, d: walks(s, d).withColumn("_p", F.struct("x", "y", "z")).withColumns({"_a": F.first("_p").over(Window.partitionBy("scan_id").orderBy("seq")), "_b": F.max_by("_p", "seq").over(Window.partitionBy("scan_id"))}).select("scan_id", "seq", F.round(geo.line_distance(cleaning.here(), [F.col(f"_a.{c}") for c in "xyz"], [F.col(f"_b.{c}") for c in "xyz"]), 6).alias("d")))


# --- jobs as a stream -------------------------------------------------------------------------------------------------


def job_folder(spark: SparkSession, d: str) -> str:
    """Runs both streams over the walks as database files, some of them broken or without a valid pose; where they left their tables."""
    out = f"{shared_folder(spark)}/jobs-{uuid.uuid4().hex}"
    scan, good = F.col("scan_id"), encoded_pose(F.array(*(F.lit(float(k)) for k in (1, 0, 0)), "x", *(F.lit(float(k)) for k in (0, 1, 0)), "y", *(F.lit(float(k)) for k in (0, 0, 1)), "z"))
    nodes = walks(spark, d).select(scan, "node_id", F.when(scan % 10 == 0, F.lit(b"short")).otherwise(good).alias("pose"))
    broken = F.substring_index(F.col("path"), ".", 1).cast("long") % 15 == 7
    slam.packed(nodes).withColumn("content", F.when(broken, F.lit(b"broken")).otherwise(F.col("content"))).write.parquet(f"{out}/in")
    arriving = spark.readStream.schema("path string, content binary").parquet(f"{out}/in")
    jobs.process_arrivals(arriving, out, f"{out}/process").awaitTermination()
    jobs.follow_jobs(spark, out, f"{out}/follow").awaitTermination()
    return out


def job_moves(spark: SparkSession, d: str) -> DataFrame:
    return jobs.transitions(spark, job_folder(spark, d)).select("scan_id", "number", "status", "progress", (F.col("message").isNotNull()).alias("reason"))


query("job_transitions", f"""{WALKS}, s AS (SELECT scan_id || '.db' AS scan_id, CASE WHEN scan_id % 15 = 7 THEN 0 WHEN scan_id % 10 = 0 THEN 1 ELSE 2 END AS kind FROM (SELECT DISTINCT scan_id FROM p)),
m(kind, number, status, progress, reason) AS (VALUES (0, 1, 'PENDING', 0, false), (0, 2, 'FAILED', 0, true), (1, 1, 'PENDING', 0, false), (1, 2, 'PROCESSING', 5, false), (1, 3, 'FAILED', 5, true),
  (2, 1, 'PENDING', 0, false), (2, 2, 'PROCESSING', 5, false), (2, 3, 'PROCESSING', 20, false), (2, 4, 'PROCESSING', 40, false), (2, 5, 'PROCESSING', 70, false), (2, 6, 'PROCESSING', 95, false), (2, 7, 'COMPLETED', 100, false))
SELECT scan_id, number, status, progress, reason FROM s JOIN m USING (kind)""")(job_moves)  # fmt: skip
