"""Poses and positions of nodes, and a trajectory made from the events table."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.geometry import valid_position


@F.pandas_udf(T.ArrayType(T.DoubleType()))
def decoded_pose(pose: pd.Series) -> pd.Series:
    """Twelve little-endian 32-bit floats, row by row a 3 x 4 matrix."""
    return pose.map(lambda b: None if b is None or len(b) != 48 else np.frombuffer(b, "<f4").astype(float))


@F.pandas_udf(T.BinaryType())
def encoded_pose(matrix: pd.Series) -> pd.Series:
    """The other way round: twelve numbers as little-endian 32-bit floats."""
    return matrix.map(lambda m: None if m is None else np.asarray(m, "<f4").tobytes())


def scan_files(spark: SparkSession, folder: str) -> DataFrame:
    """The .db files of a folder with their sizes, and a name of its own for each to be stored under."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.db").load(folder)
    return files.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), "path", F.concat(F.substring(F.sha2("path", 256), 1, 32), F.lit(".db")).alias("stored_name"), F.round(F.col("length") / (1024 * 1024), 2).alias("size_mb"))


#: The tolerance of older readers (S6) for a position at the origin.
OLD_TOLERANCE = 1e-8


def trajectory(nodes: DataFrame, tolerance: float = 1e-6, any_length: bool = False) -> DataFrame:
    """scan_id, node_id, seq, x, y, z of nodes with a pose of 48 bytes at a valid position.

    S6: with any_length a pose of another length that is not empty is no node to leave out but an error, as in readers
    that don't look at the length; OLD_TOLERANCE is theirs.
    """
    if any_length:
        wrong = F.raise_error(F.concat(F.lit("pose of "), F.length("pose").cast("string"), F.lit(" bytes"))).cast("binary")
        nodes = nodes.withColumn("pose", F.when(F.length("pose").isin(0, 48), F.col("pose")).when(F.length("pose").isNotNull(), wrong))
    poses = nodes.filter(F.length("pose") == 48).withColumn("m", decoded_pose("pose"))
    points = poses.select("scan_id", "node_id", *(F.element_at("m", k).alias(c) for c, k in zip("xyz", (4, 8, 12))))
    valid = points.filter(valid_position(F.col("x"), F.col("y"), F.col("z"), tolerance))
    return valid.withColumn("seq", (F.row_number().over(Window.partitionBy("scan_id").orderBy("node_id")) - 1).cast("long"))


def rotation(matrix: str | Column = "m") -> Column:
    """The first three columns of the matrix, row by row."""
    return F.concat(*(F.slice(matrix, k, 3) for k in (1, 5, 9)))


#: One walk for each user of the events table; the same text runs on Spark and DuckDB.
TRAJECTORY_SQL = """
SELECT scan_id, node_id, CAST(i AS BIGINT) AS seq,
  CAST(CASE WHEN i < 14 THEN 1.0 + 0.6 * i WHEN lift AND i < 40 THEN 8.8 WHEN i < 20 THEN 8.8 - 0.6 * (i - 13)
       WHEN i < 34 THEN 5.2 + 0.28 * (i - 19) WHEN i < 46 THEN 9.12 WHEN i < 58 THEN 9.12 + 0.6 * (i - 45) ELSE 24.0 + 0.6 * (i - 57) END AS DOUBLE)
    + CASE WHEN e % 97 = 0 THEN 6.0e0 ELSE 0.0e0 END + (e % 11) * 0.00137e0 AS x,
  CAST(CASE WHEN i < 34 THEN 2.0 WHEN lift AND i < 40 THEN 2.0 WHEN i < 46 THEN 2.0 + 0.6 * (i - 33) ELSE 9.2 END AS DOUBLE) + ((e % 7) - 3) * 0.01713e0 AS y,
  CAST((CASE WHEN scan_id % 3 = 0 THEN -1 ELSE 1 END) * (CASE WHEN i < 20 THEN 1.2 WHEN i < 34 THEN 1.2 + 0.25 * (i - 19) ELSE 4.7 END) AS DOUBLE) + ((e % 5) - 2) * 0.00719e0 AS z
FROM (SELECT user_id AS scan_id, event_id AS node_id, event_id AS e, user_id % 2 = 1 AS lift,
        row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS i FROM {events})
"""


def walks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(TRAJECTORY_SQL.format(events=f"parquet.`{sf_dir}/events.parquet`"))
