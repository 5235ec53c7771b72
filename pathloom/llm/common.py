"""Helpers shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A side is broadcast only after it has been counted and found to have at most this many (narrow) rows.
BROADCAST_ROWS = 200_000


#: Rows that Spark hands to Python at a time. Documents can be long, and a batch is held several times over on its way.
BATCH_ROWS = 500


def in_batches(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], more: str, kept: Sequence[T.StructField] = ()) -> DataFrame:
    """df.mapInArrow(run) over small batches; the result's columns are `kept` and then those of `more` (DDL).

    The size of batches is a setting of the session, which stays set.
    """
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)
    return df.mapInArrow(run, T.StructType([*kept, *T.StructType.fromDDL(more).fields]))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where that is unset (local tests), one beside the warehouse."""
    return spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared store that nothing will read again."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


#: Shuffle files go when the query that wrote them ends, not when the driver happens to collect its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared checkpoint folder; the shuffle files of that are deleted at once."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        return df.select("*").checkpoint(eager=True)  # planned anew, under the setting
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)


def broadcast_if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """df marked for broadcast if it has at most `rows` rows, else df itself, which Spark then joins by a shuffle.

    df should be cheap to count (a checkpoint or a small aggregate of one).
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def input_partitions(df: DataFrame) -> int:
    """How many tasks Spark plans for reading df: a figure that grows with the input, known without a job."""
    return max(1, df.rdd.getNumPartitions())


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, order: list[str]) -> tuple[DataFrame, int]:
    """df in a total order with its 0-based place as `_rank`, and the number of rows.

    A range-partitioned sort; the driver sees one count per partition, no rows.
    """
    spark = df.sparkSession
    spread = df.repartitionByRange(shuffle_partitions(spark), *order).sortWithinPartitions(*order)
    placed = cut(spread.withColumn("_mid", F.monotonically_increasing_id()))
    pid, place = F.shiftrightunsigned("_mid", 33), F.col("_mid").bitwiseAND((1 << 33) - 1)
    counts = {r[0]: r[1] for r in placed.groupBy(pid.alias("pid")).agg(F.count("*").alias("n")).collect()}  # one row a partition
    before, total = [], 0
    for p in sorted(counts):
        before.append((p, total))
        total += counts[p]
    starts = spark.createDataFrame(before or [(0, 0)], "_pid long, _start long")
    out = placed.withColumn("_pid", pid).join(F.broadcast(starts), "_pid").withColumn("_rank", F.col("_start") + place)
    return out.drop("_mid", "_pid", "_start"), total


def components(edges: DataFrame, done: Callable[[int], None] | None = None, sorted_joins: bool = False) -> DataFrame:
    """Connected components of edges (a, b) as (node, root), root being the smallest node reachable.

    Labels spread along edges and then jump to their label's label; each round is checkpointed, so its cost
    does not depend on the rounds before, and a chain of n nodes takes about log n rounds. With sorted_joins no side is
    broadcast, which spares the driver's memory where many rounds follow each other.
    """
    side = (lambda df: df.hint("merge")) if sorted_joins else (lambda df: df)
    # both directions of an edge at once: a union would compute the edges twice
    both = cut(edges.select(F.explode(F.array(F.struct("a", "b"), F.struct(F.col("b").alias("a"), F.col("a").alias("b")))).alias("_e")).select("_e.*").distinct())
    labels = cut(both.groupBy(F.col("a").alias("node")).agg(F.least(F.first("a"), F.min("b")).alias("root")))
    rounds = 0
    while True:
        heard = both.join(side(labels), both.b == labels.node).groupBy("a").agg(F.min("root").alias("heard"))
        near = cut(labels.join(side(heard), labels.node == heard.a, "left").select("node", F.col("root").alias("old"), F.least("root", "heard").alias("root")))
        up = near.select(F.col("node").alias("root"), F.col("root").alias("above"))
        labels = cut(near.join(side(up), "root", "left").select("node", "old", F.least("root", "above").alias("root")))
        rounds += 1
        if not labels.filter("old <> root").limit(1).count():
            if done:
                done(rounds)
            return labels.select("node", "root")
        labels = labels.select("node", "root")


def running_total(df: DataFrame, order: str, weight: str) -> DataFrame:
    """df (one row per value of `order`) with `_before`: the weight of all rows with a smaller value."""
    spark = df.sparkSession
    spread = df.repartitionByRange(shuffle_partitions(spark), order).sortWithinPartitions(order)
    placed = cut(spread.withColumn("_pid", F.spark_partition_id()))
    sums = sorted((r[0], r[1]) for r in placed.groupBy("_pid").agg(F.sum(weight)).collect())  # one row a partition
    starts, total = [], 0
    for p, n in sums:
        starts.append((p, total))
        total += n
    start = spark.createDataFrame(starts or [(0, 0)], "_pid int, _start long")
    inside = F.sum(weight).over(Window.partitionBy("_pid").orderBy(order).rowsBetween(Window.unboundedPreceding, -1))
    return placed.join(F.broadcast(start), "_pid").withColumn("_before", F.col("_start") + F.coalesce(inside, F.lit(0))).drop("_pid", "_start")
