"""Tables that several later steps read are computed once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder, spark.checkpoint.dir; where that is unset, on a local master only, one beside the warehouse."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir names no shared folder")
    return found or spark.conf.get("spark.sql.warehouse.dir") + "/checkpoints"


def kept(df: DataFrame) -> DataFrame:
    """The rows of df, computed once and written to the shared checkpoint folder, which outlives lost executors."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)
