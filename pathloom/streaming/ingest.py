"""Statistics of scans that arrive as files, batch by batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.cleaning import trajectory_stats

POINTS = "scan_id long, node_id long, seq long, x double, y double, z double"


def ingest_stats(spark: SparkSession, folder: str, out: str, checkpoint: str) -> StreamingQuery:
    """Writes T1's row for each scan of each new batch of Parquet files under `folder`; a scan comes whole in one batch. A batch that runs again replaces its own output."""

    def put(batch: DataFrame, number: int) -> None:
        trajectory_stats(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return spark.readStream.schema(POINTS).parquet(folder).writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
