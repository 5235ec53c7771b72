"""Jobs: scans that arrive as files are processed batch by batch, and each job's state follows from a stream of events.

Two queries, each of which starts again where it stopped:
  - `process_arrivals` reads database files as they arrive, works through the process for all files of a batch at once and stores, as it goes, one event
    for each scan and step (PENDING, PROCESSING with a progress, COMPLETED or FAILED with the reason) and the results;
  - `follow_jobs` reads the events and keeps each job's state. It hands on what moves a job forward: from PENDING to PROCESSING, to a higher progress, to
    COMPLETED or FAILED, where a job ends. Events that a batch stores again when it runs a second time move nothing, so no transition comes twice.
`current_jobs` is the last transition of each job, `job_result` its result if it is COMPLETED.

A file that is no database, or has no valid pose, or leaves no path after cleaning, fails alone. A job is named by its file.

Defined cases: an arriving file of a known name counts as the same job, and as done if that is; a batch without files does nothing; what happens
between two looks at the events comes out in order, one transition each.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from ..operators.keeping import kept
from ..plans import processing
from ..sources.scans import trajectory
from ..sources.slam import nodes_in

BINARY_FILES = "path string, modificationTime timestamp, length long, content binary"
EVENTS = "scan_id string, status string, progress int, message string, batch long, step int"
TRANSITIONS = "scan_id string, number int, status string, progress int, message string"
#: States in the order in which a job passes them; the last two end it.
RANKS = {"PENDING": 0, "PROCESSING": 1, "COMPLETED": 2, "FAILED": 2}
#: The states of a scan session beside those of its job.
SESSION = {"PENDING": "UPLOADED", "PROCESSING": "PROCESSING", "COMPLETED": "COMPLETED", "FAILED": "FAILED"}
NO_POSE, NO_PATH = "no valid pose", "no path is left after cleaning"


class Batch:
    """The work on one batch of files, and the events it stores."""

    def __init__(self, out: str, number: int):
        self.out, self.number, self.step = out, number, 0

    def tell(self, scans: DataFrame, status: str, progress: int | None = None, message: str | None = None) -> None:
        """An event for each scan; scans may bring a message or a progress of their own."""
        rows = scans.withColumns({"status": F.lit(status), **({"progress": F.lit(progress)} if progress is not None else {}), **({} if "message" in scans.columns else {"message": F.lit(message).cast("string")})})
        # overwriting makes a batch that runs again leave the same events
        rows.select("scan_id", "status", "progress", "message").write.mode("overwrite").parquet(f"{self.out}/events/batch={self.number}/step={self.step}")
        self.step += 1

    def run(self, files: DataFrame) -> None:
        nodes = kept(nodes_in(files))
        heads = nodes.filter("head")
        self.tell(heads.select("scan_id"), "PENDING", 0)
        self.tell(heads.filter("error IS NOT NULL").select("scan_id", F.col("error").alias("message")), "FAILED", 0)
        points = kept(trajectory(nodes.filter("NOT head")))
        alive = kept(points.select("scan_id").distinct())
        good = heads.filter("error IS NULL").select("scan_id")
        self.tell(good, "PROCESSING", processing.STAGES[0][1])
        self.tell(good.join(alive, "scan_id", "left_anti"), "FAILED", processing.STAGES[0][1], NO_POSE)
        done = processing.process(points, derive_endpoints=True)
        for stage, progress in processing.STAGES[1:]:
            rows = getattr(done, stage)  # computed here
            if stage == "paths":
                left = kept(rows.select("scan_id").distinct())
                self.tell(alive.join(left, "scan_id", "left_anti"), "FAILED", processing.STAGES[processing.STAGES.index((stage, progress)) - 1][1], NO_PATH)
                alive = left
            self.tell(alive, "PROCESSING", progress)
        processing.write_results(done, f"{self.out}/results", self.number)
        self.tell(alive, "COMPLETED", 100)


def arriving(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """The stream of .db files under a folder."""
    return spark.readStream.schema(BINARY_FILES).format("binaryFile").option("pathGlobFilter", "*.db").option("maxFilesPerTrigger", files_per_batch).load(folder).select("path", "content")


def process_arrivals(files: DataFrame, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Processes a stream of files (path, content) and stores events and results under `out`; by default what is there now."""
    return files.writeStream.foreachBatch(lambda batch, number: Batch(out, number).run(batch)).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


class JobState(StatefulProcessor):
    """A job's number of transitions, status and progress. Ended jobs keep theirs, so that late or repeated events find it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.job = handle.getValueState("job", "number int, status string, progress int")

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timer_values: object) -> Iterator[Row]:
        number, status, progress = self.job.get() or (0, None, -1)
        moves = []
        for event in sorted(rows, key=lambda r: (r.batch, r.step)):
            new, share = event.status, event.progress
            ended = status is not None and RANKS[status] == 2
            if not ended and (status is None or RANKS[new] > RANKS[status] or (new == status and share > progress)):
                number, status, progress = number + 1, new, max(int(share), progress)
                moves.append(Row(scan_id=key[0], number=number, status=status, progress=progress, message=event.message))
        if moves:
            self.job.update((number, status, progress))
        yield from moves

    def close(self) -> None:
        pass


def follow_jobs(spark: SparkSession, out: str, checkpoint: str, trigger: dict | None = None) -> StreamingQuery:
    """Appends each job's transitions to `out`/transitions as its events come in."""
    events = spark.readStream.schema(EVENTS).parquet(f"{out}/events")
    moves = events.groupBy("scan_id").transformWithState(JobState(), TRANSITIONS, "Append", "None")
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the query takes the setting along
        return moves.writeStream.format("parquet").option("path", f"{out}/transitions").option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
    finally:
        spark.conf.set(provider, before)


def transitions(spark: SparkSession, out: str) -> DataFrame:
    return spark.read.schema(TRANSITIONS).parquet(f"{out}/transitions")


def current_jobs(moves: DataFrame) -> DataFrame:
    """One row for each job: scan_id, status, session_status, progress, message, error."""
    last = moves.groupBy("scan_id").agg(F.max_by(F.struct("status", "progress", "message"), "number").alias("j"))
    session = F.create_map(*(F.lit(x) for pair in SESSION.items() for x in pair))
    return last.select("scan_id", "j.status", session[F.col("j.status")].alias("session_status"), "j.progress", F.when(F.col("j.status") != "FAILED", F.col("j.message")).alias("message"), F.when(F.col("j.status") == "FAILED", F.col("j.message")).alias("error"))


def job_result(asked: DataFrame, moves: DataFrame, results: DataFrame) -> DataFrame:
    """Each job asked for (scan_id) with its result if it is COMPLETED, else with `error`: JOB_NOT_FOUND or JOB_NOT_COMPLETED."""
    jobs = current_jobs(moves).select("scan_id", F.col("status").alias("_status"))
    done = jobs.filter("_status = 'COMPLETED'").select("scan_id").join(results, "scan_id")
    error = F.when(F.col("_status").isNull(), "JOB_NOT_FOUND").when(F.col("_status") != "COMPLETED", "JOB_NOT_COMPLETED")
    return asked.join(jobs, "scan_id", "left").join(done, "scan_id", "left").withColumn("error", error).drop("_status")
